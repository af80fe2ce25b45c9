import pytest

from threadloom.llm.mojibake import CHAINS, CLEAN, damaged_fields, garbled, restored_fields, undone, verdict

CLEAN_WORDS = ["Ysölde", "Brännkvist", "Vačpazorřl", "Kaőrastox", "Терадяк", "вюник", "Κωσωπός", "デドクメビム", "“dense”", "basket’s", "–", "ÂLTO", "VELÃO", "MÂRCA", "«Planeflort»", "¿Greabrair", "44°", "±50", "£25", "§", "µm", "m³", "©", "÷", "½", "2½", "⅔", "x²", "日本語", "Foo™", "1891–1901", "Nikañkát"]
COLS = "ord bigint, subject string, from_addr string"


def test_verdicts():
    assert [w for w in CLEAN_WORDS if verdict(w) != CLEAN] == []
    for w in ("YsÃ¶lde", "Ys√∂lde", "Ys÷lde", "Ys�lde", "рЕПЮДЪЙ", "Òåðàäÿê", "ƒ_ƒ‰ƒP", "Ð\x96Ð¸", "╨Ц╨╕", "m�", "Breagou≤"):
        assert verdict(w) != CLEAN, w


@pytest.mark.parametrize("chain", list(CHAINS))
def test_round_trip(chain):
    some = 0
    for w in CLEAN_WORDS:
        g = garbled(w, chain)
        if g is not None and g != w:
            back = undone(g, chain)
            assert back is None or garbled(back, chain) == g
            some += back == w
    assert some or "greek" in chain or "jis" in chain or "jp" in chain or "437" in chain or "850" in chain or "mac" in chain or "cp866" in chain or "koi8" in chain or "1250" in chain or "latin2" in chain or "1251" in chain


KNOWN = [("Ysölde", "utf8-cp1252"), ("Ysölde", "utf8-cp1252-twice"), ("Ysölde", "utf8-macroman"), ("Ysölde", "latin1-cp437"), ("Ysölde", "latin1-macroman"), ("Vačpazorřl", "latin2-latin1"), ("Терадяк", "cp1251-latin1"), ("Терадяк", "koi8r-cp1251"), ("вюник", "koi8r-cp1251"), ("Терадяк", "cp866-latin1"), ("Κωσωπός", "greek-latin1"), ("デドクメビム", "sjis-latin1"), ("–", "utf8-cp1252"), ("±50", "utf8-macroman")]


def test_known_words_come_back(spark):
    rows = [(i, f"Re: {w} ok", "a <a@b>") for i, w in enumerate(CLEAN_WORDS)] * 2
    for k, (word, chain) in enumerate(KNOWN):
        bad = garbled(word, chain)
        rows += [(100 + 2 * k, f"see {bad} now", None), (101 + 2 * k, None, f'"{bad}" <x@y>')]
    df = spark.createDataFrame(rows, COLS)
    want = {(100 + 2 * k, "subject"): (f"see {w} now", True) for k, (w, _) in enumerate(KNOWN)} | {(101 + 2 * k, "from_addr"): (f'"{w}" <x@y>', True) for k, (w, _) in enumerate(KNOWN)}
    assert {tuple(r) for r in damaged_fields(df).collect()} == set(want)
    assert {(r["ord"], r["field"]): (r["restored"], r["whole"]) for r in restored_fields(df).collect()} == want


def test_unknown_words_come_back_by_walking_the_chain(spark):
    rows = [(1, "Жилор Нирачекок", None), (2, garbled("Новый Петяра", "utf8-cp1251"), None), (3, garbled("Хитярон", "cp1251-latin1"), None), (4, garbled("﻿plain", "utf8-cp1252"), None)]
    got = {r["ord"]: r["restored"] for r in restored_fields(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {2: "Новый Петяра", 3: "Хитярон", 4: "plain"}


def test_lost_text_and_clean_text(spark):
    rows = [(1, "Ys�lde x", "y"), (2, " ".join(CLEAN_WORDS), "Вошукинекs"), (3, "plain", ""), (4, None, None)]
    df = spark.createDataFrame(rows, COLS)
    assert [tuple(r) for r in damaged_fields(df).collect()] == [(1, "subject")]
    (r,) = restored_fields(df).collect()
    assert r["restored"] == "Ys�lde x" and not r["whole"]


def test_edges(spark):
    long = "word " * 50_000 + "YsÃ¶lde"
    df = spark.createDataFrame([(1, long, None, "q", 1), (1, "YsÃ¶lde", None, "q", 1), (None, "YsÃ¶lde", None, "q", 1), (2, "Ã¶" * 5_000, None, "q", 1)], COLS + ", word string, field int")
    assert {tuple(r) for r in damaged_fields(df).collect()} == {(1, "subject"), (None, "subject"), (2, "subject")}
    assert damaged_fields(df.limit(0)).count() == 0 and restored_fields(df.limit(0)).count() == 0


def test_words_that_look_clean_after_damage(spark):
    plain = [(i, "теплый вечер у старого дома", "новый сад за рекой") for i in range(20)] + [(50, "ВНИМАНИЕ ВСЕМ", None)]
    turned = garbled("рекодом старелый", "koi8r-cp1251")  # capitals that read clean, of words met nowhere else
    part = garbled("Вечерадом рекоста", "koi8r-cp1251")  # its first word is odd, its second reads clean
    assert all(verdict(w) == CLEAN for w in turned.split()) and [verdict(w) == CLEAN for w in part.split()] == [False, True]
    latin = [(100 + i, "Žluťoučký kuň řeka kočka", None) for i in range(20)]
    half = garbled("řekočka Žluřeťka", "latin2-latin1")
    df = spark.createDataFrame(plain + latin + [(60, turned, None), (61, None, part), (62, half, None)], COLS)
    assert {tuple(r) for r in damaged_fields(df).collect()} == {(60, "subject"), (61, "from_addr"), (62, "subject")}
    got = {r["ord"]: (r["restored"], r["whole"]) for r in restored_fields(df).collect()}
    assert got == {60: ("рекодом старелый", True), 61: ("Вечерадом рекоста", True), 62: ("řekočka Žluřeťka", True)}


def test_utf8_comes_before_other_chains(spark):
    """Japanese text read as cp1252 is valid in two source encodings; a fraction is no damaged quotation mark."""
    katakana = "\u30cb\u30d6\u30af\u30ea"
    rows = [(i, f"½ inch «word» {katakana}\u30b3", None) for i in range(5)] + [(20, f"{garbled('½', 'utf8-cp1252-twice')} inch", None), (21, garbled(katakana, "utf8-cp1252"), None), (22, garbled("½", "utf8-cp1252"), None)]
    got = {r["ord"]: (r["restored"], r["whole"]) for r in restored_fields(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {20: ("½ inch", True), 21: (katakana, True), 22: ("½", True)}


def test_partly_damaged_words(spark):
    mixed = garbled("Ди", "utf8-cp1251") + "e" + garbled("як", "utf8-cp1251")
    rows = [(1, "Дияк як", None), (2, mixed, None), (3, "Кaк", None)]
    assert {tuple(r) for r in damaged_fields(spark.createDataFrame(rows, COLS)).collect()} == {(2, "subject")}


def test_rows_come_from_the_joins(spark, monkeypatch):
    """With no forms there is nothing to find, whatever a word looks like."""
    from threadloom.llm import mojibake

    df = spark.createDataFrame([(1, "YsÃ¶lde Ys√∂lde ±╨Ц", None), (2, "Ysölde", None)], COLS)
    assert damaged_fields(df).count() == 1
    monkeypatch.setattr(mojibake, "_forms", lambda each: lambda batches: iter(()))
    assert damaged_fields(df).count() == 0
