import unicodedata

import pytest

from threadloom.llm.lookalike import canonical_text, kinds_found

CASES = {
    "Ｋｅｓｌｉｒ １９９８， ok": ("Keslir 1998, ok", {"fullwidth"}),
    "café naïve": ("café naïve", {"combining"}),
    "in​vis­ible﻿": ("invisible", {"invisible"}),
    "a b c d": ("a b c d", {"space"}),
    "rіbbоn": ("ribbon", {"lookalike"}),  # Cyrillic i and o
    "sturgeοn νertical": ("sturgeon vertical", {"lookalike"}),  # Greek o, nu
    "cօarse ɡminie": ("coarse gminie", {"lookalike"}),
    "нeбольшая": ("небольшая", {"lookalike"}),  # Latin e in a Cyrillic word
    "Νωβικaν": ("Νωβικαν", {"lookalike"}),
    "Ｋеslir": ("Keslir", {"fullwidth", "lookalike"}),
    "fоrê​t": ("forêt", {"invisible", "lookalike"}),
    "деревня Βηλέχας plain é ß — “x”": ("деревня Βηλέχας plain é ß — “x”", set()),
    "А о": ("А о", set()),  # single letters are words of one script
    "&nbsp; &#1072;": ("&nbsp; &#1072;", set()),
    "5 μm 日本 עברית हिन्दी": ("5 μm 日本 עברית हिन्दी", set()),
    "Волгаriver": ("Волгаriver", set()),  # two scripts' own letters: nothing was replaced
    "": ("", set()),
    "Q" + "1" * 45 + "\u0430 x": ("Q" + "1" * 45 + "a x", {"lookalike"}),
    "Q" + "1" * 5 + "\u0430": ("Q" + "1" * 5 + "a", {"lookalike"}),
    "a" + "\u200b" * 30 + "\u0301": ("\u00e1", {"combining", "invisible"}),
    "wor\u043a pay\u03c4al \u13a2nternet \U0001d429assword": ("work paytal Tnternet password", {"lookalike"}),
    "pa\u202ass\u2066 w\ufe0ford o\u034fk": ("pass word ok", {"invisible"}),
    "heart \u2764\ufe0f": ("heart \u2764\ufe0f", set()),  # a selector of a sign is ordinary
    "q\u0303": ("q\u0303", {"combining"}),  # no composed form
    "12345\u0439 \u0439": ("12345\u0439 \u0439", set()),
}


def test_cases(spark):
    texts = list(CASES)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {texts[r["doc_id"]]: r["canonical"] for r in canonical_text(df).collect()}
    assert got == {t: c for t, (c, _) in CASES.items()}
    kinds = {t: set() for t in texts}
    for r in kinds_found(df).collect():
        kinds[texts[r["doc_id"]]].add(r["kind"])
    assert kinds == {t: k for t, (_, k) in CASES.items()}


def test_one_member_per_class(spark):
    forms = ["rése​au", "réseau", "ｒéseau", "rе́sеau"]
    df = spark.createDataFrame(list(enumerate(forms)), "doc_id bigint, text string")
    assert {r["canonical"] for r in canonical_text(df).collect()} == {"réseau"}


def test_accents_stay(spark):
    df = spark.createDataFrame([(1, "coté"), (2, "coté"), (3, "cotê"), (4, "Coté")], "doc_id bigint, text string")
    assert [r["canonical"] for r in canonical_text(df).orderBy("doc_id").collect()] == [unicodedata.normalize("NFC", x) for x in ("coté", "coté", "cotê", "Coté")]


@pytest.mark.parametrize("unit", ["plain words and é. ", "слово ", "ríbbоn​ "])
def test_long_texts(spark, unit):
    df = spark.createDataFrame([(1, unit * 40_000)], "doc_id bigint, text string")
    (row,) = canonical_text(df).collect()
    assert len(row["canonical"]) == len(unit.replace("​", "")) * 40_000


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x", 1), (None, "rіbbоn", "y", 2), (2, "a​b", "z", 3), (2, "a​b", "z", 4), (2, "ԁe", "w", 5)], "doc_id bigint, text string, canonical string, word int")
    got = sorted((repr(r["word"]), r["canonical"]) for r in canonical_text(df).collect())
    assert got == [("1", None), ("2", "rіbbоn"), ("3", "ab"), ("4", "ab"), ("5", "de")]
    assert canonical_text(df).columns == ["doc_id", "text", "word", "canonical"]
    assert {tuple(r) for r in kinds_found(df).collect()} == {(None, "lookalike"), (2, "invisible"), (2, "lookalike")}
    assert canonical_text(df.limit(0)).count() == 0 and kinds_found(df.limit(0)).count() == 0


def test_dotless_i_and_other_composing_marks(spark):
    cases = {
        "a r\u0131bbon": ("a ribbon", {"lookalike"}),
        "\u304b\u3099\u306f\u309a": ("\u304c\u3071", {"combining"}),  # kana with voicing marks
        "x \u0627\u0653 y": ("x \u0622 y", {"combining"}),  # Arabic alef with madda
        "\u0627\u0655\u0644": ("\u0625\u0644", {"combining"}),
        "\u0995\u09be \u0ba4\u0bbe": ("\u0995\u09be \u0ba4\u0bbe", set()),  # vowel signs that compose with other letters only
        "\u0628\u0653": ("\u0628\u0653", set()),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["canonical"] for r in canonical_text(df).collect()}
    kinds = {i: set() for i in got}
    for r in kinds_found(df).collect():
        kinds[r["doc_id"]].add(r["kind"])
    assert [(got[i], kinds[i]) for i in range(len(cases))] == list(cases.values())
