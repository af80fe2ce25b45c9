import pytest
from pyspark.sql import functions as F

from threadloom.functions import text

COUNTERS = [
    ("a (1/3) yEnc", (1, 3), (1, 3), "a"),
    ('[2/5] - "x.rar" yEnc (7/40)', (2, 5), (7, 40), '- "x.rar"'),
    ("b [1/5) {2/7}", (1, 5), (2, 7), "b"),
    ("foo PART 3 of 9", (3, 9), (3, 9), "foo"),
    ("part 1 of 2 (4/6)", (4, 6), (4, 6), ""),
    ("no counter", (None, None), (None, None), "no counter"),
    ("(a/b)", (None, None), (None, None), "(a/b)"),
    ("x (0/0)", (0, 0), (0, 0), "x"),
    ("(01/010)", (1, 10), (1, 10), ""),
    ("y.exe (1/1)", (1, 1), (1, 1), "y.exe"),
    ("(99999999999999999999/3)", (None, 3), (None, 3), ""),
    ("part 1 of 2 then part 3 of 4", (1, 2), (3, 4), "then"),
    ("", (None, None), (None, None), ""),
    (None, (None, None), (None, None), None),
]
NAMES = [
    ('[01/12] - "file.part1.rar" yEnc (1/34)', "", ""),
    ('My Show S01 [01/12] - "a.rar" yEnc (1/34)', "My Show S", "My Show S"),
    ('Holiday_Pics_2023 - File 3 of 20 - "img.jpg" 308.31 kB (1/2)', "Holiday Pics", "Holiday Pics"),
    ("Linux ISO . part 2 . foo (3/9)", "Linux ISO", "Linux"),
    ("Ubuntu-22.04 desktop.iso (1/5)", "Ubuntu 22 04 desktop iso", "22 04 desktop"),
    ("A & B\\C_001", "A B C", "A B C"),
    ("movie.mkv (2/2)", "movie", "movie"),
    ("12345", "", ""),
    ("My Collection (01) trailing 077", "My Collection trailing", "My Collection trailing"),
    ("Some.Name.Here.rar yEnc", "Some Name Here", "Some Name Here"),
    ("long_name_with_under_scores_here_now", "long_name_with_under_scores here now", "long_name_with_under_scores here now"),
    ("", "", ""),
]


def test_counters(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(COUNTERS)], "i int, s string")
    (nl, ml), (nr, mr) = text.counter_left(F.col("s")), text.counter_right(F.col("s"))
    got = df.select("i", nl, ml, nr, mr, text.subject_base(F.col("s"))).collect()
    for i, a, b, c, d, base in got:
        assert ((a, b), (c, d), base) == COUNTERS[i][1:], COUNTERS[i][0]


def test_collection_names(spark):
    df = spark.createDataFrame([(i, n[0]) for i, n in enumerate(NAMES)], "i int, s string")
    for i, plain, term in df.select("i", text.collection_name(F.col("s")), text.collection_name(F.col("s"), "ubuntu%iso")).collect():
        assert (plain, term) == NAMES[i][1:], NAMES[i][0]


@pytest.mark.parametrize("given, wanted", [("<a@b>", "a@b"), ("<a", "<a"), ("<>", ""), (" <x> ", "x"), ("", ""), (None, "")])
def test_message_id_text(spark, given, wanted):
    assert spark.createDataFrame([(given,)], "m string").select(text.message_id_text(F.col("m"))).first()[0] == wanted


def test_file_names(spark):
    df = spark.createDataFrame([("ab£ c²_-x/漢", "")], "p string, c string")
    assert df.select(text.file_base(F.col("p"), F.col("c"))).first()[0] == "ab_ c²_-x_漢_misc"


def test_clean_text():
    assert text.clean_text("a\ud800b") == "ab" and text.clean_text(None) is None and text.clean_text(3) == 3
