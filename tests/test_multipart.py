import random

import pytest

from threadloom.operators import multipart, naming

COLS = "message_id string, subject string, from_addr string, date_utc string, bytes bigint, artnum bigint, group_name string"


def posts(spark, subjects, poster="p"):
    return spark.createDataFrame([(f"<{i}>", s, poster, None, 10, i, "g") for i, s in enumerate(subjects)], COLS)


@pytest.mark.parametrize(
    "m, parts, kept",
    [(3, [1, 2, 3], True), (3, [1, 2], False), (3, [1, 2, 2], False), (3, [1, 2, 3, 3], True), (3, [0, 1, 2, 3], True), (0, [0], True), (2_000_000_000, [1], False)],
)
def test_complete(spark, m, parts, kept):
    df = posts(spark, [f"x ({n}/{m})" for n in parts])
    assert (multipart.emitted(df, ["group_name"], True).count() == 1) == kept
    assert multipart.emitted(df, ["group_name"]).count() == 1


def test_right_wins_only_with_more_sets(spark):
    df = posts(spark, [f"[1/{10 + n}] name ({n}/3)" for n in (1, 2, 3)])
    assert tuple(multipart.strategy(df, []).first()) == (0, 1, True)
    assert multipart.emitted(df, ["group_name"], True).count() == 1
    tie = posts(spark, [f"[1/5] name ({n}/3)" for n in (1, 2, 3)])
    assert tuple(multipart.strategy(tie, []).first()) == (1, 1, False)


def test_programs_and_singles(spark):
    df = posts(spark, ["y.exe (1/1)", '"y.exe" (1/1)', "plain", None, "z (1/2)"])
    assert sorted(r["base"] for r in multipart.emitted(df, ["group_name"]).collect()) == ['"y.exe"', "z"]
    assert multipart.singles(df).count() == 2


def test_missing(spark):
    got = multipart.missing_ranges(posts(spark, ["a (1/4)", "a (3/4)", "b (1/1)"]), ["group_name"]).collect()
    assert sorted((r["base"], r["first_part"], r["last_part"]) for r in got) == [("a", 2, 2), ("a", 4, 4)]


def test_pickers_find_the_same_rows(spark):
    rng = random.Random(1)
    subjects = ["".join(rng.choice(["(1/2)", "[3/4]", "{5/6)", " part 1 of 2", "x", " ", "(a/b)", "yEnc"]) for _ in range(rng.randint(0, 6))) for _ in range(200)]
    bad = multipart.with_counters(posts(spark, subjects)).where("(m_left IS NULL) <> (m_right IS NULL)")
    assert bad.count() == 0


def test_file_numbers(spark):
    df = posts(spark, ["c (1/2)", "c? (1/2)", "c! (1/2)", "other.exe (1/1)"])
    named = naming.numbered_files(df)
    assert sorted(r["file_name"] for r in named.collect()) == ["p_c.nzb"]
    two = posts(spark, ["aa (1/1)"], "p/q").unionByName(posts(spark, ["aa (1/1)"], "p:q"))
    assert sorted(r["file_name"] for r in naming.numbered_files(two).collect()) == ["p_q_aa.nzb", "p_q_aa_2.nzb"]


def test_missing_ranges(spark, tmp_path):
    import __spark_entry__ as entry

    df = posts(spark, ["a (1/4)", "a (3/4)", "b (1/1)", "c (2/20000)", "c (2/20000)", "c (9/20000)", "c (20000/20000)", "d (7/5)", "e (1/2000000000)", "f (0/2)", "f (2/2)", "g (0/0)"])
    df.withColumn("ord", df["artnum"]).write.parquet(f"{tmp_path}/articles.parquet")
    got = {(r["base"], r["first_part"], r["last_part"]) for r in entry.queries()["missing_parts"](spark, str(tmp_path)).collect()}
    assert got == {("a", 2, 2), ("a", 4, 4), ("c", 1, 1), ("c", 3, 8), ("c", 10, 19999), ("d", 1, 5), ("e", 2, 2_000_000_000), ("f", 1, 1)}


def test_missing_ranges_hold_the_missing_parts(spark):
    rng = random.Random(2)
    counters = [(rng.choice("abcdef"), rng.randint(0, 12), rng.randint(1, 12)) for _ in range(150)]
    df = posts(spark, [f"{b} ({n}/{m})" for b, n, m in counters])
    sets = {(b, m) for b, _, m in counters}
    want = {(b, m, p) for b, m in sets for p in range(1, m + 1) if (b, p, m) not in counters}
    assert want == {(r["base"], r["m"], p) for r in multipart.missing_ranges(df, ["group_name"]).collect() for p in range(r["first_part"], r["last_part"] + 1)}
