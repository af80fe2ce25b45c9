"""Substring filters against the engine whose rules they follow."""

import sqlite3

import pytest

from threadloom.operators import filters

VALUES = ["ABC", "abc", "É", "é", "a\\b", "axb", "a_b", "100%", "", None, "xabcx", "a'b", "İ"]
TERMS = ["abc", "É", "é", "a\\b", "a_b", "%", "a%c", "_", "'"]


@pytest.mark.parametrize("term", TERMS)
def test_like(spark, term):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (i INTEGER, s TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?)", enumerate(VALUES))
    df = spark.createDataFrame(list(enumerate(VALUES)), "i int, s string")
    for spark_side, sql in ((filters.like(df.s, term), "s LIKE ?"), (~filters.like(df.s, term), "s NOT LIKE ?")):
        want = [r[0] for r in db.execute(f"SELECT i FROM t WHERE {sql} ORDER BY i", (f"%{term}%",))]
        assert [r[0] for r in df.where(spark_side).orderBy("i").collect()] == want


def test_options(spark):
    cols = "message_id string, subject string, from_addr string, date_utc string, bytes bigint, artnum bigint, group_name string"
    df = spark.createDataFrame([("m1", "red Ship part", "ann", None, 1, 1, "g"), ("m2", "ship", None, None, 1, 2, "g"), ("m3", "red boat", "bob", None, 1, 3, "h")], cols)
    ids = lambda **o: sorted(r[0] for r in filters.search(df, **o).collect())
    assert ids() == ids(subject_like="", not_from="", group=None) == ["m1", "m2", "m3"]
    assert ids(group="g") == ["m1", "m2"]
    assert ids(subject_like="ship%red") == [] and ids(subject_like="ship%red", terms=True) == ["m1"]
    assert ids(not_subject="boat | part") == ["m2"]
    assert ids(not_from="bob") == ["m1"], "NULL drops the row"
    assert ids(from_like="b") == ["m3"]
