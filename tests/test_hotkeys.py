import random
from collections import Counter

from threadloom.operators.hotkeys import heavy_posters, key_totals, poster_totals

COLS = "key string, amount bigint, us bigint"


def brute(data):
    out = {}
    for k, a, u in data:
        n, t, lo, hi = out.get(k, (0, 0, None, None))
        out[k] = (n + 1, t + (a or 0), u if lo is None else lo if u is None else min(lo, u), u if hi is None else hi if u is None else max(hi, u))
    return out


def test_totals(spark):
    rng = random.Random(7)
    data = [(rng.choice([None, "", "hot", "hot", "hot", *[f"k{i}" for i in range(300)]]), rng.choice([None, 0, 5, -3, 10**12]), rng.choice([None, *range(50)])) for _ in range(5_000)]
    df = spark.createDataFrame(data, COLS).repartition(9)
    for options in ({}, {"dictionary": 10, "block_keys": 3}):
        got = {r[0]: tuple(r[1:]) for r in key_totals(df, "key", "amount", "us", **options).collect()}
        assert got == brute(data)


def test_posters(spark):
    data = [("a", 5, "2021-02-01T00:00:00Z"), ("a", None, "n/a"), ("A", 1, None), (None, 2, "1612307702"), ("", 3, "2021-02-02T00:00:00Z")]
    df = spark.createDataFrame([(*d, 1, 2) for d in data], "from_addr string, bytes bigint, date_utc string, key int, a int")
    got = {r[0]: tuple(r[1:]) for r in poster_totals(df).collect()}
    assert got == {"a": (2, 5, 1612137600000000, 1612137600000000), "A": (1, 1, None, None), None: (1, 2, 1612307702000000, 1612307702000000), "": (1, 3, 1612224000000000, 1612224000000000)}
    assert poster_totals(df.limit(0)).count() == 0 and heavy_posters(df.limit(0)).count() == 0


def test_heavy(spark):
    names = ["x"] * 30 + ["y"] * 3 + ["z"] * 2 + [None] * 33 + [""] * 32
    df = spark.createDataFrame([(n, 1, None) for n in names], "from_addr string, bytes bigint, date_utc string")
    assert Counter(r[0] for r in heavy_posters(df).collect()) == {"x": 1, "y": 1}
