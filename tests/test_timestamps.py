import random
from datetime import UTC, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from threadloom.functions.timestamps import with_utc_micros

BERLIN, NEW_YORK = ZoneInfo("Europe/Berlin"), ZoneInfo("America/New_York")


def us(*a, tz=UTC):
    t = datetime(*a, tzinfo=tz)
    if t.astimezone(UTC).astimezone(tz).replace(tzinfo=None) != t.replace(tzinfo=None):  # a skipped hour, read with the offset before it
        t = t.replace(fold=0)
    return round((t.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


CASES = {
    "2021-02-01T02:52:06+01:00": us(2021, 2, 1, 1, 52, 6),
    "2021-02-01 02:52:06.5": us(2021, 2, 1, 1, 52, 6, 500000),
    "2021-02-01T10:51:15.9736391+0545": us(2021, 2, 1, 5, 6, 15, 973639),
    "2021-03-28 02:42:31": us(2021, 3, 28, 1, 42, 31),  # skipped: forward by the jump
    "2021-10-31 02:30:00": us(2021, 10, 31, 0, 30),  # twice: the first
    "2021-11-07 01:31:40 America/New_York": us(2021, 11, 7, 5, 31, 40),
    "2021-03-14 02:30:00 America/New_York": us(2021, 3, 14, 7, 30),
    "Sun Oct 31 02:12:04 2021": us(2021, 10, 31, 0, 12, 4),
    "Mon, 1 Jan 24 12:34 EST": us(2024, 1, 1, 17, 34),
    "Mon, 01 Jan 2024 12:34:56 +0200 (CEST)": us(2024, 1, 1, 10, 34, 56),
    "1 Jan 2024 12:34:56 -0000": us(2024, 1, 1, 12, 34, 56),
    "1 Jan 2024 12:34:56 UT": us(2024, 1, 1, 12, 34, 56),
    "10. März 2021 02:21:41 +0200": us(2021, 3, 10, 0, 21, 41),
    "02.03.2021 11:00:18": us(2021, 3, 2, 10, 0, 18),
    "Feb 4, 2021 12:19:39 AM": us(2021, 2, 3, 23, 19, 39),
    "Feb 4, 2021 12:19:39 PM": us(2021, 2, 4, 11, 19, 39),
    "2021-02-04 00:48:05 CET": us(2021, 2, 3, 23, 48, 5),
    "2021-07-04 00:48:05 CEST": us(2021, 7, 3, 22, 48, 5),
    "20210201T190405Z": us(2021, 2, 1, 19, 4, 5),
    "1612307702": 1612307702_000000,
    "1612201456624": 1612201456624_000,
    "1612248898911141": 1612248898911141,
    "1612248898911141999": 1612248898911141,
    "29.02.2024 00:00": us(2024, 2, 28, 23, 0),
    "  2021-02-01T02:52:06Z  ": us(2021, 2, 1, 2, 52, 6),
    "1969-12-31T23:59:59Z": -1_000_000,
    "Mon, 01 Feb 2021 12:16:04 +0100 (" + "x" * 960 + ")": us(2021, 2, 1, 11, 16, 4),
    "Mon, 01 Feb 2021 12:16:04 +0100 (" + "x" * 200_000 + ")": us(2021, 2, 1, 11, 16, 4),
    " " * 1_001 + "2021-02-01T02:52:06Z" + " " * 100_000: us(2021, 2, 1, 2, 52, 6),
    "2021-02-01T02:52:06." + "5" * 1_000 + "Z": us(2021, 2, 1, 2, 52, 6, 555555),
}
NONE = [
    None, "", " ", "garbage", "n/a", "(none)", "13 Foo 2021 11:22:33 GMT", "2023-02-31T10:15:00Z", "2023-02-29 10:15:00", "0000-00-00 00:00:00", "2022-06-15T24:61:00+00:00",
    "2022-06-15T12:00:60Z", "Feb 4, 2021 13:19:39 PM", "2021-02-01 07:03:32 Mars/Phobos", "2021-02-01 07:03:32 XYZ", "2021-02-01", "9" * 20, "\u0001|", "2021-02-01T02:52:06+99:00", " " * 50_000, "1" * 500_000,
    "2021-02-01 02:52:06" + " " * 200_000 + "!", "2021-02-01 02:52:06 " + "a/" * 100_000, "Feb " * 100_000, "a" * 300_000,
]


def test_forms(spark):
    texts = [*CASES, *NONE]
    df = with_utc_micros(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "u")
    got = {texts[r["i"]]: r["u"] for r in df.collect()}
    assert {t: got[t] for t in CASES} == CASES
    assert not [t for t in NONE if got[t] is not None]


def test_local_times_around_clock_changes(spark):
    rng = random.Random(3)
    walls = [datetime(2023, 3, 26, 0) + timedelta(minutes=rng.randrange(360)) for _ in range(60)] + [datetime(2023, 10, 29, 0) + timedelta(minutes=rng.randrange(360)) for _ in range(60)]
    df = with_utc_micros(spark.createDataFrame([(i, w.strftime("%Y-%m-%d %H:%M:%S")) for i, w in enumerate(walls)], "i int, t string"), "t", "u")
    for r in df.collect():
        want = walls[r["i"]].replace(tzinfo=BERLIN, fold=0).astimezone(UTC)
        assert r["u"] == round(want.timestamp() * 1_000_000), walls[r["i"]]


def test_random_dates(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        t = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=rng.randrange(0, 4_000_000_000))
        z = t.astimezone(timezone(timedelta(minutes=rng.choice([-720, -210, 0, 60, 345, 840]))))
        form = rng.choice(["%a, %d %b %Y %H:%M:%S %z", "%Y-%m-%dT%H:%M:%S%z", "%d %b %Y %H:%M:%S %z", "%Y-%m-%d %H:%M:%S %z", "%d.%m.%Y %H:%M:%S %z"])
        rows.append((i, z.strftime(form), int(t.timestamp()) * 1_000_000))
    df = spark.createDataFrame(rows, "i int, t string, want bigint")
    assert with_utc_micros(df, "t", "u").where("u IS DISTINCT FROM want").count() == 0


def test_other_columns(spark):
    df = spark.createDataFrame([("2021-02-01T00:00:00Z", 1, "x", None)], "t string, u int, __ts string, `a.b` string")
    got = with_utc_micros(df, "t", "u")
    assert got.columns == ["t", "__ts", "a.b", "u"] and got.first()["u"] == us(2021, 2, 1)
    assert with_utc_micros(df.limit(0), "t", "u").count() == 0


@pytest.mark.parametrize("zone, want", [("UTC", us(2021, 7, 1, 12)), ("America/New_York", us(2021, 7, 1, 16))])
def test_host_zone(spark, zone, want):
    df = spark.createDataFrame([("2021-07-01 12:00:00",)], "t string")
    assert with_utc_micros(df, "t", "u", zone).first()["u"] == want


def test_plan_is_one_stage(spark):
    df = spark.createDataFrame([("x",)], "t string")
    plan = with_utc_micros(df, "t", "u").where(F.col("u").isNotNull())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("split(regexp_replace(t#") == 1, "the long pattern is read once a row"
