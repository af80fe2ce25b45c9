"""The queries over dates read every written form."""

from datetime import UTC, datetime, timedelta

import pytest

import __spark_entry__ as entry

ASOF = datetime(2024, 3, 1, tzinfo=UTC)


@pytest.fixture
def articles(spark, tmp_path):
    def write(rows):
        cols = "ord bigint, group_name string, artnum bigint, date_utc string"
        spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/articles.parquet")
        return str(tmp_path)

    return write


def at(days):
    return ASOF - timedelta(days=days)


def test_ages_of_all_forms(spark, articles):
    t = at(300)
    forms = [t.strftime("%Y-%m-%dT%H:%M:%S+00:00"), t.strftime("%a, %d %b %y %H:%M GMT"), str(int(t.timestamp())), t.strftime("%Y-%m-%d %H:%M:%S Europe/London"), "garbage", None]
    want = {0: 300.0, 1: 300.0, 2: 300.0, 3: 300.0 + 1 / 24}  # London is an hour ahead in May
    got = {r["ord"]: r["age"] for r in entry.queries()["age_days"](spark, articles([(i, "g", i, d) for i, d in enumerate(forms)])).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.001 for k in want)


def test_bounds_over_all_forms(spark, articles):
    iso = lambda d: at(d).strftime("%Y-%m-%dT%H:%M:%S+00:00")
    mail = lambda d: at(d).strftime("%a, %d %b %Y %H:%M:%S GMT")
    epoch = lambda d: str(int(at(d).timestamp()))
    rows = [
        ("wider", 1, mail(500)), ("wider", 2, mail(390)), ("wider", 5, iso(350)), ("wider", 7, iso(250)), ("wider", 9, epoch(210)), ("wider", 11, epoch(100)),
        ("gained", 3, mail(300)), ("gained", 4, epoch(10)), ("gained", 6, iso(20)),
        ("none", 1, iso(500)), ("none", 2, mail(450)), ("unread", 1, "garbage"),
    ]
    got = {tuple(r) for r in entry.queries()["date_boundaries"](spark, articles([(i, *r) for i, r in enumerate(rows)])).collect()}
    assert got == {("wider", 2, 9, 390.0, 210.0), ("gained", 3, 3, 300.0, 300.0)}


def test_mail_dates_of_all_spellings(spark, articles):
    cases = {
        "Mon, 01 Feb 2021 01:12:32 +0100": "2021-02-01T00:12:32+00:00",
        "Tue, 02 Feb 2021 04:53:31 GMT": "2021-02-02T04:53:31+00:00",
        "Sun, 31 Jan 21 20:10 EDT": "2021-02-01T00:10:00+00:00",
        "2 Feb 2021 19:55 EST": "2021-02-03T00:55:00+00:00",
        "Wed, 03 Feb 2021 09:53:36 +0100 (CET)": "2021-02-03T08:53:36+00:00",
        "3 Feb 2021 09:53:36": "2021-02-03T08:53:36+00:00",
        "13. Februar 2021 09:07:13 +0545": "2021-02-13T03:22:13+00:00",
        "Mon Feb  1 01:15:48 2021": "2021-02-01T00:15:48+00:00",
        "Mon, 32 Jan 2023 10:00:00 GMT": None,
        "13 Foo 2021 11:22:33 GMT": None,
    }
    texts = [*cases, "2021-02-01T02:52:06+01:00", "1612164572", "garbage", "", None]
    got = {texts[r["ord"]]: r["iso"] for r in entry.queries()["to_iso"](spark, articles([(i, "g", i, d) for i, d in enumerate(texts)])).collect()}
    rest = {"2021-02-01T02:52:06+01:00": "2021-02-01T01:52:06+00:00", "1612164572": "2021-02-01T07:29:32+00:00", "garbage": None, "": None, None: None}
    assert got == cases | rest
