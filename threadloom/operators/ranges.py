"""Article ranges: chunk plans, ages, and bounds by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plan_chunks(lo: int, hi: int, limit: int = 0, chunk: int = 100_000) -> list[tuple[int, int]]:
    """Inclusive chunks from ``lo`` to ``hi``; a positive ``limit`` takes the oldest articles only."""
    if lo > hi:
        return []
    want = hi - lo + 1
    if 0 < limit < want:
        want = limit
    end = lo + want - 1
    return [(s, min(s + chunk - 1, end)) for s in range(lo, end + 1, chunk)]


def chunk_plan(groups: DataFrame, chunk: int, limit: int = 0) -> DataFrame:
    """``group_name, chunk_start, chunk_end`` for every catalog row (first_article, last_article)."""
    lo, hi = F.col("first_article"), F.col("last_article")
    end = F.least(hi, lo + limit - 1) if limit > 0 else hi
    full = groups.where("first_article IS NOT NULL AND last_article >= first_article").withColumn("__e", end)
    starts = full.select("group_name", "__e", F.explode(F.sequence(lo, F.col("__e"), F.lit(chunk).cast("bigint"))).alias("chunk_start"))
    return starts.select("group_name", "chunk_start", F.least(F.col("chunk_start") + chunk - 1, F.col("__e")).alias("chunk_end"))


def age_days(us: Column, asof_us: int) -> Column:
    """Days between an instant (microseconds) and ``asof_us``."""
    return (F.lit(asof_us) - us) / F.lit(86_400_000_000.0)


def date_bounds(df: DataFrame, group: str, number: str, us: str, min_days: float, max_days: float, asof_us: int) -> DataFrame:
    """Per group: the largest number at least ``min_days`` old and the smallest at most ``max_days`` old, ordered as ``lower, upper``, and the ages of both.

    Without such an article the group's first or last number stands in.  A group whose newest article is older than
    ``max_days``, or whose oldest is younger than ``min_days``, has no range and no row.  One pass, no point look-ups;
    exact also where numbers are missing.
    """
    rows = df.where(F.col(us).isNotNull() & F.col(number).isNotNull()).withColumn("__age", age_days(F.col(us), asof_us))
    # A bound with its age; of rows with one number the oldest date counts.
    at = F.struct(F.col(number).alias("n"), F.col("__age").alias("age"))
    low = F.struct(F.col(number).alias("n"), (-F.col("__age")).alias("age"))
    back = lambda s: F.struct(s["n"].alias("n"), (-s["age"]).alias("age"))
    out = rows.groupBy(group).agg(
        F.coalesce(F.max(F.when(F.col("__age") >= min_days, at)), back(F.min(low))).alias("a"),
        F.coalesce(back(F.min(F.when(F.col("__age") <= max_days, low))), F.max(at)).alias("b"),
        F.min("__age").alias("newest"), F.max("__age").alias("oldest"),
    )
    out = out.where((F.col("newest") <= max_days) & (F.col("oldest") >= min_days))
    swap = F.col("a.n") > F.col("b.n")
    ends = (F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b")))
    return out.select(group, ends[0]["n"].alias("lower"), ends[1]["n"].alias("upper"), ends[0]["age"].alias("lower_age"), ends[1]["age"].alias("upper_age"))


def resolve_range(settings, default: tuple[int, int], by_dates=None) -> tuple[int, int]:
    """The range to load: set numbers, else the range of the set ages (``by_dates(min, max)``), else ``default``."""
    lo, hi = settings.local_min, settings.local_max
    if lo and hi and 0 < lo < hi:
        return lo, hi
    a, b = settings.min_days, settings.max_days
    if by_dates and a and b and 0 < a < b:
        found = by_dates(a, b)
        if found:
            return min(found), max(found)
    return default


def next_range(spark: SparkSession, marks: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``group_name, lo, hi`` that an incremental load still has to fetch: after the high-water mark, up to the server's last article."""
    both = catalogue.select("group_name", "first_article", "last_article").join(marks, "group_name", "left")
    lo = F.when(F.coalesce("db_max", F.lit(0)) > 0, F.col("db_max") + 1).otherwise(F.col("first_article"))
    return both.select("group_name", lo.alias("lo"), F.col("last_article").alias("hi")).where("lo <= hi")
