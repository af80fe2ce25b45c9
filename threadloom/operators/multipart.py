"""Multipart posts put together from the counters in their subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import counter_left, counter_right, subject_base


def with_counters(df: DataFrame) -> DataFrame:
    """``df`` with poster, base, n_left, m_left, n_right, m_right (NULL subject and poster count as empty); as it is if it has them."""
    if {"base", "n_left", "m_left", "n_right", "m_right"} <= set(df.columns):
        return df
    s = F.coalesce("subject", F.lit(""))
    (nl, ml), (nr, mr) = counter_left(s), counter_right(s)
    return df.withColumns({"poster": F.coalesce("from_addr", F.lit("")), "base": subject_base(s), "n_left": nl, "m_left": ml, "n_right": nr, "m_right": mr})


def singles(df: DataFrame) -> DataFrame:
    """Rows without a counter."""
    return with_counters(df).where("m_left IS NULL")


def strategy(df: DataFrame, scope: list[str]) -> DataFrame:
    """Per scope: how many sets of more than one row either picker forms, and which is taken.

    Both pickers find a counter in the same rows, so only these numbers decide; the right one must be greater.
    Rows are counted once per pair of totals before the two pickers part, so the table is read once.
    """
    parts = with_counters(df).where("m_left IS NOT NULL")
    small = parts.groupBy(*scope, "base", "poster", "m_left", "m_right").agg(F.count("*").alias("c"))
    both = F.array(F.struct(F.lit(False).alias("right"), F.col("m_left").alias("m")), F.struct(F.lit(True).alias("right"), F.col("m_right").alias("m")))
    sides = small.select(*scope, "base", "poster", "c", F.inline(both)).groupBy(*scope, "right", "base", "m", "poster").agg(F.sum("c").alias("c"))
    several = F.col("c") > 1
    out = sides.groupBy(*scope).agg(F.count_if(several & ~F.col("right")).alias("multi_left"), F.count_if(several & F.col("right")).alias("multi_right"))
    return out.withColumn("takes_right", F.col("multi_right") > F.col("multi_left"))


def assign_sets(df: DataFrame, scope: list[str]) -> DataFrame:
    """Rows with a counter, with ``n`` and ``m`` of the picker that their scope takes."""
    parts = with_counters(df).where("m_left IS NOT NULL")
    if scope:
        parts = parts.join(strategy(df, scope).select(*scope, "takes_right"), scope)
        right: Column = F.col("takes_right")
    else:
        right = F.lit(bool(strategy(df, []).first()["takes_right"]))
    return parts.withColumn("m", F.when(right, F.col("m_right")).otherwise(F.col("m_left"))).withColumn("n", F.when(right, F.col("n_right")).otherwise(F.col("n_left")))


def sets(df: DataFrame, scope: list[str], position: str = "artnum") -> DataFrame:
    """One row per set: scope, base, m, poster, rows, parts found of 1..m, first position, whether complete and whether dropped by name.

    The part number is always that of the last counter.  Repeated parts count as rows; the total is never expanded, so a wild
    total costs nothing.
    """
    rows = assign_sets(df, scope)
    keys = [*scope, "base", "m", "poster"]
    # First per part number, then per set: both levels combine before their shuffle, and no row is doubled for a distinct count.
    parts = rows.groupBy(*keys, "n_right").agg(F.count("*").alias("c"), F.min(position).alias("p"), F.sum(F.coalesce("bytes", F.lit(0))).alias("b"))
    found = F.count_if(F.col("n_right").between(1, F.col("m")))
    grouped = parts.groupBy(*keys).agg(F.sum("c").alias("n_rows"), found.alias("n_parts"), F.min("p").alias("first_pos"), F.sum("b").alias("total_bytes"))
    return grouped.withColumns(
        {
            "complete": (F.col("n_rows") >= F.col("m")) & (F.col("n_parts") == F.greatest(F.col("m"), F.lit(0))),
            "is_program": F.endswith(F.lower("base"), F.lit(".exe")),
        }
    )


def emitted(df: DataFrame, scope: list[str], require_complete: bool = False, position: str = "artnum") -> DataFrame:
    """The sets that a manifest holds."""
    out = sets(df, scope, position).where(~F.col("is_program"))
    return out.where("complete") if require_complete else out


def missing_ranges(df: DataFrame, scope: list[str]) -> DataFrame:
    """Missing part numbers of incomplete sets as ranges ``first_part, last_part``, exact for any total: the gaps between the distinct parts found."""
    rows = assign_sets(df, scope).where("m >= 1")
    keys = [*scope, "base", "m", "poster"]
    # A set with no part of 1..m keeps a row, with part 0.
    parts = rows.select(*keys, F.when(F.col("n_right").between(1, F.col("m")), F.col("n_right")).otherwise(0).cast("bigint").alias("part")).distinct()
    w = Window.partitionBy(*keys).orderBy("part")
    beside = parts.select(*keys, "part", F.lag("part", 1, 0).over(w).alias("__before"), F.lead("part").over(w).isNull().alias("__last"))
    gap = lambda lo, hi: F.struct(lo.alias("first_part"), hi.alias("last_part"))
    gaps = F.array_compact(F.array(gap(F.col("__before") + 1, F.col("part") - 1), F.when(F.col("__last"), gap(F.col("part") + 1, F.col("m")))))
    return beside.select(*keys, F.inline(gaps)).where("first_part <= last_part")
