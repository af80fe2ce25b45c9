"""Total order over a large table: places by range sort and partition offsets, never by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import checkpoint, tasks

#: Rows of a partition are numbered in the low bits of Spark's increasing id.
_LOW = (1 << 33) - 1


def numbered(df: DataFrame, by: list[Column], out: str = "place", within: list[str] | None = None) -> DataFrame:
    """``df`` with ``out``: the place (from 1) of every row in the order ``by``, or among the rows of its ``within`` values.

    ``by`` should order all rows totally (ties are numbered in any order) and begin with ``within``.  Rows are range-partitioned by ``by``, so a key with
    most of the rows is spread over many tasks; only one number per partition reaches the driver.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(tasks(spark), *by).sortWithinPartitions(*by).withColumn("__i", F.monotonically_increasing_id())
    placed = checkpoint(placed)
    part = F.shiftright("__i", 33)
    sizes = {r[0]: r[1] for r in placed.groupBy(part).count().collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    start = F.get(F.lit(before or [0]).cast("array<bigint>"), part.cast("int"))
    placed = placed.withColumn(out, start + F.col("__i").bitwiseAND(_LOW) + 1).drop("__i")
    if not within:
        return placed
    first = placed.groupBy(*within).agg((F.min(out) - 1).alias("__first"))
    # NULL is a value like others here.
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")) for c in within]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return placed.alias("l").join(first.alias("f"), cond).select(*[F.col(f"l.{c}") for c in placed.columns if c != out], (F.col(f"l.{out}") - F.col("__first")).alias(out))
