"""One key, thread or group with a third of all rows: whole results, and no task that holds them all."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators.hierarchy import thread_roots
from threadloom.operators.hotkeys import key_totals

N = 30_000


def rows_per_task(df):
    return [n for n in df.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()]


def test_hot_key_is_one_entry_per_split(spark):
    df = spark.range(0, N, 1, 6).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit(1).alias("a"), F.col("id").alias("t"))
    got = key_totals(df, "k", "a", "t")
    assert got.count() == N // 3 * 2 + 1
    assert tuple(got.where("key = 'hot'").first()) == ("hot", N // 3, N // 3, 0, N - 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, "the partial arrays are the only thing shuffled"


def test_hot_thread_is_cut_over_partitions(spark):
    df = spark.range(0, N, 1, 4).select(
        F.col("id").alias("ord"), F.format_string("<%d@h>", "id").alias("message_id"),
        F.when((F.col("id") < N // 3) & (F.col("id") > 0), F.format_string("<0@h> <%d@h>", F.floor(F.col("id") / 2))).alias("refs"),
    )
    got = thread_roots(df, bound=100)
    assert got.count() == N // 3 - 1 and got.where("root_id <> '<0@h>'").count() == 0
    assert got.agg(F.max("depth")).first()[0] == (N // 3 - 1).bit_length()


@pytest.mark.parametrize("parts", [1, 8])
def test_links_are_spread_evenly(spark, parts):
    links = spark.range(N).select(F.col("id").alias("node"), (F.col("id") / 2).cast("bigint").alias("top"), F.lit(1).alias("hops"), F.lit(0).alias("place"))
    sizes = rows_per_task(links.repartitionByRange(parts, "place", "node"))
    assert sum(sizes) == N and max(sizes) < 2 * N / parts
