"""Stored articles and catalog: first-wins insertion, high-water marks, replacement of catalog rows, archives."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.schema import ARTICLES
from threadloom.session import tasks

#: Groups of a batch up to which their names are looked up first, so that only their stored rows are read.
NAMED = 10_000


def first_wins(df: DataFrame, keys: tuple[str, ...] = ("group_name", "message_id"), order: str = "ord") -> DataFrame:
    """One row per key, the one with the least ``order``; rows with a NULL message id are all kept.

    Rows with a NULL group or article number are dropped, as the table's constraints demand.
    """
    sound = df.where("group_name IS NOT NULL AND artnum IS NOT NULL")
    ranked = sound.where("message_id IS NOT NULL").withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    # The NULL branch is apart, so that the window keeps only the first row of a key while it sorts.
    return ranked.where("__n = 1").drop("__n").unionByName(sound.where("message_id IS NULL"))


def insert_or_ignore(existing: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("group_name", "message_id"), order: str = "ord") -> DataFrame:
    """The rows of ``batch`` that an insertion adds to ``existing``: stored rows win, then the first of the batch.

    Of a table partitioned by group only the batch's groups are read, and of those only the keys.
    """
    new = first_wins(batch, keys, order)
    stored = existing.select(*keys)
    if "group_name" in keys:
        groups = [r[0] for r in batch.select("group_name").distinct().limit(NAMED + 1).collect()]
        if len(groups) <= NAMED:  # else the join alone decides; the rows are the same
            stored = stored.where(F.col("group_name").isin([g for g in groups if g is not None]))
    return new.join(stored, list(keys), "left_anti").select(*batch.columns)


def ensure_tables(spark: SparkSession, database: str = "default") -> None:
    """The two tables, made if they are not there."""
    articles = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ARTICLES if f.name != "group_name")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.articles ({articles}, group_name string) USING parquet PARTITIONED BY (group_name)")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {database}.newsgroups (group_name string, first_article bigint, last_article bigint, article_count bigint, status_flag string, last_updated timestamp) USING parquet"
    )


def upsert_headers(batch: DataFrame, path: str, group: str | None = None, order: str = "artnum") -> dict[str, float]:
    """Insert ``batch`` into the Parquet table at ``path``, partitioned by group and sorted by article number.

    ``group``: the group that all rows get, whatever they say.  Returns ``rows`` and ``bytes`` added, and ``seconds``.
    """
    if group is not None:
        batch = batch.withColumn("group_name", F.lit(group))
    try:
        new = insert_or_ignore(stored_articles(batch.sparkSession, path), batch, order=order)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing stored yet
            raise
        new = first_wins(batch, order=order)
    # Counted while they are written; an empty insertion sees no partition and so reports nothing.
    seen, began = Observation(), time.perf_counter()
    size = F.col("bytes") if "bytes" in new.columns else F.lit(0)
    counted = _spread(new).observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    counted.write.mode("append").partitionBy("group_name").parquet(path)
    return {"rows": 0, "bytes": 0} | seen.get | {"seconds": time.perf_counter() - began}


def stored_articles(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``.  Group names stay text, also where all of them look like numbers."""
    known = spark.read.parquet(path)
    schema = known.schema
    schema["group_name"].dataType = ARTICLES["group_name"].dataType
    return spark.read.schema(schema).parquet(path)


def _spread(df: DataFrame) -> DataFrame:
    """Ranges of group and article number: a group with most of the rows is written by many tasks, small ones share one."""
    return df.repartitionByRange(tasks(df.sparkSession), "group_name", "artnum").sortWithinPartitions("group_name", "artnum")


def reload(df: DataFrame, path: str, order: str = "artnum") -> None:
    """Replace the groups of ``df`` in the table at ``path`` entirely."""
    _spread(first_wins(df, order=order)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group_name").parquet(path)


def high_water(articles: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``group_name, db_max, db_min`` of every stored group, or of every group of ``groups`` (0 and 0 where nothing is stored)."""
    marks = articles.groupBy("group_name").agg(F.max("artnum").alias("db_max"), F.min("artnum").alias("db_min"))
    if groups is not None:
        marks = groups.select("group_name").distinct().join(marks, "group_name", "left")
    return marks.select("group_name", F.coalesce("db_max", F.lit(0)).cast("bigint").alias("db_max"), F.coalesce("db_min", F.lit(0)).cast("bigint").alias("db_min"))


def article_count(first: Column, last: Column) -> Column:
    """Articles that a catalog line promises; an empty group (last before first) has none."""
    return F.when(first.isNotNull() & last.isNotNull(), last - first + 1).otherwise(0).cast("bigint")


def replace_groups(old: DataFrame, new: DataFrame, asof: Column) -> DataFrame:
    """The catalog after lines of ``new`` replaced those of ``old``; the last line of a group in ``new`` (column ord) wins."""
    fresh = new.withColumn("__p", F.lit(1)).withColumn("last_updated", asof)
    kept = old.withColumn("__p", F.lit(0)).withColumn("ord", F.lit(0).cast("bigint"))
    cols = ["group_name", "first_article", "last_article", "article_count", "status_flag", "last_updated"]
    both = kept.select(*cols, "__p", "ord").unionByName(fresh.select(*cols, "__p", "ord"))
    w = Window.partitionBy("group_name").orderBy(F.desc("__p"), F.desc("ord"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*cols)


def archive(df: DataFrame, path: str) -> None:
    """One JSON object per line, NULL fields included; what was at ``path`` is replaced."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_archive(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """An archive of lines, or a file that is one JSON array."""
    return spark.read.schema(ARTICLES).option("multiLine", array).json(path)
