"""Collections of posts by one poster, and the names of their manifest files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import collection_name, file_base
from threadloom.operators import multipart


def with_collection(df: DataFrame, term: str | None = None) -> DataFrame:
    """``df`` with poster and collection; as it is if it has them."""
    if {"poster", "collection"} <= set(df.columns):
        return df
    return df.withColumns({"poster": F.coalesce("from_addr", F.lit("")), "collection": collection_name(F.col("subject"), term)})


def collections(df: DataFrame, term: str | None = None) -> DataFrame:
    """``group_name, poster, collection, n_rows, first`` in the order of poster, subject, article number."""
    rows = with_collection(df, term)
    first = F.min(F.struct(F.coalesce("from_addr", F.lit("")), F.coalesce("subject", F.lit("")), "artnum"))
    return rows.groupBy("group_name", "poster", "collection").agg(F.count("*").alias("n_rows"), first.alias("first"))


def numbered(kept: DataFrame) -> DataFrame:
    """``kept`` (collections with something to emit, and their ``first``) with ``file_name``.

    The second file of a name in a group gets ``_2``, and so on, in collection order; names that collide with a natural
    ``_2`` stay so.
    """
    named = kept.withColumn("base_name", file_base(F.col("poster"), F.col("collection")))
    n = F.row_number().over(Window.partitionBy("group_name", "base_name").orderBy("first"))
    suffix = F.when(F.col("__n") > 1, F.concat(F.lit("_"), F.col("__n"))).otherwise("")
    return named.withColumn("__n", n).withColumn("file_name", F.concat("base_name", suffix, F.lit(".nzb"))).drop("__n", "base_name")


def numbered_files(df: DataFrame, term: str | None = None, require_complete: bool = False) -> DataFrame:
    """``group_name, poster, collection, file_name, n_sets`` of every collection that has a set to emit."""
    scope = ["group_name", "poster", "collection"]
    kept = multipart.emitted(with_collection(df, term), scope, require_complete).groupBy(*scope).agg(F.count("*").alias("n_sets"))
    return numbered(collections(df, term).join(kept, scope)).select(*scope, "file_name", "n_sets")
