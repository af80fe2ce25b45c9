"""Queries of the text operators by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import leakage, lookalike, mixing, mojibake, neardup, oracle

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.damaged_fields(_table(spark, sf_dir, "articles"))


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restored_fields(_table(spark, sf_dir, "articles"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_rows(neardup.advertisements(_table(spark, sf_dir, "articles")), 0.6)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(neardup.advertisements(_table(spark, sf_dir, "articles")), 0.6)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.near_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture as large as all targeted sources: scarce ones are repeated up to their cap and may run short."""
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p8_mix_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mixture in which every source meets its share."""
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"), mixing.EXACT)


def p8_shares_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"), mixing.EXACT)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.kinds_found(_table(spark, sf_dir, "documents"))


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical_text(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "canonical")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_restored, p3_found, p3_groups, p7_found, p7_near, p8_mix, p8_shares, p8_mix_exact, p8_shares_exact, p9_found, p9_canonical)}


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
