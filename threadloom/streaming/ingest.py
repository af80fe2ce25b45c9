"""Continuous loading of a group: the overview source as a stream, inserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.operators.store import upsert_headers
from threadloom.schema import ARTICLES
from threadloom.sources.overview import register
from threadloom.sources.records import with_iso_dates


def read_stream(spark: SparkSession, **options: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("overview").options(**options).load()


def follow(spark: SparkSession, table: str, checkpoint: str, once: bool = True, **options: str):
    """Insert what is new into the Parquet table at ``table``; a batch that is run again adds nothing, since stored rows win."""

    def insert(batch: DataFrame, _: int) -> None:
        upsert_headers(with_iso_dates(batch.where("artnum IS NOT NULL").select(*ARTICLES.names)), table)

    writer = read_stream(spark, **options).writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
