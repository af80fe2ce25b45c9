"""Overview records that are already in a table (group_name, artnum, fields) as article rows, set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.timestamps import to_iso, with_utc_micros
from threadloom.sources.overview import FIELDS


def field(fields: Column, name: str) -> Column:
    """The value of the first key (by key order) that contains ``name``, case aside."""
    keys = F.array_sort(F.filter(F.map_keys(fields), lambda k: F.lower(k).contains(name)))
    return F.try_element_at(fields, F.get(keys, F.lit(0)))


def articles(records: DataFrame) -> DataFrame:
    """Article rows of ``records``; records without a number are dropped; unreadable sizes are NULL, missing ones 0."""
    got = {f: field(F.col("fields"), name) for f, name in FIELDS.items()}
    size = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit(0)).otherwise(F.trim(c).try_cast("bigint")).cast("bigint")
    return records.where("artnum IS NOT NULL").select(
        "group_name", "artnum", got["message_id"].alias("message_id"), F.coalesce(got["subject"], F.lit("")).alias("subject"), F.coalesce(got["from_addr"], F.lit("")).alias("from_addr"),
        got["date_utc"].alias("date_utc"), got["refs"].alias("refs"), size(got["bytes"]).alias("bytes"), size(got["lines"]).alias("lines"), got["xref"].alias("xref"),
    )


def with_iso_dates(rows: DataFrame, local_zone: str = "Europe/Berlin") -> DataFrame:
    """Article rows with ``date_utc`` in the stored form, NULL where the sender's text denotes no instant."""
    dated = with_utc_micros(rows, "date_utc", "__us", local_zone)
    return dated.withColumn("date_utc", to_iso(F.col("__us"))).select(*rows.columns)
