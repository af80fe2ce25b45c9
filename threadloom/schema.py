"""Schemas of the stored tables and of the files that are read and written."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DataType, LongType, MapType, StringType, StructField, StructType, TimestampType

_KINDS: dict[str, DataType] = {"string": StringType(), "bigint": LongType(), "timestamp": TimestampType()}


def _struct(text: str) -> StructType:
    return StructType([StructField(n, _KINDS[k]) for n, k in (f.split() for f in text.split(", "))])


ARTICLES = _struct("message_id string, group_name string, artnum bigint, subject string, from_addr string, date_utc string, refs string, bytes bigint, lines bigint, xref string")
NEWSGROUPS = _struct("group_name string, first_article bigint, last_article bigint, article_count bigint, status_flag string, last_updated timestamp")
OVERVIEW = StructType([*_struct("group_name string, artnum bigint"), StructField("fields", MapType(StringType(), StringType()))])
NZB_FILE = StructType(
    [
        *_struct("_poster string, _date bigint, _subject string"),
        StructField("groups", StructType([StructField("group", ArrayType(StringType()))])),
        StructField("segments", StructType([StructField("segment", ArrayType(_struct("_bytes bigint, _number bigint, _VALUE string")))])),
    ]
)
