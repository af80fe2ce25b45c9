"""Articles in SQLite files, as earlier installations hold them, read in ranges of rows by many tasks."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from threadloom.schema import ARTICLES


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode=ro", uri=True)


def read(spark: SparkSession, paths: list[str], table: str = "articles", rows: int = 100_000) -> DataFrame:
    """The articles of all files (on a folder that all workers share); columns that a file lacks are NULL.

    A task reads ``rows`` row numbers of one file.  The driver asks each file for its bounds only.
    """
    name = '"' + table.replace('"', '""') + '"'
    ranges: list[tuple[str, int, int, str]] = []
    for path in paths:
        with _open(path) as c:
            have = {r[1].lower() for r in c.execute(f"PRAGMA table_info({name})")}
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {name}").fetchone()
        columns = ", ".join(f if f in have else f"NULL AS {f}" for f in ARTICLES.names)
        if low is not None:
            ranges += [(path, at, min(at + rows - 1, high), columns) for at in range(low, high + 1, rows)]
    kinds = [pa.int64() if f.dataType.simpleString() == "bigint" else pa.string() for f in ARTICLES]

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                c = _open(r["path"])
                try:
                    cursor = c.execute(f"SELECT {r['columns']} FROM {name} WHERE rowid BETWEEN ? AND ?", (r["low"], r["high"]))
                    while got := cursor.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(col, k) for col, k in zip(zip(*got), kinds)], names=ARTICLES.names)
                finally:
                    c.close()

    plan = spark.createDataFrame(ranges, "path string, low bigint, high bigint, columns string")
    return plan.repartition(max(1, len(ranges))).mapInArrow(load, ARTICLES)
