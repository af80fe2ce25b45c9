"""A Spark data source of overview records: ``spark.read.format("overview")`` and ``readStream``.

Options: ``transport`` (``replay``, ``nntp``, or ``module:function`` giving a transport), ``path`` (replay: Parquet of group_name,
artnum, fields), ``host``, ``port``, ``username``, ``password``, ``timeout``, ``group`` (names, or ``*`` for all), ``start``, ``end``, ``chunk``,
``limit``, ``max_workers``, ``strict``, ``fail_on_error``; ``mode=groups`` gives the catalog instead of articles.
A partition is one chunk of article numbers, or several in turn where ``max_workers`` allows no more connections, and opens its own connection.  A chunk that fails fails its task, and so the
job, after Spark's retries; with ``fail_on_error=false`` it gives one row with NULL article number and the error in
``chunk_error`` instead, so nothing goes missing silently.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from contextlib import closing
from itertools import islice
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from threadloom.functions.text import clean_text
from threadloom.operators.ranges import plan_chunks

# The fields of an article and the record key that each is found by.
FIELDS = {"message_id": "message-id", "subject": "subject", "from_addr": "from", "date_utc": "date", "refs": "references", "bytes": "bytes", "lines": "lines", "xref": "xref"}
SCHEMA = "group_name string, artnum bigint, message_id string, subject string, from_addr string, date_utc string, refs string, bytes bigint, lines bigint, xref string, chunk_error string"
CATALOG = "group_name string, first_article bigint, last_article bigint, article_count bigint, status_flag string"


def key_map(keys: list[str]) -> dict[str, str]:
    """For every field the first key (by key order) that contains its name, case aside."""
    found = {}
    for field, name in FIELDS.items():
        hit = next((k for k in sorted(keys) if name in k.lower()), None)
        if hit is not None:
            found[field] = hit
    return found


def number(text: Any, strict: bool) -> int | None:
    if text in (None, ""):
        return 0
    try:
        return int(text)
    except ValueError:
        if strict:
            raise
        return None


def article(group: str, artnum: int, record: dict, strict: bool) -> tuple:
    keys = key_map(list(record))
    get = lambda f: clean_text(record.get(keys[f])) if f in keys else None
    return (
        group, int(artnum), get("message_id"), get("subject") or "", get("from_addr") or "", get("date_utc"), get("refs"),
        number(get("bytes"), strict), number(get("lines"), strict), get("xref"), None,
    )


class Replay:
    """A transport over recorded wire records in Parquet."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def _numbers(self, group: str | None = None) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        where = ds.field("artnum").is_valid()
        return ds.dataset(self.path).to_batches(columns=["group_name", "artnum"], filter=where if group is None else where & (ds.field("group_name") == group))

    def bounds(self, group: str) -> tuple[int, int, int]:
        """Count, first and last number; the file is read in batches, of which three numbers are kept."""
        count, first, last = 0, None, None
        for b in self._numbers(group):
            if b.num_rows:
                m = pc.min_max(b.column(1)).as_py()
                count, first, last = count + b.num_rows, min(x for x in (first, m["min"]) if x is not None), max(x for x in (last, m["max"]) if x is not None)
        return count, 1 if first is None else first, last or 0

    def groups(self) -> Iterator[tuple[str, int, int, str]]:
        known: dict[str, tuple[int, int]] = {}
        for b in self._numbers():
            for r in pa.table(b).group_by("group_name").aggregate([("artnum", "min"), ("artnum", "max")]).to_pylist():
                low, high = known.get(r["group_name"], (r["artnum_min"], r["artnum_max"]))
                known[r["group_name"]] = min(low, r["artnum_min"]), max(high, r["artnum_max"])
        for name in sorted(known):
            yield name, *known[name], "y"

    def close(self) -> None:
        """Nothing is held open."""

    def over(self, group: str, start: int, end: int) -> Iterator[tuple[int | None, dict]]:
        import pyarrow.dataset as ds

        here = (ds.field("group_name") == group) & (ds.field("artnum") >= start) & (ds.field("artnum") <= end)
        rows = ds.dataset(self.path).to_table(columns=["artnum", "fields"], filter=here).sort_by("artnum")
        for n, f in zip(rows["artnum"].to_pylist(), rows["fields"].to_pylist()):
            yield n, dict(f or [])


class Nntp:
    """A transport over one connection to a server."""

    def __init__(self, options: dict[str, str]) -> None:
        from threadloom.sources.nntp import Client

        self.client = Client(options["host"], int(options.get("port", "563")), options.get("username"), options.get("password"), float(options.get("timeout", "60")), options.get("tls", "true") != "false")

    def bounds(self, group: str) -> tuple[int, int, int]:
        return self.client.group(group)

    def over(self, group: str, start: int, end: int) -> Iterator[tuple[int | None, dict]]:
        self.client.group(group)
        yield from self.client.over(start, end)

    def groups(self) -> Iterator[tuple[str, int, int, str]]:
        return self.client.groups()

    def close(self) -> None:
        self.client.close()


def transport(options: dict[str, str]):
    name = options.get("transport", "replay")
    if name == "replay":
        return Replay(options)
    if name == "nntp":
        return Nntp(options)
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)(options)


class Chunks(InputPartition):
    """Chunks (group, first, last) that one task reads over one connection, in turn."""

    def __init__(self, chunks: list[tuple[str, int, int]]) -> None:
        self.chunks = chunks


def dealt(options: dict[str, str], chunks: list[tuple[str, int, int]]) -> list[InputPartition]:
    """A partition per chunk, or as many as there may be connections."""
    most = int(options.get("max_workers", "0")) or len(chunks)
    return [Chunks(chunks[k::most]) for k in range(min(most, len(chunks)))] or [Chunks([])]


def opened(options: dict[str, str]):
    line = transport(options)
    return closing(line) if hasattr(line, "close") else _Plain(line)


class _Plain:
    """A transport that has nothing to close."""

    def __init__(self, line: Any) -> None:
        self.line = line

    def __enter__(self) -> Any:
        return self.line

    def __exit__(self, *_) -> None:
        pass


def read_chunk(options: dict[str, str], line: Any, group: str, start: int, end: int) -> Iterator[tuple]:
    """The articles of one chunk.  Records without a number are dropped; every record is read by its own keys."""
    strict = options.get("strict", "false") == "true"
    for n, record in line.over(group, start, end):
        if n is not None and isinstance(record, dict):
            yield article(group, n, record, strict)


def group_names(options: dict[str, str]) -> list[str]:
    names = [g.strip() for g in options["group"].split(",") if g.strip()]
    if names == ["*"]:
        with opened(options) as line:
            return [g[0] for g in line.groups()]
    return names


def batches(options: dict[str, str], part: Chunks) -> Iterator[pa.RecordBatch]:
    """The records of a partition in batches as they come; an error ends the task, or is given as a row of its chunk."""
    tolerant = options.get("fail_on_error", "true") == "false"
    failed = lambda g, a, b, e: (g, *[None] * 9, f"{a}-{b}: {type(e).__name__}: {e}")
    for group, start, end in part.chunks:
        if not tolerant:
            with opened(options) as line:
                yield from _batched(read_chunk(options, line, group, start, end))
            continue
        try:
            with opened(options) as line:
                rows = list(read_chunk(options, line, group, start, end))  # a chunk is reported whole or as failed
        except Exception as e:
            rows = [failed(group, start, end, e)]
        yield from _batched(iter(rows))


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64() if n in ("artnum", "bytes", "lines") else pa.string() for n in names]
    while part := list(islice(rows, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)


class CatalogReader(DataSourceReader):
    """The groups of a server, as it lists them."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        with opened(self.options) as line:
            for name, first, last, flag in line.groups():
                yield name, first, last, last - first + 1, flag


class OverviewReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        out: list[tuple[str, int, int]] = []
        names = group_names(self.options)
        with opened(self.options) as line:
            for group in names:
                _, first, last = line.bounds(group)
                lo, hi = int(self.options.get("start") or 0) or first, int(self.options.get("end") or 0) or last
                out += [(group, s, e) for s, e in plan_chunks(lo, hi, int(self.options.get("limit", "0")), int(self.options.get("chunk", "100000")))]
        return dealt(self.options, out)

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        yield from batches(self.options, partition)


class OverviewStream(DataSourceStreamReader):
    """New articles of the groups; the offset holds the next article number of each.  A batch is read in chunks on the executors."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        start = int(self.options.get("start") or 0)
        return {g: start or self._bounds(g)[1] for g in group_names(self.options)}

    def latestOffset(self) -> dict:
        return {g: self._bounds(g)[2] + 1 for g in group_names(self.options)}

    def _bounds(self, group: str) -> tuple[int, int, int]:
        with opened(self.options) as line:
            return line.bounds(group)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        chunk = int(self.options.get("chunk", "100000"))
        return dealt(self.options, [(g, a, b) for g, to in end.items() for a, b in plan_chunks(start.get(g, 1), to - 1, 0, chunk)])

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        yield from batches(self.options, partition)


class OverviewSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "overview"

    def schema(self) -> str:
        return CATALOG if self.options.get("mode") == "groups" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (CatalogReader if self.options.get("mode") == "groups" else OverviewReader)(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return OverviewStream(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(OverviewSource)
