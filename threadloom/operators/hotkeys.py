"""Totals per key when a few keys hold most rows.

Keys are dictionary-encoded and summed in dense accumulator arrays: every input split, equal in
bytes, keeps one array per measure, indexed by its dictionary, and adds a batch with ``bincount`` or a
scatter-reduce.  A split hands on one entry per key it saw, so a key with a third of all rows costs the
shuffle as much per split as a key with one row.  Array blocks (keys by hash) are then added up by
a second distributed reduction of the same kind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.timestamps import with_utc_micros
from threadloom.session import checkpoint, tasks

#: A split hands its arrays on when its dictionary holds this many keys; memory per task is bounded by it.
DICTIONARY = 262_144
#: Keys of one array block, about; the number of blocks follows the number of entries.
BLOCK_KEYS = 65_536

_PARTIAL = "block int, key string, n_rows bigint, total bigint, first_us bigint, last_us bigint"
_BIG, _SMALL = np.iinfo(np.int64).max, np.iinfo(np.int64).min


class Accumulator:
    """Dense arrays of rows, total, least and greatest, indexed by a growing dictionary of keys (NULL is a key)."""

    def __init__(self) -> None:
        self.keys = pa.array([], pa.string())
        self.sums = np.zeros((2, 0), np.int64)
        self.low = np.zeros(0, np.int64)
        self.high = np.zeros(0, np.int64)

    def add(self, key: pa.Array, rows: np.ndarray | None, total: pa.Array, low: pa.Array, high: pa.Array) -> None:
        coded = pc.dictionary_encode(key, null_encoding="encode")
        local, index = coded.dictionary, coded.indices.to_numpy()
        k = len(local)
        place = pc.index_in(local, value_set=self.keys)
        new = place.is_null().to_numpy(zero_copy_only=False) if len(local) else np.zeros(0, bool)
        place = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        place[new] = len(self.keys) + np.arange(new.sum())
        if new.any():
            more = int(new.sum())
            self.keys = pa.concat_arrays([self.keys, local.filter(pa.array(new))])
            self.sums = np.pad(self.sums, ((0, 0), (0, more)))
            self.low = np.concatenate([self.low, np.full(more, _BIG)])
            self.high = np.concatenate([self.high, np.full(more, _SMALL)])
        add = np.zeros((2, k), np.int64)
        if rows is None:
            add[0] = np.bincount(index, minlength=k)
        else:
            np.add.at(add[0], index, rows)
        np.add.at(add[1], index, pc.fill_null(total, 0).to_numpy())
        self.sums[:, place] += add
        slot = place[index]
        np.minimum.at(self.low, slot, pc.fill_null(low, int(_BIG)).to_numpy())
        np.maximum.at(self.high, slot, pc.fill_null(high, int(_SMALL)).to_numpy())

    def columns(self) -> list[pa.Array]:
        return [
            self.keys, pa.array(self.sums[0]), pa.array(self.sums[1]),
            pa.array(self.low, mask=self.low == _BIG), pa.array(self.high, mask=self.high == _SMALL),
        ]


_NAMES = ["block", "key", "n_rows", "total", "first_us", "last_us"]


def _split_arrays(limit: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = Accumulator()
        for b in _gathered(batches):
            acc.add(b.column(0), None, b.column(1), b.column(2), b.column(2))
            if len(acc.keys) >= limit:
                yield from _emit(acc, None)
                acc = Accumulator()
        yield from _emit(acc, None)

    return run


def _gathered(batches: Iterable[pa.RecordBatch], rows: int = 524_288) -> Iterator[pa.RecordBatch]:
    """Arrow's small batches joined to larger ones, so that the dictionary is looked up less often."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _emit(acc: Accumulator, block: int | None) -> Iterator[pa.RecordBatch]:
    cols = acc.columns()
    for at in range(0, len(acc.keys), 20_000):
        part = [c.slice(at, 20_000) for c in cols]
        yield pa.RecordBatch.from_arrays([pa.array([block or 0] * len(part[0]), pa.int32()), *part], names=_NAMES)


def _add_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks arrive one after the other; one block's arrays are in memory at a time."""
    acc, block = Accumulator(), None
    for b in _gathered(batches):
        blocks = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if block is not None and blocks[i] != block:
                yield from _emit(acc, int(block))
                acc = Accumulator()
            block = blocks[i]
            p = b.slice(i, j - i)
            acc.add(p.column(1), p.column(2).to_numpy(), p.column(3), p.column(4), p.column(5))
    yield from _emit(acc, int(block or 0))


def key_totals(df: DataFrame, key: str, amount: str, micros: str, dictionary: int = DICTIONARY, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """``key, n_rows, total, first_us, last_us``: rows, sum of ``amount``, least and greatest ``micros`` of every key.

    NULL and the empty text are keys of their own.  NULL amounts count 0; a key without any ``micros``
    has NULL first and last.  Columns other than the three named are not read.  An empty table gives
    no rows.  The table is read once: the splits' entries are written, and their number bounds that of the keys of a block.
    """
    return _added(_entries(df, key, amount, micros, dictionary), block_keys)


def _entries(df: DataFrame, key: str, amount: str, micros: str, dictionary: int = DICTIONARY) -> DataFrame:
    """One entry per key and split, as a table of their own."""
    # Aliases keep the columns apart when two roles share one source column or clash in case.
    rows = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{amount}`").cast("bigint").alias("a"), F.col(f"`{micros}`").cast("bigint").alias("t"))
    return checkpoint(rows.mapInArrow(_split_arrays(dictionary), _PARTIAL))


def _added(entries: DataFrame, block_keys: int = BLOCK_KEYS) -> DataFrame:
    n = tasks(entries.sparkSession)
    blocks = max(n, entries.count() // block_keys + 1)
    placed = entries.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    whole = placed.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_add_blocks, _PARTIAL)
    return whole.drop("block")


def poster_totals(articles: DataFrame) -> DataFrame:
    """``from_addr, n_rows, total_bytes, first_us, last_us`` of every poster (values of ``from_addr`` compared exactly)."""
    dated = with_utc_micros(articles.select("from_addr", "bytes", "date_utc"), "date_utc", "utc_us")
    return key_totals(dated, "from_addr", "bytes", "utc_us").select(
        F.col("key").alias("from_addr"), "n_rows", F.col("total").alias("total_bytes"), "first_us", "last_us"
    )


def heavy_posters(articles: DataFrame, share: float = 0.03) -> DataFrame:
    """``from_addr`` of every poster with a non-empty value that holds at least ``share`` of all rows."""
    counted = articles.select("from_addr", F.lit(0).cast("bigint").alias("bytes"), F.lit(None).cast("bigint").alias("us"))
    entries = _entries(counted, "from_addr", "bytes", "us")
    rows = entries.agg(F.sum("n_rows")).first()[0] or 0
    return _added(entries).where((F.col("n_rows") >= F.lit(share) * rows) & (F.col("key") != "")).select(F.col("key").alias("from_addr"))
