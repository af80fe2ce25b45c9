"""Passages of evaluation items inside a training corpus, by a distributed positional inverted index.

Both sides are brought to the form of the look-alike operator, with one table of canonical words for the two, and
lower-cased; words are maximal runs of letters and digits.  The index is sharded by document: a segment holds the posting
lists of all terms of some thousands of documents (term, number of postings, positions as differences), and is one
row of a table in the shared folder.  It is built once, from one scan of the corpus, and serves any number of blocks of items;
a search meets every segment where it lies and moves no postings.

An item is searched from its rarest terms: every window of ``least`` consecutive words has a rarest
term, its anchor.  An anchor's posting list, shifted by the anchor's place in the item, gives candidate
alignments; they are intersected with the lists of the neighbouring terms, shifted by theirs,
outwards until one side no longer fits.  All candidates of a segment are looked up together, by binary search in its sorted
lists.  A passage of at least ``least`` words contains some window's
anchor at its place, so none is missed.  Rows with a NULL id are not searched.

Items are a stated query set.  They are taken in blocks of at most ``BLOCK`` items, so what travels with
the tasks is bounded.  NULL and empty texts, and items shorter than ``least`` words, have no passage.  Repeated
documents are reported each under their own id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.lookalike import canonical_text
from threadloom.session import written

#: Items searched at a time.
BLOCK = 10_000
#: Postings of a segment, about; a document is never cut.
SEGMENT = 1_000_000
_SEGMENT = "doc array<bigint>, length array<int>, term array<string>, size array<int>, step array<int>"
_MATCH = "doc bigint, item bigint, doc_pos int, item_pos int, n_words int"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, words -> segments of the index."""
    docs: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    words: list[pa.Array] = []
    held = 0

    def segment() -> pa.RecordBatch:
        coded = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
        tid = coded.indices.to_numpy().astype(np.int32)
        place = np.argsort(tid, kind="stable").astype(np.int64)
        size = np.bincount(tid, minlength=len(coded.dictionary))
        # Within a list positions rise: the first is given, then the steps between them.
        step = np.diff(place, prepend=0)
        first = np.cumsum(size) - size
        step[first] = place[first]
        cols = [np.concatenate(docs), np.concatenate(lengths).astype(np.int32), coded.dictionary, size.astype(np.int32), step.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c) if isinstance(c, np.ndarray) else c) for c in cols], names=["doc", "length", "term", "size", "step"])

    for b in batches:
        column = b.column(1)
        offsets = column.offsets.to_numpy().astype(np.int64)
        docs.append(b.column(0).to_numpy())
        lengths.append(np.diff(offsets))
        words.append(column.values.slice(offsets[0], offsets[-1] - offsets[0]))
        held += int(offsets[-1] - offsets[0])
        if held >= SEGMENT:
            yield segment()
            docs, lengths, words, held = [], [], [], 0
    if held:
        yield segment()


def build_index(canonical: DataFrame) -> DataFrame:
    """The written positional index of all terms of ``canonical`` (doc, canonical)."""
    tokens = canonical.select("doc", F.coalesce(words_of(F.col("canonical")), F.array().cast("array<string>")).alias("words"))
    return written(tokens.mapInArrow(_segments, _SEGMENT))


@dataclass(frozen=True)
class Items:
    """A block of items as arrays: ids, where each begins, and the term of every word."""

    ids: np.ndarray
    begins: np.ndarray
    words: np.ndarray
    terms: list[str]


def load_items(canonical: DataFrame) -> Items:
    """A block of items (item, canonical), at most ``BLOCK`` rows, on the driver."""
    rows = canonical.select("item", words_of(F.col("canonical")).alias("words")).where(F.col("words").isNotNull()).orderBy("item").collect()
    terms = sorted({w for r in rows for w in r["words"]})
    number = {t: i for i, t in enumerate(terms)}
    words = np.array([number[w] for r in rows for w in r["words"]], np.int32)
    begins = np.concatenate([[0], np.cumsum([len(r["words"]) for r in rows])]).astype(np.int64)
    return Items(np.array([r["item"] for r in rows], np.int64), begins, words, terms)


def frequencies(index: DataFrame, terms: list[str]) -> np.ndarray:
    """Postings of each of ``terms`` (those of a block of items) over the whole index."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for r in range(b.num_rows):
                at = pc.index_in(b.column(0).slice(r, 1).flatten(), value_set=pa.array(terms, pa.string()))
                there = at.is_valid().to_numpy(zero_copy_only=False)
                total[pc.drop_null(at).to_numpy()] += b.column(1).slice(r, 1).flatten().to_numpy()[there]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["tid", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in index.select("term", "size").mapInArrow(run, "tid bigint, n bigint").groupBy("tid").agg(F.sum("n").alias("n")).collect():
        out[r["tid"]] = r["n"]
    return out


def anchors(items: Items, frequency: np.ndarray, least: int) -> np.ndarray:
    """Places (in ``items.words``) of the rarest word, the earliest of equals, of every window of ``least`` words."""
    found = []
    for a, b in zip(items.begins[:-1], items.begins[1:]):
        if b - a >= least:
            windows = np.lib.stride_tricks.sliding_window_view(frequency[items.words[a:b]], least)
            found.append(a + np.arange(len(windows)) + windows.argmin(1))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def near_anchors(items: Items, frequency: np.ndarray, least: int, slack: int) -> np.ndarray:
    """Places of the ``slack + 1`` rarest words of every window of ``least + slack`` words: where ``slack`` words of it do not fit, one of these still does."""
    found = []
    for a, b in zip(items.begins[:-1], items.begins[1:]):
        if b - a >= least:
            windows = np.lib.stride_tricks.sliding_window_view(frequency[items.words[a:b]], min(least + slack, b - a))
            rarest = np.argsort(windows, axis=1, kind="stable")[:, : slack + 1]
            found.append((a + np.arange(len(windows))[:, None] + rarest).ravel())
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


class Segment:
    """One row of the index, read for a block of items: posting lists as one sorted array of (term, position) numbers."""

    def __init__(self, batch: pa.RecordBatch, row: int, items: Items) -> None:
        lists = [batch.column(i).slice(row, 1).flatten() for i in range(5)]
        self.doc, length, size = (lists[i].to_numpy() for i in (0, 1, 3))
        wanted = pc.index_in(pa.array(items.terms, pa.string()), value_set=lists[2])
        #: The number of every item term here, -1 where no document holds it.
        local = pc.fill_null(wanted, -1).to_numpy().astype(np.int64)
        self.word = local[items.words] if len(items.words) else np.zeros(0, np.int64)
        self.begins = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        step = lists[4].to_numpy().astype(np.int64)
        total = np.cumsum(step)
        before = total[self.starts[:-1]] - step[self.starts[:-1]]
        self.place = total - np.repeat(before, size)
        self.width = int(self.begins[-1]) + 1
        self.key = np.repeat(np.arange(len(size), dtype=np.int64) * self.width, size) + self.place

    def alignments(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, document and item place of every posting of the words at ``places``."""
        places = places[self.word[places] >= 0]
        term = self.word[places]
        size = self.starts[term + 1] - self.starts[term]
        posting = np.repeat(self.starts[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        at = self.place[posting]
        return at, np.searchsorted(self.begins, at, side="right") - 1, np.repeat(places, size)

    def within(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the list of ``term`` has a position from ``low`` to ``high``."""
        k = np.searchsorted(self.key, term * self.width + low)
        return (term >= 0) & (low <= high) & (self.key[np.minimum(k, len(self.key) - 1)] <= term * self.width + high) & (k < len(self.key))


def _matches(items: Items, places: np.ndarray, least: int):
    """Segments -> maximal common runs of at least ``least`` words."""
    item_of = np.repeat(np.arange(len(items.ids)), np.diff(items.begins))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s = Segment(batch, r, items)
                g, doc, w = s.alignments(places)
                item = item_of[w]
                reach = []
                for way in (1, -1):
                    steps = np.zeros(len(g), np.int32)
                    live, d = np.arange(len(g)), 1
                    while len(live):
                        x, y = g[live] + way * d, w[live] + way * d
                        inside = (x >= s.begins[doc[live]]) & (x < s.begins[doc[live] + 1]) & (y >= items.begins[item[live]]) & (y < items.begins[item[live] + 1])
                        live, x, y = live[inside], x[inside], y[inside]
                        live = live[s.within(s.word[y], x, x)]
                        steps[live] = d
                        d += 1
                    reach.append(steps)
                n = 1 + reach[0] + reach[1]
                good = np.flatnonzero(n >= least)
                if len(good):
                    at, first = doc[good], reach[1][good]
                    rows = np.unique(np.stack([s.doc[at], items.ids[item[good]], g[good] - first - s.begins[at], w[good] - first - items.begins[item[good]], n[good]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), *(pa.array(x.astype(np.int32)) for x in rows[2:])], names=["doc", "item", "doc_pos", "item_pos", "n_words"])

    return run


#: Anchors, and alignments of anchors, looked at together.
ANCHORS, ALIGNED = 1_000, 200_000


def _near(items: Items, places: np.ndarray, half: int, needed: int, slack: int, least: int):
    """Segments -> document, item and the number of words around an anchor that fit within ``slack`` positions of their place.

    A match has ``needed`` such words within ``half`` of the anchor, or ``least`` of them in some ``least + slack`` words around it.
    """
    item_of = np.repeat(np.arange(len(items.ids)), np.diff(items.begins))
    window = least + slack
    reach = max(half, window - 1)
    # A window around an anchor reaches so far on at least one side.
    inner = window // 2

    def fitting(s: Segment, g: np.ndarray, doc: np.ndarray, v: np.ndarray, offsets: Iterable[int]) -> np.ndarray:
        """A row of truth values per offset from the anchor."""
        item = item_of[v]
        begin, end, first, last = s.begins[doc], s.begins[doc + 1], items.begins[item], items.begins[item + 1]
        rows = []
        for i in offsets:
            y = v + i
            inside = (y >= first) & (y < last)
            wanted = np.where(inside, s.word[np.clip(y, 0, len(s.word) - 1)], -1)
            rows.append(s.within(wanted, np.maximum(g + i - slack, begin), np.minimum(g + i + slack, end - 1)))
        return np.array(rows, np.int8).reshape(len(rows), len(v))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s = Segment(batch, r, items)
                out = []
                for a in range(0, len(places), ANCHORS):
                    at, inside, w = s.alignments(places[a : a + ANCHORS])
                    for c in range(0, len(w), ALIGNED):
                        g, doc, v = (x[c : c + ALIGNED] for x in (at, inside, w))
                        mid = fitting(s, g, doc, v, range(-inner, inner + 1))
                        sides = np.maximum(mid[:inner].sum(0), mid[inner + 1 :].sum(0))
                        able = np.flatnonzero((sides >= inner - slack) | (mid.sum(0) + 2 * max(0, half - inner) >= needed))
                        g, doc, v = g[able], doc[able], v[able]
                        left, right = fitting(s, g, doc, v, range(-reach, -inner)), fitting(s, g, doc, v, range(inner + 1, reach + 1))
                        fits = np.concatenate([left, mid[:, able], right])
                        n = fits[reach - half : reach + half + 1].sum(0)
                        sums = np.concatenate([np.zeros((1, len(v)), np.int64), np.cumsum(fits, axis=0)])
                        most = (sums[reach + 1 : reach + 1 + window] - sums[reach + 1 - window : reach + 1]).max(0)
                        good = (n >= needed) | (most >= least)
                        out.append(np.stack([s.doc[doc[good]], items.ids[item_of[v[good]]], n[good]]))
                rows = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
                if rows.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32))], names=["doc", "item", "n"])

    return run


def _both_plain(documents: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``doc, canonical`` and ``item, canonical``: both sides in one form, with one table of canonical words."""
    sides = [(documents, doc_key, "d"), (items, item_key, "i")]
    rows = [df.where(F.col(f"`{key}`").isNotNull()).select(F.lit(name).alias("side"), F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")) for df, key, name in sides]
    both = rows[0].unionByName(rows[1]).withColumn("key", F.concat("side", "id"))
    plain = canonical_text(both, "key", "text", "canonical")
    return tuple(plain.where(F.col("side") == name).select(F.col("id").alias(as_), "canonical") for name, as_ in (("d", "doc"), ("i", "item")))


def _searches(documents: DataFrame, items: DataFrame, least: int, doc_key: str, item_key: str, text: str, places=anchors) -> Iterator[tuple[DataFrame, Items, np.ndarray]]:
    """The index, which all blocks share, and each block of items with its anchors."""
    docs, plain = _both_plain(documents, items, doc_key, item_key, text)
    index = build_index(docs)
    n = items.count() // BLOCK + 1
    for k in range(n):
        block = load_items(plain if n == 1 else plain.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k))
        yield index, block, places(block, frequencies(index, block.terms), least)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def passages(documents: DataFrame, items: DataFrame, least: int = 10, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """``doc, item, doc_pos, item_pos, n_words`` of every maximal common run of at least ``least`` words."""
    return _union([index.mapInArrow(_matches(block, places, least), _MATCH) for index, block, places in _searches(documents, items, least, doc_key, item_key, text)])


def leaked(documents: DataFrame, items: DataFrame, least: int = 10) -> DataFrame:
    """``doc_id, item_id``: documents that contain at least ``least`` consecutive words of an item."""
    return passages(documents, items, least).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def near_passages(documents: DataFrame, items: DataFrame, least: int = 10, half: int = 12, needed: int = 16, slack: int = 2) -> DataFrame:
    """Proximity matches: ``doc_id, item_id, n_words``, where at least ``needed`` of the ``2 half + 1`` words around an anchor stand within ``slack`` positions of their place, so some words may be missing, added or exchanged.

    Where fewer words lie around, ``least`` of ``least + slack`` consecutive words of the item are enough, so every exact passage of ``least`` words is among the matches.
    """
    places = partial(near_anchors, slack=slack)
    parts = [index.mapInArrow(_near(block, at, half, needed, slack, least), "doc bigint, item bigint, n int") for index, block, at in _searches(documents, items, least, "doc_id", "item_id", "text", places)]
    return _union(parts).groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max("n").alias("n_words"))
