"""Records that are nearly the same: a distributed similarity join on word sets with count-vector R-trees.

Equal word sets are one class, so copies are searched once.  The words of a set are hashed into groups;
the counts per group are a point.  For two points the sum over all groups of the smaller count
bounds the number of common words from above, and so does the sum against the greatest
counts of a tree node for every point below it.

The tree's first level are slabs of some hundreds of points: with the words put in order from rare to frequent, two sets
similar enough share one of their first few words, so a set enters only the slabs of those.  A slab with very many points is
cut into blocks, and each pair of blocks is a cell of its own, so no task holds an unbounded slab.  Every cell is
packed into an R-tree, whose nodes hold the greatest count of each of ``COORDS`` coordinates, and is searched with all
its points; a node is entered only if its bound reaches the overlap that the threshold needs, and so is every point of a leaf: no
candidate leaves the tree without its summed minima.  Pairs that survive are verified on their words (64-bit hashes of
them), and a pair is reported only in the slab of its first common word, hence once.  Sets of very many words would be carried
into very many slabs; they enter them with their counts alone, are bounded like the others, and pairs with them are verified by joining
the words back.

Nothing is dropped: there are no caps on slabs, candidates or partners.  A record without words, or with a NULL number, is similar to none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import checkpoint, tasks, written

#: Word groups that words are put in order by; the histogram over them (one number each) is the only thing that goes to the driver.
GROUPS = 1 << 18
#: Coordinates of a point: each counts the words of several groups.
COORDS = 512
#: Points of a slab, about.
SLAB = 256
#: Points of one block of a slab.
BLOCK = 2_048
#: Children of a tree node, and points of a leaf.
FAN = 16
#: Sets with more words enter their slabs with their counts instead; pairs with such a set are verified by a join.
LONG = 64
_ENTRY = "cell bigint, slab int, block int, place int, size int, id bigint, words array<bigint>, counts array<int>"
_PAIR = "a bigint, b bigint, sure boolean"


def ad_words(subject: Column, sender: Column) -> Column:
    """The distinct words (runs of a-z and 0-9) of subject and sender, lower-cased; NULL counts as empty."""
    text = F.lower(F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(sender, F.lit(""))))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))))


def _up(x: Fraction) -> int:
    return -((-x.numerator) // x.denominator)


class Rule:
    """Whole-number consequences of a similarity threshold, by set size."""

    def __init__(self, threshold: float) -> None:
        self.t = Fraction(str(threshold))

    def probe(self, n: int) -> int:
        """Words, from the rarest, of which one must be shared with any similar set."""
        return n - _up(self.t * n) + 1

    def index(self, n: int) -> int:
        """The same against sets that are not smaller."""
        return n - _up(2 * self.t / (1 + self.t) * n) + 1

    def need(self, total: np.ndarray) -> np.ndarray:
        """Common words that two sets with ``total`` words together must have."""
        a = self.t / (1 + self.t)
        return -((-total.astype(np.int64) * a.numerator) // a.denominator)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.int64), offsets - offsets[0]


def _rarest_first(values: np.ndarray, offsets: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    group = values & (GROUPS - 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return values[np.lexsort((values, group, frequency[group], row))]


def _entries(frequency: np.ndarray, rule: Rule, slabs: int):
    """id, words -> one entry per slab that the set enters, its words rarest first."""

    def run(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        values, offsets = _lists(b.column(1))
        values = _rarest_first(values, offsets, frequency)
        size = np.diff(offsets)
        most = int(size.max(initial=0))
        prefix = np.array([rule.probe(n) for n in range(most + 1)])[size] if len(size) else np.zeros(0, np.int64)
        prefix[size == 0] = 0
        row = np.repeat(np.arange(len(size)), prefix)
        place = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
        slab = values[offsets[:-1][row] + place] & (slabs - 1)
        # Two words of one slab: it is entered once, by the earlier word.
        _, first = np.unique(row * np.int64(slabs) + slab, return_index=True)
        first.sort()
        return row[first], place[first], slab[first], values, offsets

    return run


def _slab_counts(frequency: np.ndarray, rule: Rule):
    entries = _entries(frequency, rule, GROUPS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(GROUPS, np.int64)
        for b in batches:
            n += np.bincount(entries(b)[2], minlength=GROUPS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slab", "n"])

    return run


def _counted(values: np.ndarray, row: np.ndarray, n: int, kind: type) -> np.ndarray:
    """Count vectors of ``n`` sets; ``row`` says to which set each value belongs."""
    count = np.zeros((n, COORDS), kind)
    np.add.at(count.ravel(), row * np.int64(COORDS) + (values & (COORDS - 1)), 1)
    return count


def _cells(frequency: np.ndarray, rule: Rule, points: np.ndarray, block: int):
    """id, words -> entries placed in cells: (slab, block, block), a number made of the three."""
    entries = _entries(frequency, rule, len(points))
    blocks = np.maximum(-(-points // block), 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, place, slab, values, offsets = entries(b)
            size = np.diff(offsets)
            far = size > LONG
            kept = np.repeat(~far, size)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(far, 0, size))]).astype(np.int32)), pa.array(values[kept]))
            long_row = np.repeat(np.cumsum(far) - 1, size)[~kept]
            count = _counted(values[~kept], long_row, int(far.sum()), np.int32)
            counts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(far, COORDS, 0))]).astype(np.int32)), pa.array(count.ravel()))
            ids = b.column(0).to_numpy()[row]
            nb = blocks[slab]
            own = ((ids * np.int64(-7046029254386353131)) >> 33) % nb
            ends = np.cumsum(nb)
            # An entry is copied once per block of its slab; so many copies at a time are made.
            for at in range(0, int(ends[-1]) if len(ends) else 0, 4_096):
                copy = np.arange(at, min(at + 4_096, int(ends[-1])))
                rep = np.searchsorted(ends, copy, side="right")
                other = copy - (ends[rep] - nb[rep])
                low, high = np.minimum(own[rep], other), np.maximum(own[rep], other)
                cell = (slab[rep].astype(np.int64) << 44) | (low << 22) | high
                of = pa.array(row[rep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), *(pa.array(x[rep].astype(np.int32)) for x in (slab, own, place)), pa.array(size[row[rep]].astype(np.int32)), pa.array(ids[rep]), lists.take(of), counts.take(of)],
                    names=["cell", "slab", "block", "place", "size", "id", "words", "counts"],
                )

    return run


class Points:
    """The entries of some whole cells as arrays; words padded to equal width.

    ``tested`` counts the nodes and points whose summed minima were taken, ``passed`` the pairs that reached verification.
    """

    def __init__(self, t: pa.Table, rule: Rule, slabs: int) -> None:
        self.rule, self.slabs = rule, slabs
        self.cell, self.slab, self.block, self.place, self.size, self.id = (t.column(i).to_numpy() for i in range(6))
        self.values, self.offsets = _lists(t.column(6).combine_chunks())
        self.size, held = self.size.astype(np.int64), np.diff(self.offsets)
        # Two points of one block meet in the cell of that block with itself only.
        self.mixed = (self.cell >> 22) & 0x3FFFFF != self.cell & 0x3FFFFF
        self.width = int(held.max(initial=1))
        index = np.array([rule.index(n) if n else 0 for n in range(int(self.size.max(initial=0)) + 1)])
        self.indexed = self.place < index[self.size]
        at = self.offsets[:-1, None] + np.arange(self.width)
        self.pad = np.arange(self.width) < held[:, None]
        self.words = np.where(self.pad, self.values[np.minimum(at, max(0, len(self.values) - 1))], 0) if len(self.values) else np.zeros((len(self.id), self.width), np.int64)
        far = np.flatnonzero(self.size > LONG)
        self.count = _counted(self.values, np.repeat(np.arange(len(self.id)), held), len(self.id), np.int32 if len(far) else np.uint8)
        if len(far):
            self.count[far] = _lists(t.column(7).combine_chunks())[0].reshape(len(far), COORDS)
        self.tested = self.passed = 0

    def bounded(self, i: np.ndarray, other: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether the summed minima of the points ``i`` and the vectors ``other[j]`` reach the overlap needed with a set of ``least`` words at least."""
        self.tested += len(i)
        keep = np.zeros(len(i), bool)
        for c in range(0, len(i), 16_384):
            p, q = i[c : c + 16_384], j[c : c + 16_384]
            keep[c : c + 16_384] = np.minimum(self.count[p], other[q]).sum(1, dtype=np.int64) >= self.rule.need(self.size[p] + least[c : c + 16_384])
        return keep

    def verified(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pairs of rows that are similar and whose first common word is in their slab; pairs with a long set that may be similar are not sure."""
        swap = (self.size[i] > self.size[j]) | ((self.size[i] == self.size[j]) & (self.id[i] > self.id[j]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        a, b = self.size[i], self.size[j]
        need = self.rule.need(a + b)
        # Sizes; the smaller set's entry must be an index entry; and the words left from the slab's on must suffice.
        keep = (self.id[i] != self.id[j]) & ~(self.mixed[i] & (self.block[i] == self.block[j])) & (a >= need) & self.indexed[i] & (np.minimum(a - self.place[i], b - self.place[j]) >= need)
        i, j, need = i[keep], j[keep], need[keep]
        # Every pair's own bound, before its words are looked at.
        near = self.bounded(i, self.count, j, self.size[j])
        i, j, need = i[near], j[near], need[near]
        self.passed += len(i)
        long = self.size[j] > LONG
        out = [(self.id[i[long]], self.id[j[long]], np.zeros(long.sum(), bool))]
        i, j, need = i[~long], j[~long], need[~long]
        step = max(1, 2_000_000 // (self.width * self.width))
        for s in range(0, len(i), step):
            p, q, n = i[s : s + step], j[s : s + step], need[s : s + step]
            equal = (self.words[p][:, :, None] == self.words[q][:, None, :]) & self.pad[p][:, :, None] & self.pad[q][:, None, :]
            common = equal.any(2)
            good = common.sum(1) >= n
            first = self.words[p[good], common[good].argmax(1)] & (self.slabs - 1)
            at = np.flatnonzero(good)[first == self.slab[p[good]]]
            out.append((self.id[p[at]], self.id[q[at]], np.ones(len(at), bool)))
        x, y, sure = (np.concatenate([o[k] for o in out]) for k in range(3))
        return np.minimum(x, y), np.maximum(x, y), sure

    def tree_pairs(self, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidate pairs of rows of one cell, by searching its R-tree with each of its points, some hundreds of them at a time."""
        rows = np.arange(begin, end)
        t = float(self.rule.t)
        # Packing: points with the same next word lie side by side, then by size; a long set's by its greatest coordinate.
        nxt = np.where(self.pad[rows].any(1), self.words[rows, np.minimum(self.place[rows] + 1, self.width - 1)] & (GROUPS - 1), -1 - self.count[rows].argmax(1))
        rows = rows[np.lexsort((self.size[rows], nxt))]
        n, size = len(rows), self.size[rows]
        levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(self.count[rows], size, size)]
        while len(levels[-1][0]) > FAN:
            node, low, high = levels[-1]
            cut = np.arange(0, len(node), FAN)
            levels.append((np.maximum.reduceat(node, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))
        for s in range(0, n, 512):
            point = np.repeat(np.arange(s, min(n, s + 512)), len(levels[-1][0]))
            node_at = np.tile(np.arange(len(levels[-1][0])), min(n, s + 512) - s)
            for depth in range(len(levels) - 1, -1, -1):
                node, low, high = levels[depth]
                fits = (high[node_at] >= t * size[point] - 1e-6) & (low[node_at] * t <= size[point] + 1e-6)
                if depth == 0:  # points of leaves: each pair once; their own bound is taken with the rest of what is known of the pair
                    fits &= point < node_at
                    point, node_at = point[fits], node_at[fits]
                    break
                point, node_at = point[fits], node_at[fits]
                least = np.maximum(low[node_at], np.ceil(t * size[point] - 1e-6).astype(np.int64))
                keep = self.bounded(rows[point], node, node_at, least)
                point, node_at = point[keep], node_at[keep]
                fan = len(levels[depth - 1][0])
                child = (node_at[:, None] * FAN + np.arange(FAN)).ravel()
                point = np.repeat(point, FAN)
                inside = child < fan
                point, node_at = point[inside], child[inside]
            yield rows[point], rows[node_at]

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cuts = np.flatnonzero(np.concatenate([[True], self.cell[1:] != self.cell[:-1], [True]])) if len(self.cell) else np.zeros(1, np.int64)
        begin, n = cuts[:-1], np.diff(cuts)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in np.unique(n):
            if 2 <= k <= FAN:  # a tree of one leaf: all cells of this size at once
                i, j = np.triu_indices(int(k), 1)
                left, right = (begin[n == k][:, None] + i).ravel(), (begin[n == k][:, None] + j).ravel()
                for s in range(0, len(left), 1_000_000):
                    found.append(self.verified(left[s : s + 1_000_000], right[s : s + 1_000_000]))
        for b, k in zip(begin[n > FAN], n[n > FAN]):
            for i, j in self.tree_pairs(int(b), int(b + k)):
                for s in range(0, len(i), 1_000_000):
                    found.append(self.verified(i[s : s + 1_000_000], j[s : s + 1_000_000]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _searched(threshold: float, slabs: int):
    """Entries sorted by cell -> pairs (a, b).  Whole cells are taken from the stream at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = Rule(threshold)
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            a, b, sure = Points(t, rule, slabs).search()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure)], names=["a", "b", "sure"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 20_000:
                t = pa.Table.from_batches(held)
                cell = t.column(0).to_numpy()
                cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
                if cut:
                    yield from flush(t.slice(0, cut))
                rest = t.slice(cut).combine_chunks()
                held, rows = rest.to_batches(), 0 if not cut else rest.num_rows
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def similar_pairs(sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``a, b`` (a < b): pairs of ids of different word sets whose Jaccard similarity reaches ``threshold``; ``sets`` has id, words (hashes)."""
    spark = sets.sparkSession
    group = F.col("h").bitwiseAND(GROUPS - 1).cast("int")
    seen = sets.select(F.explode("words").alias("h")).groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()
    frequency = np.zeros(GROUPS, np.int64)
    for r in seen:
        frequency[r["g"]] = r["n"]
    rule = Rule(threshold)
    slabs = sets.mapInArrow(_slab_counts(frequency, rule), "slab bigint, n bigint").groupBy("slab").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in slabs)
    # As many slabs, a power of two, that one has some hundreds of points.
    n_slabs = min(GROUPS, 1 << max(0, (total // SLAB)).bit_length())
    points = np.zeros(n_slabs, np.int64)
    for r in slabs:
        points[r["slab"] & (n_slabs - 1)] += r["n"]
    entries = sets.mapInArrow(_cells(frequency, rule, points, block), _ENTRY)
    found = entries.repartition(tasks(spark), "cell").sortWithinPartitions("cell").mapInArrow(_searched(threshold, n_slabs), _PAIR)
    if not sets.where(F.size("words") > LONG).limit(1).count():
        return found.select("a", "b")
    found = checkpoint(found)
    left, right = (sets.select(F.col("id").alias(n), F.col("words").alias(w)) for n, w in (("a", "x"), ("b", "y")))
    maybe = found.where("NOT sure").select("a", "b").distinct().join(left, "a").join(right, "b")
    common, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    t = rule.t
    likely = maybe.where(common * (t.numerator + t.denominator) >= total * t.numerator)
    return found.where("sure").select("a", "b").unionByName(likely.select("a", "b"))


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``ord, words``: members (ord, id) and sets (id, words as hashes); ``id`` is the least ``ord`` with that word set."""
    keyed = rows.where("ord IS NOT NULL AND size(words) > 0").select("ord", F.concat_ws(" ", "words").alias("key"))
    reps = keyed.groupBy("key").agg(F.min("ord").alias("id"), F.count("*").alias("copies"))
    members = keyed.join(reps.select("key", "id"), "key").select("ord", "id")
    sets = reps.select("id", "copies", F.transform(F.split("key", " "), lambda w: F.xxhash64(w)).alias("words"))
    return checkpoint(members), checkpoint(sets)


def similar_rows(rows: DataFrame, threshold: float) -> DataFrame:
    """``ord_a, ord_b`` (ord_a < ord_b): every pair of rows (ord, words) whose similarity reaches ``threshold``, copies included."""
    members, sets = classes(rows)
    pairs = similar_pairs(sets.select("id", "words"), threshold)
    left = members.select(F.col("id").alias("a"), F.col("ord").alias("x"))
    right = members.select(F.col("id").alias("b"), F.col("ord").alias("y"))
    across = pairs.join(left, "a").join(right, "b").select(F.least("x", "y").alias("ord_a"), F.greatest("x", "y").alias("ord_b"))
    many = members.join(sets.where("copies > 1").select("id"), "id")
    copies = many.select("id", F.col("ord").alias("ord_a")).join(many.select("id", F.col("ord").alias("ord_b")), "id").where("ord_a < ord_b")
    return across.unionByName(copies.select("ord_a", "ord_b"))


def components(pairs: DataFrame) -> DataFrame:
    """``node, root``: connected components of an undirected graph (a, b) by large-star and small-star steps; the root is the least node."""
    edges = written(pairs.select("a", "b"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("m").alias("x"), F.col("b").alias("y")).where("x <> y").unionByName(low.select(F.col("m").alias("x"), F.col("a").alias("y"))).distinct()
        edges = written(small.select(F.col("x").alias("a"), F.col("y").alias("b")))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def groups(rows: DataFrame, threshold: float) -> DataFrame:
    """``ord, group_id, n_links`` of every row (ord, words) with words: its group of rows linked by similarity, and its links.

    ``group_id`` is the least ``ord`` of the group; copies count as links.
    """
    members, sets = classes(rows)
    pairs = checkpoint(similar_pairs(sets.select("id", "words"), threshold))
    root = components(pairs)
    sizes = sets.select("id", "copies")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(sizes.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("n"))
    per_class = sizes.join(links, "id", "left").join(root.withColumnRenamed("node", "id"), "id", "left")
    per_class = per_class.select("id", F.coalesce("root", "id").alias("group_id"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    return members.join(per_class, "id").select("ord", "group_id", "n_links")


def advertisements(articles: DataFrame) -> DataFrame:
    """``ord, words`` of the advertisements."""
    return articles.where(F.col("group_name").contains(".forsale.")).select("ord", ad_words(F.col("subject"), F.col("from_addr")).alias("words"))
