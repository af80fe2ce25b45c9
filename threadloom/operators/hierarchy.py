"""Parent-child links of unknown depth as full hierarchies: root, depth, path, descendants, loops.

Every node has at most one parent.  The links are solved by weighted disjoint-set forests:

1. links are range-partitioned so that most of a tree lies in one partition (a tree with very many
   links is cut over several, since the range key ends in the node itself);
2. each partition joins its own links: every node gets the top that it reaches inside the
   partition and its offset, the number of steps to it.  Arrays of parents and offsets are compressed
   by path doubling, so a chain of n links takes log n vector steps;
3. only tops that have a link of their own in another partition are open.  Their links, already
   compressed, are merged by the same step on as many partitions as their count asks for (at most about ``bound``
   links each), and so on until one task holds what is left; where merging does not shrink the open links
   enough, random-mate contraction by joins removes about a quarter of them per round until they fit;
4. offsets are added up on the way back.

Numbers of descendants are summed bottom-up by the same levels (:func:`subtree_sums`), never counted from pairs.

A walk that never ends falls into a loop.  Its nodes get the loop's least node as root and depth -1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.packed import explode_packed
from threadloom.session import checkpoint, tasks, written

#: Links that one task may hold (four 64-bit numbers each).
BOUND = 1_000_000

_SOLVED = "node bigint, top bigint, hops bigint, least bigint, looped boolean"


def compress(node: np.ndarray, top: np.ndarray, hops: np.ndarray, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted union-find over the links of one partition: each node's last reachable top, its offset, the least node on the way there, and whether the walk loops.

    ``least`` is the least node that a link stands for (itself, and what was contracted into it).  For a looping walk the top is
    the least node of the loop and the offset -1.  ``node`` has no repeats.
    """
    n = len(node)
    top, hops, least = top.copy(), hops.copy(), (node if least is None else least).copy()
    if not n:
        return top, hops, least, np.zeros(0, bool)
    nxt = _index(node, top)
    for _ in range(int(n).bit_length() + 1):
        live = np.flatnonzero(nxt >= 0)
        if not len(live):
            break
        to = nxt[live]
        hops_, top_, nxt_, least_ = hops[live] + hops[to], top[to], nxt[to], np.minimum(least[live], least[to])
        hops[live], top[live], nxt[live], least[live] = hops_, top_, nxt_, least_
    looped = nxt >= 0
    # After more than n steps a looping walk stands on the loop itself, and the least node from there on is that of the loop.
    top[looped], hops[looped] = least[nxt[looped]], -1
    return top, hops, least, looped


def _compress_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    node, top, hops, least = (t.column(i).to_numpy() for i in range(4))
    columns = node, *compress(node, top, hops, least)
    for at in range(0, len(node), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names=["node", "top", "hops", "least", "looped"])


_LINK = ["node", "top", "hops", "least"]


def _mate(links: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One random-mate round: links taken out of the forest, loops shrunk to one node (solved), and the shorter links that stay."""

    def coin(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(2)) == 0

    out = links.where(coin("node") & ~coin("top"))
    rest = links.where(~(coin("node") & ~coin("top")))
    to = out.select(F.col("node").alias("__n"), F.col("top").alias("__t"), F.col("hops").alias("__h"), F.col("least").alias("__l"))
    rest = written(
        rest.join(to, F.col("top") == F.col("__n"), "left").select(
            "node", F.coalesce("__t", "top").alias("top"), (F.col("hops") + F.coalesce("__h", F.lit(0))).alias("hops"), F.least("least", F.coalesce("__l", "least")).alias("least"), "place"
        )
    )
    loops = rest.where("node = top").select("node", F.col("least").alias("top"), F.lit(-1).cast("bigint").alias("hops"), "least", F.lit(True).alias("looped"))
    return written(out), loops, rest.where("node <> top")


def _expand(part: DataFrame, solved: DataFrame) -> DataFrame:
    """``part`` (node, top, hops) continued with the solution of its tops."""
    s = solved.select(F.col("node").alias("__n"), F.col("top").alias("__t"), F.col("hops").alias("__h"), F.col("looped").alias("__l"))
    looped = F.coalesce("__l", F.lit(False))
    return part.join(s, F.col("top") == F.col("__n"), "left").select(
        "node",
        F.coalesce("__t", "top").alias("top"),
        F.when(looped, F.lit(-1)).otherwise(F.col("hops") + F.coalesce("__h", F.lit(0))).cast("bigint").alias("hops"),
        "least",
        looped.alias("looped"),
    )


def _needed(n: int, bound: int) -> int:
    return -(-n // max(1, bound))


def _parts(links: DataFrame, bound: int) -> int:
    """Partitions for a first pass: as many as the session has tasks, and so many that none holds more than about ``bound`` links."""
    return max(tasks(links.sparkSession), _needed(links.count(), bound))


def solve(links: DataFrame, bound: int = BOUND, parts: int | None = None) -> DataFrame:
    """``node, top, hops, least, looped`` for links ``node, top, hops, least, place`` (one per node; ``place`` brings a tree together)."""
    parts = parts or _parts(links, bound)
    if parts == 1:
        return links.select(*_LINK).coalesce(1).mapInArrow(_compress_batches, _SOLVED)
    local = checkpoint(links.repartitionByRange(parts, "place", "node").select(*_LINK).mapInArrow(_compress_batches, _SOLVED))
    tops = local.where("NOT looped").select(F.col("top").alias("node")).distinct()
    open_ = checkpoint(local.where("NOT looped").join(tops, "node", "left_semi").select(*_LINK, F.col("top").alias("place")))
    n = open_.count()
    taken: list[DataFrame] = []
    loops: list[DataFrame] = []
    if n > bound and (n > local.count() // 2 or _needed(n, bound) >= parts):
        seed = 0
        while n > bound:
            out, closed, open_ = _mate(open_, seed)
            taken.append(out)
            loops.append(closed)
            seed, n = seed + 1, open_.count()
    solved = local.limit(0) if n == 0 else solve(open_, bound, _needed(n, bound))
    for closed in loops:
        solved = solved.unionByName(closed)
    for out in reversed(taken):
        solved = written(solved.unionByName(_expand(out, solved)))
    done = local.where("looped")
    # A top may lie on a loop that another partition closed by itself, or be led there by the tops above it.
    known = solved.where("looped").unionByName(_expand(solved.where("NOT looped"), done)).unionByName(done)
    return done.unionByName(_expand(local.where("NOT looped"), known))


def reply_links(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (``message_id, node``) and links (``node, top, hops, place``) of reply threads.

    A message is the row with the smallest ``ord`` of its id; that number is also its node.  The parent
    is the last id in ``refs`` that is itself stored.  Rows with a NULL id or number are no messages.
    """
    articles = articles.where("ord IS NOT NULL")
    nodes = articles.where("message_id IS NOT NULL").groupBy("message_id").agg(F.min("ord").alias("node"))
    refs = explode_packed(articles, "ord", {"refs": "angle"}).select("ord", "pos", F.col("value").alias("message_id"), F.xxhash64("value").alias("h"))
    found = refs.join(nodes.withColumnRenamed("node", "parent"), "message_id")
    last = found.groupBy(F.col("ord").alias("node")).agg(F.max(F.struct("pos", "parent")).alias("p"), F.min(F.struct("pos", "h")).alias("f"))
    links = last.join(nodes.select("node"), "node", "left_semi").select("node", F.col("p.parent").alias("top"), F.lit(1).cast("bigint").alias("hops"), F.col("node").alias("least"), F.col("f.h").alias("place"))
    return nodes, links


def loop_roots(solved: DataFrame, links: DataFrame, nodes: DataFrame, bound: int = BOUND) -> DataFrame:
    """``node, root_id, hops`` of the looping nodes, the root being the least message id (by bytes) on the loop.

    The looping nodes are numbered again in the order of their ids (a distributed sort) and solved again, so the
    least number that a loop reports is that of its least id.
    """
    ids = solved.where("looped").select("node").join(nodes, "node").orderBy("message_id")
    ranked = checkpoint(ids.withColumn("rank", F.monotonically_increasing_id()))
    up = ranked.select(F.col("node").alias("top"), F.col("rank").alias("top_rank"))
    again = links.drop("least").join(ranked.select("node", "rank"), "node").join(up, "top")
    solved = solve(again.select(F.col("rank").alias("node"), F.col("top_rank").alias("top"), "hops", F.col("rank").alias("least"), F.col("rank").alias("place")), bound)
    roots = ranked.select(F.col("rank").alias("top"), F.col("message_id").alias("root_id"))
    back = ranked.select(F.col("rank").alias("__r"), F.col("node").alias("__n"))
    return solved.join(roots, "top").join(back, F.col("node") == F.col("__r")).select(F.col("__n").alias("node"), "root_id", "hops")


def thread_roots(articles: DataFrame, bound: int = BOUND) -> DataFrame:
    """``message_id, root_id, depth`` of every message that has a parent.

    ``depth`` is -1 and ``root_id`` the least id on the loop where the walk up never ends.  Repeated rows of
    a message count once (the smallest ``ord``); an empty table gives no rows.  Columns other than ``ord``,
    ``message_id`` and ``refs`` are not read.
    """
    nodes, links = reply_links(articles.select("ord", "message_id", "refs"))
    nodes, links = checkpoint(nodes), checkpoint(links)
    solved = checkpoint(solve(links, bound))
    ids = nodes.select(F.col("node").alias("top"), F.col("message_id").alias("root_id"))
    trees = solved.where("NOT looped").join(ids, "top")
    both = trees.select("node", "root_id", "hops").unionByName(loop_roots(solved, links, nodes, bound))
    return both.join(nodes, "node").select("message_id", "root_id", F.col("hops").alias("depth"))


_SEGMENT = "node bigint, top bigint, up array<bigint>"


#: Ancestors of one batch of segments.
STEPS = 1_000_000


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ancestors of every node inside the partition, nearest first, by walking the index of parents, all nodes of a batch at once."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    node, top = t.column(0).to_numpy(), t.column(1).to_numpy()
    nxt = _index(node, top)
    _, hops, _, _ = compress(node, top, np.ones(len(node), np.int64))
    ends = np.cumsum(hops)
    begin = 0
    while begin < len(node):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + STEPS, side="right")))
        n = hops[begin:end]
        offsets = np.concatenate([[0], np.cumsum(n)])
        up = np.empty(offsets[-1], np.int64)
        at, live, k = np.arange(begin, end), np.arange(end - begin), 0
        last = np.empty(end - begin, np.int64)
        while len(live):
            up[offsets[live] + k] = top[at]
            last[live] = top[at]
            k += 1
            more = n[live] > k
            live, at = live[more], nxt[at[more]]
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(up)).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(node[begin:end]), pa.array(last), lists], names=["node", "top", "up"])
        begin = end


def _index(node: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Place of every row's top among the nodes, -1 where it is none of them."""
    order = np.argsort(node, kind="stable")
    keys = node[order]
    place = np.minimum(np.searchsorted(keys, top), len(node) - 1)
    return np.where(keys[place] == top, order[place], -1)


def ancestors(links: DataFrame, parts: int | None = None, bound: int = BOUND) -> DataFrame:
    """``node, up``: the ancestors of every node, nearest first; ``links`` (node, top, place) must have no loops."""
    parts = parts or _parts(links, bound)
    shape = links.select("node", "top", "place")
    spread = shape.repartitionByRange(parts, "place", "node") if parts > 1 else shape.coalesce(1)
    local = checkpoint(spread.select("node", "top").mapInArrow(_segments, _SEGMENT))
    if parts == 1:
        return local.select("node", "up")
    open_ = checkpoint(local.join(local.select(F.col("top").alias("node")).distinct(), "node", "left_semi").select("node", "top", F.col("top").alias("place")))
    n = open_.count()
    if n == 0:
        return local.select("node", "up")
    chains = ancestors(open_, 1, bound) if n <= bound else _doubled(open_)
    # A top's own segment and those of its tops, put one after the other in walking order.
    steps = chains.select("node", F.posexplode(F.concat(F.array("node"), "up")).alias("k", "at"))
    joined = steps.join(local.select(F.col("node").alias("at"), "up"), "at").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "up"))).alias("s"))
    whole = joined.select(F.col("node").alias("__n"), F.flatten(F.transform("s", lambda s: s["up"])).alias("__u"))
    return local.join(whole, F.col("top") == F.col("__n"), "left").select("node", F.concat("up", F.coalesce("__u", F.array().cast("array<bigint>"))).alias("up"))


def _doubled(links: DataFrame) -> DataFrame:
    """``node, up`` by path doubling: as many joins as the depth has binary digits, however many links there are."""
    now = links.select("node", "top", F.array("top").alias("up"))
    while True:
        above = now.select(F.col("node").alias("__n"), F.col("top").alias("__t"), F.col("up").alias("__u"))
        both = written(now.join(above, F.col("top") == F.col("__n"), "left"))
        if not both.where("__n IS NOT NULL").limit(1).count():
            return now.select("node", "up")
        now = both.select("node", F.coalesce("__t", "top").alias("top"), F.concat("up", F.coalesce("__u", F.array().cast("array<bigint>"))).alias("up"))


def _sums(nxt: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of ``weight`` over every row and all rows below it, by doubling the steps."""
    total, jump = weight.copy(), nxt.copy()
    while True:
        live = np.flatnonzero(jump >= 0)
        if not len(live):
            return total
        np.add.at(total, jump[live], total[live].copy())
        jump[live] = jump[jump[live]]


def _one_part(t: pa.Table) -> tuple[np.ndarray, ...]:
    node, top, weight = (t.column(i).to_numpy() for i in range(3))
    return node, top, weight, _index(node, top)


def _reaches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, top, weight -> the same, the top that is reached inside the partition, and the partition's number."""
    from pyspark import TaskContext

    got = [b for b in batches if b.num_rows]
    if got:
        t = pa.Table.from_batches(got)
        node, top, weight, _ = _one_part(t)
        reach, _, _, _ = compress(node, top, np.ones(len(node), np.int64))
        part = np.full(len(node), TaskContext.get().partitionId())
        for at in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in (node, top, weight, reach, part)], names=["node", "top", "weight", "reach", "part"])


def _part_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, top, weight, part, sorted by part -> node, total; one part is in memory at a time."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, _, weight, nxt = _one_part(pa.Table.from_batches(held))
        total = _sums(nxt, weight)
        for at in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[at : at + 100_000]), pa.array(total[at : at + 100_000])], names=["node", "total"])

    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        parts = b.column(3).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(parts)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and parts[i] != now:
                yield from flush(held)
                held = []
            now = parts[i]
            held.append(b.slice(i, j - i))
    if held:
        yield from flush(held)


def subtree_sums(links: DataFrame, bound: int = BOUND, parts: int | None = None) -> DataFrame:
    """``node, total``: the ``weight`` of every node and of all nodes below it; ``links`` (node, top, weight, place) must have no loops.

    Partitions sum their own links first.  What arrives at a top with a link elsewhere is a weight there; those tops are summed
    among themselves by the same step, and their totals go back into the partitions that hold them.
    """
    parts = parts or _parts(links, bound)
    shape = links.select("node", "top", "weight", "place")
    if parts == 1:
        return shape.coalesce(1).select("node", "top", "weight", F.lit(0).alias("part")).mapInArrow(_part_sums, "node bigint, total bigint")
    local = checkpoint(shape.repartitionByRange(parts, "place", "node").select("node", "top", "weight").mapInArrow(_reaches, "node bigint, top bigint, weight bigint, reach bigint, part bigint"))
    arrive = local.groupBy(F.col("reach").alias("node")).agg(F.sum("weight").alias("arrived"))
    open_ = checkpoint(local.select("node", "reach").join(arrive, "node").select("node", F.col("reach").alias("top"), F.col("arrived").alias("weight"), F.col("reach").alias("place")))
    n = open_.count()
    if n <= bound:
        above = subtree_sums(open_, bound, 1)
    elif n <= local.count() // 2 and _needed(n, bound) < parts:
        above = subtree_sums(open_, bound, _needed(n, bound))
    else:
        above = _doubled_sums(open_)
    weighed = local.join(above, "node", "left").select("node", "top", (F.col("weight") + F.coalesce("total", F.lit(0))).alias("weight"), "part")
    return weighed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_part_sums, "node bigint, total bigint")


def _doubled_sums(links: DataFrame) -> DataFrame:
    """``node, total`` by doubling with joins: as many rounds as the depth has binary digits, however many links there are."""
    now = links.select("node", "top", F.col("weight").alias("total"))
    while now.where("top IS NOT NULL").limit(1).count():
        more = now.where("top IS NOT NULL").groupBy(F.col("top").alias("__a")).agg(F.sum("total").alias("__s"))
        up = now.select(F.col("node").alias("__n"), F.col("top").alias("__t"))
        now = written(now.join(more, F.col("node") == F.col("__a"), "left").join(up, F.col("top") == F.col("__n"), "left").select("node", F.col("__t").alias("top"), (F.col("total") + F.coalesce("__s", F.lit(0))).alias("total")))
    return now.select("node", "total")


def thread_trees(articles: DataFrame, bound: int = BOUND) -> DataFrame:
    """``message_id, root_id, depth, path, n_descendants`` of every message (also of roots and of messages in loops).

    ``path`` lists message ids from the root down to the message; it is NULL, as is the number of
    descendants, where the walk falls into a loop.
    """
    nodes, sound, pairs, solved, roots = _tree_parts(articles, bound)
    names = nodes.select(F.col("node").alias("a"), F.col("message_id").alias("name"))
    path = pairs.join(names, "a").groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.negative("k").alias("k"), "name"))).alias("p"))
    path = path.select("node", F.transform("p", lambda s: s["name"]).alias("above"))
    inner = subtree_sums(sound.select("node", "top", F.lit(1).cast("bigint").alias("weight"), "place"), bound).select("node", (F.col("total") - 1).alias("n_below"))
    # A root has no link; all that reach it are below it.
    outer = solved.where("NOT looped").groupBy(F.col("top").alias("node")).agg(F.count("*").alias("n_below"))
    below = inner.unionByName(outer)
    rows = nodes.join(roots, "message_id", "left").join(path, "node", "left").join(below, "node", "left")
    looped = F.coalesce(F.col("depth"), F.lit(0)) < 0
    return rows.select(
        "message_id",
        F.coalesce("root_id", "message_id").alias("root_id"),
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
        F.when(~looped, F.concat(F.coalesce("above", F.array().cast("array<string>")), F.array("message_id"))).alias("path"),
        F.when(~looped, F.coalesce("n_below", F.lit(0))).cast("bigint").alias("n_descendants"),
    )


def _tree_parts(articles: DataFrame, bound: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    nodes, links = reply_links(articles.select("ord", "message_id", "refs"))
    nodes, links = checkpoint(nodes), checkpoint(links)
    solved = checkpoint(solve(links, bound))
    ids = nodes.select(F.col("node").alias("top"), F.col("message_id").alias("root_id"))
    both = solved.where("NOT looped").join(ids, "top").select("node", "root_id", "hops").unionByName(loop_roots(solved, links, nodes, bound))
    roots = both.join(nodes, "node").select("message_id", "root_id", F.col("hops").alias("depth"))
    sound = checkpoint(links.join(solved.where("looped").select("node"), "node", "left_anti"))
    pairs = checkpoint(ancestors(sound, bound=bound).select("node", F.posexplode("up").alias("k", "a")))
    return nodes, sound, pairs, solved, roots


def thread_descendants(articles: DataFrame, bound: int = BOUND) -> DataFrame:
    """``message_id, descendant_id, distance``: every message with each message below it (messages in loops have none)."""
    nodes, _, pairs, _, _ = _tree_parts(articles, bound)
    up = nodes.select(F.col("node").alias("a"), "message_id")
    down = nodes.select("node", F.col("message_id").alias("descendant_id"))
    return pairs.join(up, "a").join(down, "node").select("message_id", "descendant_id", (F.col("k") + 1).cast("bigint").alias("distance"))
