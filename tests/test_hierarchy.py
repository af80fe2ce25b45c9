import random

import numpy as np
import pytest

from threadloom.operators.hierarchy import compress, thread_descendants, thread_roots, thread_trees

COLS = "ord bigint, message_id string, refs string"


def solved(parent):
    """(root, depth) of every node with a parent, by walking."""
    out = {}
    for n in parent:
        seen, at = {n: 0}, n
        while at in parent and parent[at] not in seen:
            at = parent[at]
            seen[at] = len(seen)
        if at not in parent:
            out[n] = (at, seen[at])
        else:
            first = parent[at]
            out[n] = (min(x for x, k in seen.items() if k >= seen[first]), -1)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_compress(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 60))
    node = rng.permutation(100)[:n]
    top = rng.integers(0, 100, n) if seed % 2 else np.minimum(node + rng.integers(1, 5, n), 99)
    t, h, _, loop = compress(node, top, np.ones(n, np.int64))
    want = solved({int(a): int(b) for a, b in zip(node, top)})
    assert {int(a): (int(b), int(c)) for a, b, c in zip(node, t, h)} == want
    assert [bool(x) for x in loop] == [want[int(a)][1] == -1 for a in node]


def forest(seed, n=160):
    rng = random.Random(seed)
    parent = {}
    for i in range(1, n):
        kind = rng.random()
        if kind < 0.6:
            parent[f"<{i}@h>"] = f"<{rng.randrange(max(0, i - 4), i)}@h>"
        elif kind < 0.7:
            parent[f"<{i}@h>"] = f"<{rng.randrange(n)}@h>"
        elif kind < 0.73:
            parent[f"<{i}@h>"] = f"<{i}@h>"
    rows = [(i, f"<{i}@h>", ("<gone@h> " + parent[f"<{i}@h>"] + " <lost@h>") if f"<{i}@h>" in parent else rng.choice([None, "", "<gone@h>"])) for i in range(n)]
    return parent, rows


@pytest.mark.parametrize("seed, bound", [(1, 1_000), (2, 40), (3, 25), (4, 30)])
def test_roots(spark, seed, bound):
    parent, data = forest(seed)
    rng = random.Random(seed)
    data = [(1_000 - i, m, r) for i, m, r in data]
    rng.shuffle(data)
    df = spark.createDataFrame(data, COLS).repartition(5)
    assert {r[0]: (r[1], r[2]) for r in thread_roots(df, bound).collect()} == solved(parent)


def test_a_long_chain_and_a_long_loop(spark):
    n = 700
    data = [(i, f"<{i:04}>", f"<{i - 1:04}>" if i else None) for i in range(n)] + [(n + i, f"<L{i:04}>", f"<L{(i + 1) % n:04}>") for i in range(n)]
    got = {r[0]: (r[1], r[2]) for r in thread_roots(spark.createDataFrame(data, COLS).repartition(7), 150).collect()}
    assert all(got[f"<{i:04}>"] == ("<0000>", i) for i in range(1, n)) and all(got[f"<L{i:04}>"] == ("<L0000>", -1) for i in range(n))


@pytest.mark.parametrize("bound", [30, 1_000])
def test_a_loop_over_several_partitions(spark, bound):
    """All share their first reference, so partitions hold long stretches; the least id is inside one of them."""
    n = 240
    data = [(i, f"<{(i + 97) % n:03}>", f"<none> <{(i + 98) % n:03}>") for i in range(n)] + [(n + i, f"<t{i:03}>", f"<none> <{'t' if i else ''}{max(i - 1, 0):03}>") for i in range(60)]
    got = {r[0]: (r[1], r[2]) for r in thread_roots(spark.createDataFrame(data, COLS), bound).collect()}
    assert len(got) == n + 60 and set(got.values()) == {("<000>", -1)}


@pytest.mark.parametrize("bound", [25, 1_000])
def test_a_deep_path_over_several_partitions(spark, bound):
    n = 200
    df = spark.createDataFrame([(i, f"<{i:03}>", f"<000> <{i - 1:03}>" if i else None) for i in range(n)], COLS)
    for r in thread_trees(df, bound).collect():
        assert r["path"] == [f"<{i:03}>" for i in range(r["depth"] + 1)] and r["n_descendants"] == n - 1 - r["depth"]


def test_trees(spark):
    parent, data = forest(5, 60)
    df = spark.createDataFrame(data, COLS)
    want = solved(parent)
    below = {m: [] for _, m, _ in data}
    for _, m, _ in data:
        if want.get(m, (m, 0))[1] >= 0:
            at, k = m, 0
            while at in parent:
                at, k = parent[at], k + 1
                below[at].append((m, k))
    for r in thread_trees(df).collect():
        root, depth = want.get(r["message_id"], (r["message_id"], 0))
        assert (r["root_id"], r["depth"]) == (root, depth)
        if depth < 0:
            assert r["path"] is None and r["n_descendants"] is None
        else:
            path = [r["message_id"]]
            while path[-1] in parent:
                path.append(parent[path[-1]])
            assert r["path"] == path[::-1] and r["n_descendants"] == len(below[r["message_id"]])
    got = sorted(tuple(r) for r in thread_descendants(df).collect())
    assert got == sorted((a, d, k) for a, ds in below.items() for d, k in ds)


def test_edges(spark):
    df = spark.createDataFrame([(3, "<a>", "<b>"), (1, "<a>", None), (2, "<b>", '"<a>" "<c d>"'), (None, "<d>", "<a>"), (5, None, "<a>"), (6, "<e>", "x" * 100_000 + "<a>")], COLS)
    wide = df.selectExpr("*", "1 AS node", "2 AS top", "3 AS place")
    got = {r[0]: (r[1], r[2]) for r in thread_roots(wide).collect()}
    assert got == {"<b>": ("<a>", 1), "<e>": ("<a>", 1)}, "the first row of a message decides"
    assert thread_roots(df.limit(0)).count() == 0 and thread_trees(df.limit(0)).count() == 0
