import random

import pytest
from pyspark.sql import functions as F

from threadloom.llm import neardup


def brute(data, t):
    sets = [(o, frozenset(w)) for o, w in data if w and o is not None]
    return sorted((min(a, b), max(a, b)) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if len(x & y) >= t * len(x | y) - 1e-12)


def sample(seed, n=260, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = list(rng.choice(out)[1])
            for _ in range(rng.randint(0, 4)):
                if w and rng.random() < 0.5:
                    w.pop(rng.randrange(len(w)))
                else:
                    w.append(rng.choice(words))
        else:
            w = rng.sample(words, rng.randint(0, 14))
        out.append((i, sorted(set(w))))
    return out


@pytest.mark.parametrize("seed, threshold", [(1, 0.6), (2, 0.6), (3, 0.8), (4, 0.5), (5, 1.0)])
def test_all_pairs(spark, seed, threshold):
    data = sample(seed)
    df = spark.createDataFrame(data, "ord bigint, words array<string>")
    got = [tuple(r) for r in neardup.similar_rows(df, threshold).collect()]
    assert sorted(got) == brute(data, threshold)


def test_trees_blocks_and_long_sets(spark):
    rng = random.Random(9)
    # Few words: slabs with hundreds of points, so trees of several levels; and some sets beyond the padded width.
    data = sample(11, 900, 24)
    big = [f"b{i}" for i in range(300)]
    data += [(1_000 + i, sorted(rng.sample(big, 280) + ["w1"])) for i in range(6)] + [(2_000, sorted(big[:200])), (2_001, sorted(big[:190] + ["w3"]))]
    df = spark.createDataFrame(data, "ord bigint, words array<string>")
    _, sets = neardup.classes(df)
    whole = sorted(tuple(r) for r in neardup.similar_pairs(sets.select("id", "words"), 0.6).collect())
    assert whole == sorted(tuple(r) for r in neardup.similar_pairs(sets.select("id", "words"), 0.6, block=40).collect())
    assert sorted(tuple(r) for r in neardup.similar_rows(df, 0.6).collect()) == brute(data, 0.6)


def cells(rng, sizes, extra=()):
    """Entries of cells of the given sizes whose sets share one word only."""
    import numpy as np
    import pyarrow as pa

    n = sum(sizes)
    cell = np.repeat(np.arange(len(sizes)), sizes)
    words = [np.concatenate([[7], rng.integers(100, 2**60, 12)]) for _ in range(n)]
    for i, j in extra:
        words[j] = words[i].copy()
        words[j][12] += 1
    flat = lambda x: np.full(n, x, np.int32)
    empty = pa.array([[]] * n, pa.list_(pa.int32()))
    return pa.table({"cell": cell.astype(np.int64), "slab": flat(7), "block": flat(0), "place": flat(0), "size": flat(13), "id": np.arange(n), "words": pa.array(words, pa.list_(pa.int64())), "counts": empty})


def test_every_candidate_is_bounded():
    """Of cells of any size, also of one leaf, no pair is verified that its summed minima rule out, and trees leave out most nodes."""
    import numpy as np

    rng = np.random.default_rng(1)
    for sizes in ([400], [2, 5, 16, 9] * 20, [17, 40]):
        p = neardup.Points(cells(rng, sizes, [(0, 1)]), neardup.Rule(0.6), 1 << 18)
        a, b, sure = p.search()
        assert [(int(x), int(y)) for x, y in zip(a, b)] == [(0, 1)] and sure.all()
        pairs = sum(k * (k - 1) // 2 for k in sizes)
        assert p.passed <= 3 and p.tested < max(pairs, 2 * sum(sizes) * neardup.FAN), "bounds take the place of verification"
    candidates = sum(len(i) for i, _ in p.tree_pairs(0, 17))
    assert candidates <= 17 * 16


def test_a_hot_slab_is_copied_in_pieces():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    words = [np.concatenate([[5], rng.integers(100, 2**60, 3)]) for _ in range(50)]
    b = pa.RecordBatch.from_arrays([pa.array(np.arange(50)), pa.array(words, pa.list_(pa.int64()))], names=["id", "words"])
    points = np.ones(1 << 18, np.int64)
    points[5] = 1_000 * neardup.BLOCK
    frequency = np.ones(neardup.GROUPS, np.int64) * 10
    frequency[5] = 1
    out = list(neardup._cells(frequency, neardup.Rule(0.6), points, neardup.BLOCK)([b]))
    assert max(o.num_rows for o in out) <= 4_096 and sum(o.num_rows for o in out) >= 50 * 1_000


def test_groups(spark):
    data = [(5, ["a", "b", "c", "d", "e"]), (1, ["a", "b", "c", "d", "e"]), (2, ["a", "b", "c", "d", "f"]), (3, ["a", "b", "c", "g", "f"]), (9, ["z"]), (10, []), (11, None)]
    df = spark.createDataFrame(data, "ord bigint, words array<string>")
    assert sorted(tuple(r) for r in neardup.groups(df, 0.6).collect()) == [(1, 1, 2), (2, 1, 3), (3, 1, 1), (5, 1, 2), (9, 9, 0)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(220)) if a != b] + [(1_000 + i, 1_001 + i) for i in range(100)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in neardup.components(spark.createDataFrame([(min(e), max(e)) for e in edges], "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(up)}


def test_words_and_edges(spark):
    rows = [(1, "x.forsale.y", "Red SHIP-7 é", None), (2, "x.forsale.y", None, None), (None, "x.forsale.y", "red ship", "a"), (3, "x.talk.y", "red ship 7", None), (4, "x.forsale.y", "red ship 7!", "")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "ord bigint, group_name string, subject string, from_addr string, key string, id int")
    ads = neardup.advertisements(df)
    assert {r["ord"]: r["words"] for r in ads.collect()}[1] == ["7", "red", "ship"]
    assert [tuple(r) for r in neardup.similar_rows(ads, 0.6).collect()] == [(1, 4)]
    assert neardup.similar_rows(ads.limit(0), 0.6).count() == 0 and neardup.groups(ads.limit(0), 0.6).count() == 0
    assert neardup.similar_rows(ads.where(F.col("ord") == 1), 0.6).count() == 0
    long = spark.createDataFrame([(1, [f"a{i}" for i in range(20_000)]), (2, [f"a{i}" for i in range(19_000)])], "ord bigint, words array<string>")
    assert [tuple(r) for r in neardup.similar_rows(long, 0.6).collect()] == [(1, 2)]
