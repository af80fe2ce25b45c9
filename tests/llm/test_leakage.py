import random

import pytest

from threadloom.llm import leakage

WORDS = [f"w{i}" for i in range(40)]


def brute(docs, items, least):
    out = set()
    for d, dw in docs:
        have = {tuple(dw[i : i + least]) for i in range(len(dw) - least + 1)}
        out |= {(d, i) for i, iw in items if any(tuple(iw[k : k + least]) in have for k in range(len(iw) - least + 1))}
    return out


@pytest.mark.parametrize("seed, least", [(1, 10), (2, 4), (3, 1)])
def test_found(spark, monkeypatch, seed, least):
    rng = random.Random(seed)
    items = [(i, [rng.choice(WORDS) for _ in range(rng.randint(0, 40))]) for i in range(12)]
    docs = []
    for d in range(80):
        w = [rng.choice(WORDS) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5 and items:
            it = rng.choice(items)[1]
            a = rng.randint(0, max(0, len(it) - 1))
            at = rng.randint(0, len(w))
            w = w[:at] + it[a : a + rng.randint(1, 14)] + w[at:]
        docs.append((d, w))
    monkeypatch.setattr(leakage, "SEGMENT", 300)
    say = lambda rows: [(k, ", ".join(x.upper() if k % 2 else x for x in w) + ".") for k, w in rows]
    d = spark.createDataFrame(say(docs), "doc_id bigint, text string").repartition(3)
    e = spark.createDataFrame(say(items), "item_id bigint, text string")
    want = brute(docs, items, least)
    assert {tuple(r) for r in leakage.leaked(d, e, least).collect()} == want
    monkeypatch.setattr(leakage, "BLOCK", 5)
    built, build = [], leakage.build_index
    monkeypatch.setattr(leakage, "build_index", lambda c: built.append(c) or build(c))
    assert {tuple(r) for r in leakage.leaked(d, e, least).collect()} == want, "items in blocks"
    assert len(built) == 1, "one scan of the corpus for all blocks"


def test_other_characters_and_positions(spark):
    passage = "the council of Zedo decided to compare and glue the vessel"
    texts = [(1, f"Before it {passage.upper()} after"), (2, f"x {passage.replace('o', 'о')} y"), (3, passage.replace("and", "an​d").replace(" ", " ")), (4, passage.replace("glue", "glue once")), (5, passage)]
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    e = spark.createDataFrame([(9, passage)], "item_id bigint, text string")
    assert {tuple(r) for r in leakage.leaked(d, e).collect()} == {(1, 9), (2, 9), (3, 9), (5, 9)}
    at = {r["doc"]: (r["doc_pos"], r["item_pos"], r["n_words"]) for r in leakage.passages(d, e).collect()}
    assert at == {1: (2, 0, 11), 2: (1, 0, 11), 3: (0, 0, 11), 5: (0, 0, 11)}
    near = {tuple(r)[0] for r in leakage.near_passages(d, e, needed=9).collect()}
    assert near == {1, 2, 3, 4, 5}


def test_edges(spark):
    ten = " ".join(WORDS[:10])
    d = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, ten, 1), (3, ten, 1), (None, ten, 1), (4, "filler " * 60_000 + ten, 1)], "doc_id bigint, text string, doc int")
    e = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, ten, "a"), (4, "w1 w2", "a"), (None, ten, "a"), (5, ten, None)], "item_id bigint, text string, answer string")
    assert {tuple(r) for r in leakage.leaked(d, e).collect()} == {(3, 3), (4, 3), (3, 5), (4, 5)}
    assert leakage.leaked(d.limit(0), e).count() == 0 and leakage.leaked(d, e.limit(0)).count() == 0


def test_near_passages_hold_short_and_edited_ones(spark):
    item = [f"w{i}" for i in range(60)]
    common = [f"w{i}" for i in range(60) if i not in (25, 26, 30, 31)]
    filler = [(100 + k, common[k:] + common[:k]) for k in range(0, 30, 7)]  # the four words left out are the rarest
    edited = item[20:32]
    edited[5], edited[10] = "other", "word"
    longer = item[20:32]
    longer[5] = longer[6] = "other"
    docs = [(1, ["x"] * 5 + item[3:13] + ["y"] * 5), (2, ["x"] * 9 + edited + ["y"] * 9), (3, item[40:49] + ["z"] * 20), (4, ["x"] * 9 + longer + ["y"] * 9)]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in [*docs, *((k, w[:9]) for k, w in filler)]], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    exact = {tuple(r) for r in leakage.leaked(d, e).collect()}
    near = {tuple(r)[:2] for r in leakage.near_passages(d, e).collect()}
    assert exact == {(1, 1)} and near == {(1, 1), (2, 1), (4, 1)}


@pytest.mark.parametrize("seed", [4, 5])
def test_near_passages_hold_the_exact_ones(spark, seed):
    rng = random.Random(seed)
    items = [(i, [rng.choice(WORDS) for _ in range(rng.randint(8, 40))]) for i in range(12)]
    docs = []
    for d in range(60):
        it = rng.choice(items)[1]
        a = rng.randint(0, len(it) - 1)
        docs.append((d, [rng.choice(WORDS) for _ in range(rng.randint(0, 30))] + it[a : a + rng.randint(6, 16)] + [rng.choice(WORDS) for _ in range(rng.randint(0, 30))]))
    say = lambda rows: [(k, " ".join(w)) for k, w in rows]
    d, e = spark.createDataFrame(say(docs), "doc_id bigint, text string"), spark.createDataFrame(say(items), "item_id bigint, text string")
    want = brute(docs, items, 10)
    assert want and want <= {tuple(r)[:2] for r in leakage.near_passages(d, e).collect()}


def test_index_holds_every_term(spark):
    d = spark.createDataFrame([(1, "a b a c"), (2, ""), (3, "b b")], "doc bigint, canonical string").coalesce(1)
    (r,) = leakage.build_index(d).collect()
    lists = {}
    at = 0
    for term, n in zip(r["term"], r["size"]):
        place = 0
        for k in range(n):
            place = r["step"][at] if k == 0 else place + r["step"][at]
            lists.setdefault(term, []).append(place)
            at += 1
    assert lists == {"a": [0, 2], "b": [1, 4, 5], "c": [3]} and r["doc"] == [1, 2, 3] and r["length"] == [4, 0, 2]


def near_brute(docs, items, least=10, half=12, needed=16, slack=2):
    """Proximity matches by definition, place by place, from the rarest words of every window of an item."""
    frequency = {}
    for _, w in docs:
        for x in w:
            frequency[x] = frequency.get(x, 0) + 1
    out = {}
    for i, iw in items:
        if len(iw) < least:
            continue
        size = min(least + slack, len(iw))
        places = {k + j for k in range(len(iw) - size + 1) for j in sorted(range(size), key=lambda j: frequency.get(iw[k + j], 0))[: slack + 1]}
        for d, dw in docs:
            for v in places:
                for g in (g for g, x in enumerate(dw) if x == iw[v]):
                    fits = lambda o: 0 <= v + o < len(iw) and iw[v + o] in dw[max(0, g + o - slack) : max(0, g + o + slack + 1)]
                    n = sum(fits(o) for o in range(-half, half + 1))
                    window = least + slack
                    most = max(sum(fits(o) for o in range(a, a + window)) for a in range(-window + 1, 1))
                    if n >= needed or most >= least:
                        out[d, i] = max(out.get((d, i), 0), n)
    return out


@pytest.mark.parametrize("seed", [6, 7])
def test_near_passages_against_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    items = [(i, [rng.choice(words) for _ in range(rng.randint(8, 45))]) for i in range(10)]
    docs = []
    for d in range(50):
        it = rng.choice(items)[1]
        a = rng.randint(0, len(it) - 1)
        part = [x if rng.random() > 0.12 else rng.choice([*words, ""]) for x in it[a : a + rng.randint(8, 30)]]
        docs.append((d, [rng.choice(words) for _ in range(rng.randint(0, 30))] + [x for x in part if x] + [rng.choice(words) for _ in range(rng.randint(0, 30))]))
    monkeypatch.setattr(leakage, "SEGMENT", 500)
    say = lambda rows: [(k, " ".join(w)) for k, w in rows]
    d, e = spark.createDataFrame(say(docs), "doc_id bigint, text string"), spark.createDataFrame(say(items), "item_id bigint, text string")
    want = near_brute(docs, items)
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in leakage.near_passages(d, e).collect()}
    assert want and got == want
