import pytest

from threadloom.llm import mixing

D, M = "doc_id bigint, source string, text string", "source string, target_share double, max_repeats bigint"


def documents(spark, n=400):
    rows = [(i, "big" if i % 4 else "small" if i % 8 else "tiny", "some words here " * (1 + i % 5)) for i in range(n)]
    return spark.createDataFrame(rows, D)


TARGETS = [("big", 0.5, 1), ("small", 0.2, 2), ("tiny", 0.2, 3), ("absent", 0.1, 4)]


def test_shares_and_caps(spark):
    d, m = documents(spark), spark.createDataFrame(TARGETS, M)
    report = {r["source"]: r for r in mixing.shares(d, m, mixing.EXACT).collect()}
    for s, share in (("big", 5 / 9), ("small", 2 / 9), ("tiny", 2 / 9)):
        assert report[s]["wanted_share"] == pytest.approx(share) and report[s]["actual_share"] == pytest.approx(share, abs=0.02)
    assert report["absent"]["used_tokens"] == 0 and report["absent"]["wanted_share"] == 0
    used = mixing.mix(d, m, mixing.EXACT).collect()
    assert max(r["repeat"] for r in used if r["source"] == "big") == 0
    uses = {}
    for r in used:
        uses.setdefault((r["source"], r["doc_id"]), []).append(r["repeat"])
    assert all(sorted(v) == list(range(len(v))) and len(v) <= dict((t[0], t[2]) for t in TARGETS)[k[0]] for k, v in uses.items())
    assert [r["position"] for r in used] == sorted(r["position"] for r in used) and 0 < used[0]["position"] and used[-1]["position"] < 1


def test_the_schedule_varies_over_time(spark):
    used = mixing.mix(documents(spark, 4_000), spark.createDataFrame(TARGETS, M), mixing.EXACT).collect()
    share = lambda rows, s: sum(r["n_tokens"] for r in rows if r["source"] == s) / sum(r["n_tokens"] for r in rows)
    early, late = [r for r in used if r["position"] < 0.3], [r for r in used if r["position"] > 0.7]
    assert share(early, "big") > share(late, "big") + 0.05 and share(early, "tiny") < share(late, "tiny")
    half = [r for r in used if r["position"] < 0.5]
    assert abs(sum(r["n_tokens"] for r in half) / sum(r["n_tokens"] for r in used) - 0.5) < 0.02, "weights sum to 1 at every moment"


def test_given_schedules(spark):
    """Weights 0, 0, 2, 0: nothing before a third of the way, most at two thirds."""
    d, m = documents(spark, 4_000), spark.createDataFrame(TARGETS, M)
    used = [r for r in mixing.mix(d, m, mixing.EXACT, schedules={"tiny": [0, 0, 2, 0]}).collect() if r["source"] == "tiny"]
    assert min(r["position"] for r in used) > 1 / 3 - 1e-6 and max(r["position"] for r in used) < 1
    tokens = sum(r["n_tokens"] for r in used)
    assert abs(sum(r["n_tokens"] for r in used if r["position"] < 2 / 3) / tokens - 0.5) < 0.02
    assert mixing.integrated([1, 3]) == ([0.5, 1.5], [0.0, 1.0])
    with pytest.raises(ValueError):
        mixing.integrated([0, 0])


def test_moments_invert_the_integral(spark):
    weights, sums = mixing.integrated([0.0, 3.0, 1.0, 1.0, 0.0])
    ys = [0.0, 0.01, 0.2, sums[1], 0.5, sums[2], 0.8, 0.99, 1.0]
    df = spark.createDataFrame([(y, weights, sums) for y in ys], "y double, w array<double>, s array<double>")
    for y, t in df.select("y", mixing.due_at(df.y, df.w, df.s)).collect():
        k = min(int(t * 4), 3)
        u = t - k / 4
        assert sums[k] + weights[k] * u + (weights[k + 1] - weights[k]) * 4 * u * u / 2 == pytest.approx(y, abs=1e-9)


def test_a_total_beyond_supply(spark):
    report = {r["source"]: r for r in mixing.shares(documents(spark), spark.createDataFrame(TARGETS, M), total=10**9).collect()}
    assert {s: report[s]["most_uses"] for s in ("big", "small", "tiny")} == {"big": 1, "small": 2, "tiny": 3}
    assert report["big"]["used_tokens"] == report["big"]["supply_tokens"]


def test_buckets_give_the_same_sums(spark, monkeypatch):
    counts = mixing.token_counts(documents(spark))
    one = sorted(tuple(r) for r in mixing.running(counts).collect())
    monkeypatch.setattr(mixing, "BUCKET", 17)
    assert sorted(tuple(r) for r in mixing.running(counts).collect()) == one
    for s in ("big", "small", "tiny"):
        rows = sorted((r for r in one if r[1] == s), key=lambda r: r[3])
        at = 0
        for r in rows:
            assert r[3] == at
            at += r[2]


def test_counting(spark):
    text = "Über 3 <|endoftext|> words, and 漢字 " * 9_000
    df = spark.createDataFrame([(1, "a", text), (2, "a", None), (3, None, ""), (4, "a", "x" * 250_000)], D)
    got = {r["doc_id"]: r["n_tokens"] for r in mixing.token_counts(df).collect()}
    whole = lambda t: len(mixing._encoder(f"{mixing.TOKENIZERS}/{mixing.TOKENIZER}", mixing.PATTERN).encode_ordinary(t))
    assert got == {1: whole(text), 2: 0, 3: 0, 4: whole("x" * 250_000)}


def test_pieces_count_like_the_whole(monkeypatch):
    import random

    rng = random.Random(5)
    encoder = mixing._encoder(f"{mixing.TOKENIZERS}/{mixing.TOKENIZER}", mixing.PATTERN)
    monkeypatch.setattr(mixing, "PIECE", 7)
    for _ in range(300):
        text = "".join(rng.choice(["a", "word", " ", "  ", "\n", "'s", "3", "é", ".", "\u00a0", "\t x"]) for _ in range(rng.randint(0, 60)))
        assert "".join(mixing._pieces(text)) == text and sum(len(encoder.encode_ordinary(p)) for p in mixing._pieces(text)) == len(encoder.encode_ordinary(text))


@pytest.mark.parametrize("total", [mixing.ALL, mixing.EXACT, 3_000])
def test_against_a_plain_loop(spark, total):
    """Every use of a document, with its place in time, by walking each source's documents in the order of their hashes."""
    from pyspark.sql import functions as F

    d, m = documents(spark, 300), spark.createDataFrame(TARGETS, M)
    rows = mixing.token_counts(d).withColumn("h", F.xxhash64("doc_id")).collect()
    supply = {s: sum(r["n_tokens"] for r in rows if r["source"] == s) for s, _, _ in TARGETS}
    usable = sorted((s, share, cap) for s, share, cap in TARGETS if supply[s])
    whole = sum(x[1] for x in usable)
    goal = {mixing.ALL: sum(supply.values()), mixing.EXACT: min(supply[s] * cap * whole / share for s, share, cap in usable)}.get(total, total)
    mean = sum(i * x[1] for i, x in enumerate(usable)) / whole
    spread = max(abs(i - mean) for i in range(len(usable)))
    want = {}
    for i, (s, share, cap) in enumerate(usable):
        slope = mixing.SWING * (i - mean) / spread
        wanted, at = goal * share / whole, 0
        for repeat in range(cap):
            for r in sorted((r for r in rows if r["source"] == s), key=lambda r: (r["h"], r["doc_id"])):
                y = (at + r["n_tokens"] / 2) / wanted
                if at + r["n_tokens"] / 2 <= wanted:
                    # The integral of 1 - slope + 2 slope t up to t is y.
                    want[r["doc_id"], repeat] = y if abs(slope) < 1e-12 else (-(1 - slope) + ((1 - slope) ** 2 + 4 * slope * y) ** 0.5) / (2 * slope)
                at += r["n_tokens"]
    got = {(r["doc_id"], r["repeat"]): r["position"] for r in mixing.mix(d, m, total).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_edges(spark):
    d = spark.createDataFrame([(1, "a", "x y", 1), (1, "a", "x y", 1), (None, "a", "z", 1), (2, None, "q", 1), (3, "b", None, 1)], D + ", start int")
    m = spark.createDataFrame([("a", 1.0, 1), ("b", 0.5, 2), (None, 0.2, 1), ("c", None, None)], M)
    assert sorted(r["n_tokens"] for r in mixing.mix(d, m).collect()) and {r["source"] for r in mixing.mix(d, m).collect()} == {"a"}
    assert mixing.mix(d.limit(0), m).count() == 0 and mixing.mix(d, m.limit(0)).count() == 0
    assert mixing.shares(d.limit(0), m).count() == 3 and mixing.shares(d, m.limit(0)).count() == 0


def test_registered_mix_of_all_tokens_repeats_and_runs_short(spark, tmp_path):
    import __spark_entry__ as entry

    docs = [(i, "big", "some plain words here") for i in range(60)] + [(100 + i, "few", "some plain words here") for i in range(10)] + [(200, "one", "some plain words here")]
    spark.createDataFrame(docs, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 0.5, 1), ("few", 0.4, 3), ("one", 0.1, 1)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = {r["source"]: (r["n_uses"], r["most_uses"]) for r in entry.queries()["p8_shares"](spark, str(tmp_path)).collect()}
    # Of 71 documents 35.5, 28.4 and 7.1 are wanted; the last whose middle lies within the demand is used.
    assert got["few"] == (28, 3) and got["one"] == (1, 1) and got["big"][0] in (35, 36) and got["big"][1] == 1
    assert entry.queries()["p8_mix"](spark, str(tmp_path)).where("repeat = 2").count() == 8
