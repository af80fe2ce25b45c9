"""A training order in which every source has its target share of the tokens.

Sizes are tokens of a public tokenizer.  The curriculum varies over time: each source has a weight schedule,
linear between evenly spaced knots, whose mean is its target share.  The default schedules are ramps that sum
to 1 at every moment; others can be given.  Integrating a schedule gives the tokens that the source must have supplied by any moment; the
inverse of that integral gives the moment at which a document is due.  A document's training position is
that moment for the middle of its tokens, and documents are range-sorted by position.

The total is the tokens of all sources that a mixture can use (``ALL``), or a number: scarce sources are repeated, no document
more than ``max_repeats`` times, and a source that runs out supplies what it has.  With ``EXACT`` it is the largest total
for which every source that occurs meets its share, however much of the others that leaves out.
The shares of targets without documents go to the others in proportion.  Sources without a target
are left out.  Shares really reached are reported by :func:`shares`.

Running sums over a source are made from sums of buckets, so a source with most of the documents is not
summed in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import checkpoint

#: Folder of tokenizer files; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that belongs to that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: As a total: the tokens of all sources that a mixture can use, or the most that meets every share.
ALL, EXACT = "all", "exact"
#: Documents of one bucket, about, and how much a schedule swings around its mean.
BUCKET = 20_000
SWING = 0.6
#: A text longer than this is tokenized in pieces, cut where the pre-tokenizer cuts in any case.
PIECE = 100_000
#: Before a space between two characters that are none: the pattern always ends a piece there.
_CUT = re.compile(r"(?<=\S) (?=\S)")

_encoders: dict[str, object] = {}


def _encoder(path: str, pattern: str):
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces whose token counts add up to that of the whole; an unbroken stretch is never cut, however long."""
    at = 0
    while len(text) - at > PIECE and (cut := _CUT.search(text, at + PIECE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _counted(path: str, pattern: str, text_at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for b in batches:
            texts = b.column(text_at).to_pylist()
            n = [0 if t is None else sum(len(encoder.encode_ordinary(p)) for p in _pieces(t)) for t in texts]
            rest = [b.column(i) for i in range(b.num_columns) if i != text_at]
            names = [x for i, x in enumerate(b.schema.names) if i != text_at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64())], names=[*names, "n_tokens"])

    return run


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens``; NULL text has 0 tokens.  The tokenizer's path is a parameter; its file is on every worker."""
    rows = documents.select("doc_id", "source", "text")
    return rows.mapInArrow(_counted(f"{folder}/{tokenizer}", PATTERN, 2), "doc_id bigint, source string, n_tokens bigint")


Schedules = dict[str, list[float]]


def integrated(weights: list[float]) -> tuple[list[float], list[float]]:
    """A schedule's weights scaled to mean 1, and its integral up to each knot (0 to 1).  Weights are not negative and not all 0."""
    if len(weights) < 2 or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("a schedule has at least two weights, none negative and not all 0")
    k = len(weights) - 1
    pieces = [(a + b) / 2 / k for a, b in zip(weights, weights[1:])]
    whole = sum(pieces)
    sums = [0.0]
    for p in pieces:
        sums.append(sums[-1] + p / whole)
    return [w / whole for w in weights], [*sums[:-1], 1.0]


def plan(counts: DataFrame, targets: DataFrame, total: int | str = ALL, schedules: Schedules | None = None) -> DataFrame:
    """Per source: supply, renormalised share, tokens wanted, tokens that can be used, schedule and its integral (one row per source; sizes only)."""
    supply = counts.groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n_docs"))
    clean = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = clean.join(supply, "source", "left").fillna(0, ["supply", "n_docs", "target_share", "max_repeats"])
    able = (F.col("supply") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    rows = both.withColumn("able", able).collect()  # as many rows as the mixture has sources
    usable = [r for r in rows if r["able"]]
    whole = sum(r["target_share"] for r in usable) or 1.0
    most = min((r["supply"] * r["max_repeats"] * whole / r["target_share"] for r in usable), default=0)
    goal = float(most if total == EXACT else sum(r["supply"] for r in usable) if total == ALL else total)
    # Even ranks by source name around 0: the schedule of the first source falls, that of the last rises.
    usable.sort(key=lambda r: r["source"])
    mean = sum(i * r["target_share"] for i, r in enumerate(usable)) / whole
    spread = max([abs(i - mean) for i in range(len(usable))], default=0) or 1.0
    out = []
    for r in rows:
        share = r["target_share"] / whole if r["able"] else 0.0
        slope = SWING * (usable.index(r) - mean) / spread if r["able"] else 0.0
        weights, sums = integrated((schedules or {}).get(r["source"], [1 - slope, 1 + slope]))
        wanted = goal * share
        out.append((r["source"], float(r["target_share"]), int(r["max_repeats"]), int(r["supply"]), int(r["n_docs"]), share, wanted, min(wanted, float(r["supply"] * r["max_repeats"])), weights, sums))
    fields = "source string, target_share double, max_repeats bigint, supply bigint, n_docs bigint, share double, wanted double, used double, weights array<double>, sums array<double>"
    return counts.sparkSession.createDataFrame(out, fields)


def running(counts: DataFrame) -> DataFrame:
    """``counts`` and ``before``: tokens of the source's documents ahead of each, in an order drawn by hash."""
    order = F.xxhash64("doc_id")
    n = counts.count()
    buckets = n // BUCKET + 1
    placed = counts.withColumn("__h", order).withColumn("__b", F.floor((F.col("__h") / F.lit(2.0**64) + 0.5) * buckets).cast("int"))
    sums = placed.groupBy("source", "__b").agg(F.sum("n_tokens").alias("__n"))
    ahead = sums.select("source", "__b", (F.sum("__n").over(Window.partitionBy("source").orderBy("__b")) - F.col("__n")).alias("__a"))
    inside = Window.partitionBy("source", "__b").orderBy("__h", "doc_id")
    rows = placed.withColumn("__i", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return rows.join(ahead, ["source", "__b"]).select("doc_id", "source", "n_tokens", (F.col("__a") + F.col("__i")).alias("before"))


def due_at(y: Column, weights: Column, sums: Column) -> Column:
    """The moment at which a schedule's integral reaches ``y`` (0 to 1).

    Within a piece the integral from its left knot is w u + d u^2 / 2; its inverse is written without cancellation.
    """
    k = F.greatest(F.lit(0), F.least(F.size(F.filter(sums, lambda c: c <= y)), F.size(sums) - 1) - 1)
    n = F.size(sums) - 1
    w, after = F.get(weights, k), F.get(weights, k + 1)
    rest = y - F.get(sums, k)
    low = w + F.sqrt(F.greatest(w * w + 2 * (after - w) * n * rest, F.lit(0.0)))
    return k / n + F.when(low > 0, 2 * rest / low).otherwise(0.0)


def _scheduled(documents: DataFrame, targets: DataFrame, total: int | str, folder: str, schedules: Schedules | None) -> tuple[DataFrame, DataFrame]:
    counts = checkpoint(token_counts(documents, folder))
    sources = plan(counts, targets, total, schedules)
    used = sources.where("used > 0").select("source", "supply", "used", "wanted", "max_repeats", "weights", "sums")
    # One row per source of a mixture: sizes were computed from the collected plan, so the bound is proven.
    due = running(counts.where("n_tokens > 0")).join(F.broadcast(used), "source")
    passes = F.expr("sequence(0, least(max_repeats, bigint(ceil(used / supply))) - 1)")
    copies = due.select("*", F.explode(passes).alias("repeat")).withColumn("start", F.col("before") + F.col("repeat") * F.col("supply"))
    # The last document is the one whose middle still lies within the source's demand.
    copies = copies.where(F.col("start") + F.col("n_tokens") / 2 <= F.col("used"))
    y = (F.col("start") + F.col("n_tokens") / 2) / F.col("wanted")
    at = due_at(F.col("y"), F.col("weights"), F.col("sums"))
    copies = copies.withColumn("y", y)
    return copies.select("doc_id", "source", F.col("repeat").cast("bigint").alias("repeat"), "n_tokens", at.alias("position")), sources


def mix(documents: DataFrame, targets: DataFrame, total: int | str = ALL, folder: str = TOKENIZERS, schedules: Schedules | None = None) -> DataFrame:
    """``doc_id, source, repeat, n_tokens, position``: every use of a document with its training position in [0, 1], in that order.

    Documents with no tokens or no source, and of sources without target, are not used; an empty table or empty targets
    give no rows.  Ties of position go by doc_id and repeat.
    """
    return _scheduled(documents, targets, total, folder, schedules)[0].orderBy("position", "doc_id", "repeat")


def shares(documents: DataFrame, targets: DataFrame, total: int | str = ALL, folder: str = TOKENIZERS, schedules: Schedules | None = None) -> DataFrame:
    """Per listed source: target share, share wanted of the sources that occur, tokens used, share really reached, uses of the most used document."""
    used, sources = _scheduled(documents, targets, total, folder, schedules)
    used = checkpoint(used)
    got = used.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("n_uses"), (F.max("repeat") + 1).alias("most_uses"))
    whole = used.agg(F.sum("n_tokens")).first()[0] or 1
    report = sources.select("source", "target_share", F.col("share").alias("wanted_share"), "max_repeats", F.col("supply").alias("supply_tokens"), "n_docs").join(got, "source", "left")
    report = report.fillna(0, ["used_tokens", "n_uses", "most_uses"])
    return report.withColumn("actual_share", F.col("used_tokens") / F.lit(float(whole)))
