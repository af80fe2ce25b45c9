"""A third of all rows in one group: whole results."""

from pyspark.sql import functions as F

from threadloom.llm import leakage, lookalike, mixing, mojibake, neardup


def test_copies(spark):
    n = 300
    rows = [(i, ["a", "b", "c", "d", "e"] if i % 3 == 0 else [f"x{i}", f"y{i}", "b"]) for i in range(n)]
    got = neardup.similar_rows(spark.createDataFrame(rows, "ord bigint, words array<string>"), 0.6)
    assert got.count() == (n // 3) * (n // 3 - 1) // 2
    per_row = neardup.groups(spark.createDataFrame(rows, "ord bigint, words array<string>"), 0.6)
    assert per_row.count() == n and per_row.where("group_id = 0 AND n_links = 99").count() == n // 3


def test_hot_word(spark):
    df = spark.range(6_000).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "YsÃ¶lde x").otherwise("Ysölde y").alias("subject"), F.lit(None).cast("string").alias("from_addr"))
    assert mojibake.damaged_fields(df).count() == 2_000
    assert mojibake.restored_fields(df).where("restored = 'Ysölde x'").count() == 2_000
    docs = spark.range(6_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "rіbbоn").otherwise("ribbon").alias("text"))
    assert lookalike.canonical_text(docs).where("canonical = 'ribbon'").count() == 6_000 and lookalike.kinds_found(docs).count() == 2_000


def test_hot_source_and_hot_passage(spark):
    d = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"), F.lit("one two three four five six seven eight nine ten eleven").alias("text"))
    m = spark.createDataFrame([("hot", 0.6, 1), ("cold", 0.4, 2)], "source string, target_share double, max_repeats bigint")
    report = {r["source"]: r["actual_share"] for r in mixing.shares(d, m).collect()}
    assert abs(report["hot"] - 0.6) < 0.01
    e = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven twelve")], "item_id bigint, text string")
    assert leakage.leaked(d, e).count() == 3_000
