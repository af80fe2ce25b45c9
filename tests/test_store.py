import random
import sqlite3

from threadloom.operators import ranges, store

COLS = "ord bigint, message_id string, group_name string, artnum bigint"


def test_first_wins_like_the_original_engine(spark):
    rng = random.Random(5)
    batches = [[(i, rng.choice([None, *"abcdef"]), rng.choice(["g", "g", None]), rng.choice([1, 2, None])) for i in range(k * 40, k * 40 + 40)] for k in range(2)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (ord INTEGER, message_id TEXT PRIMARY KEY, group_name TEXT NOT NULL, artnum INTEGER NOT NULL)")
    for b in batches:
        db.executemany("INSERT OR IGNORE INTO t VALUES (?, ?, ?, ?)", b)
    stored = store.first_wins(spark.createDataFrame(batches[0], COLS), ("message_id",))
    both = stored.unionByName(store.insert_or_ignore(stored, spark.createDataFrame(batches[1], COLS), ("message_id",)))
    assert sorted(r[0] for r in both.collect()) == sorted(r[0] for r in db.execute("SELECT ord FROM t"))


def test_survivor_does_not_depend_on_partitions(spark, rows):
    df = spark.createDataFrame([(i, f"m{i % 7}", "g", i) for i in range(200)], COLS)
    assert rows(store.first_wins(df)) == rows(store.first_wins(df.repartition(13))) == sorted([(i, f"m{i}", "g", i) for i in range(7)], key=repr)


def test_tables_on_disk(spark, tmp_path, rows):
    path = str(tmp_path / "articles")
    df = spark.createDataFrame([("m1", "g", 1, "s"), ("m2", "g", 2, "s"), ("m1", "g", 3, "t"), (None, "h", 4, "u")], "message_id string, group_name string, artnum bigint, subject string")
    store.upsert_headers(df, path)
    store.upsert_headers(df.where("message_id IS NOT NULL"), path)
    assert rows(spark.read.parquet(path).select("message_id", "group_name", "artnum")) == rows(spark.createDataFrame([("m1", "g", 1), ("m2", "g", 2), (None, "h", 4)]))
    store.reload(df.where("group_name = 'g'").limit(1), path)
    assert spark.read.parquet(path).where("group_name = 'g'").count() == 1 and spark.read.parquet(path).where("group_name = 'h'").count() == 1
    marks = {r[0]: (r[1], r[2]) for r in store.high_water(spark.read.parquet(path), spark.createDataFrame([("g",), ("none",)], "group_name string")).collect()}
    assert marks == {"g": (1, 1), "none": (0, 0)}


def test_archives(spark, tmp_path):
    from threadloom.schema import ARTICLES

    df = spark.createDataFrame([("m", "g", 1, None, "p", "d", None, 5, 6, None)], ARTICLES)
    store.archive(df, str(tmp_path / "lines"))
    assert store.read_archive(spark, str(tmp_path / "lines")).collect() == df.collect()
    (tmp_path / "array.json").write_text('[\n{"message_id": "m", "group_name": "g", "artnum": 1, "from_addr": "p", "date_utc": "d", "bytes": 5, "lines": 6}]')
    assert store.read_archive(spark, str(tmp_path / "array.json"), array=True).collect() == df.collect()


def test_chunks():
    assert ranges.plan_chunks(1, 10, chunk=4) == [(1, 4), (5, 8), (9, 10)]
    assert ranges.plan_chunks(1, 10, 6, 4) == [(1, 4), (5, 6)]
    assert ranges.plan_chunks(1, 10, 100, 4) == ranges.plan_chunks(1, 10, 0, 4)
    assert ranges.plan_chunks(5, 4) == []


def test_range_choice(tmp_path):
    from threadloom import config

    ini = tmp_path / "a.ini"
    ini.write_text("[groups]\nnames = a.b , c.d\n[filters]\nlocal_min = 5\nlocal_max = 9\nmin_days = 1\nmax_days = 2\n[nzb]\ngroup_by_collection = true\n")
    s = config.load(str(ini))
    assert s.groups == ("a.b", "c.d") and s.group_by_collection and s.max_workers == 5
    assert ranges.resolve_range(s, (1, 2)) == (5, 9)
    none = config.load(str(tmp_path / "missing.ini"))
    assert ranges.resolve_range(none, (1, 2), lambda a, b: (9, 3)) == (1, 2)
    assert ranges.resolve_range(config.Settings(min_days=1, max_days=2), (1, 2), lambda a, b: (9, 3)) == (3, 9)


def test_tables_in_a_catalog(spark):
    for _ in range(2):  # the second call finds them there
        store.ensure_tables(spark)
    assert spark.table("articles").columns[-1] == "group_name" and len(spark.table("articles").columns) == 10
    assert spark.table("newsgroups").count() == 0
    for t in ("articles", "newsgroups"):
        spark.sql(f"DROP TABLE {t}")


def test_catalog_lines_replace(spark):
    from pyspark.sql import functions as F

    cols = "group_name string, first_article bigint, last_article bigint, article_count bigint, status_flag string"
    old = spark.createDataFrame([("a", 1, 5, 5, "y"), ("b", 1, 1, 1, None)], cols).withColumn("last_updated", F.lit("2020-01-01").cast("timestamp"))
    new = spark.createDataFrame([("a", 2, 6, 5, "m", 1), ("a", 3, 7, 5, "n", 2), ("c", 1, 0, 0, "y", 3)], cols + ", ord bigint")
    got = {r["group_name"]: (r["first_article"], r["status_flag"], r["last_updated"].year) for r in store.replace_groups(old, new, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {"a": (3, "n", 2024), "b": (1, None, 2020), "c": (1, "y", 2024)}


def test_what_an_insertion_reports(spark, tmp_path):
    from threadloom.schema import ARTICLES

    df = spark.createDataFrame([(f"<{i}>", "123", i, "s", None, None, None, 7, 1, None) for i in range(9)], ARTICLES)
    first = store.upsert_headers(df, str(tmp_path / "t"))
    again = store.upsert_headers(df, str(tmp_path / "t"))
    assert (first["rows"], first["bytes"]) == (9, 63) and again["rows"] == 0 and first["seconds"] > 0
    assert store.stored_articles(spark, str(tmp_path / "t")).where("group_name = '123'").count() == 9
