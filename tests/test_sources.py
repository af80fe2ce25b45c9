import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from threadloom.sources import overview, records
from threadloom.streaming.ingest import follow


@pytest.fixture
def wire(tmp_path):
    def put(n=25, bad=None):
        fields = [{"Subject": f"s{i}", "From": "p", ":bytes": "12" if i != bad else "x1", "Message-ID": f"<{i}@h>", "references": "<r>"} for i in range(n)]
        t = pa.table({"group_name": ["g"] * n, "artnum": pa.array(list(range(100, 100 + n)), pa.int64()), "fields": pa.array([list(f.items()) for f in fields], pa.map_(pa.string(), pa.string()))})
        pq.write_table(t, tmp_path / "wire.parquet")
        return str(tmp_path / "wire.parquet")

    return put


def load(spark, **o):
    overview.register(spark)
    return spark.read.format("overview").options(**{k: str(v) for k, v in o.items()}).load()


def test_chunks_and_limit(spark, wire):
    path = wire()
    df = load(spark, path=path, group="g", chunk=10)
    assert df.rdd.getNumPartitions() == 3 and df.count() == 25
    row = df.orderBy("artnum").first()
    assert (row["artnum"], row["subject"], row["bytes"], row["lines"], row["refs"], row["xref"]) == (100, "s0", 12, 0, "<r>", None)
    assert sorted(r["artnum"] for r in load(spark, path=path, group="g", chunk=2, limit=3).collect()) == [100, 101, 102]
    assert load(spark, path=path, group="g", start=120, end=122).count() == 3
    assert load(spark, path=path, group="none").count() == 0


def test_a_failing_chunk(spark, wire):
    path = wire(25, bad=13)
    with pytest.raises(Exception, match="invalid literal"):
        load(spark, path=path, group="g", chunk=10, strict="true").count()
    df = load(spark, path=path, group="g", chunk=10, strict="true", fail_on_error="false")
    assert df.where("chunk_error IS NULL").count() == 15
    assert "110-119" in df.where("chunk_error IS NOT NULL").first()["chunk_error"]
    assert load(spark, path=path, group="g").where("bytes IS NULL").count() == 1


def test_keys():
    assert overview.key_map(["X-Subject", ":Bytes", "DATE", "Lines:"]) == {"subject": "X-Subject", "bytes": ":Bytes", "date_utc": "DATE", "lines": "Lines:"}
    assert overview.number("", False) == 0 and overview.number(None, True) == 0 and overview.number("7", True) == 7


def test_records_as_a_table(spark):
    df = spark.createDataFrame([("g", 1, {":Bytes": "", "SUBJECT": "s", "message-id": "<m>"}), ("g", None, {"subject": "x"}), ("g", 2, None), ("g", 3, {"lines": "many"})], "group_name string, artnum bigint, fields map<string,string>")
    got = {r["artnum"]: r for r in records.articles(df).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1]["bytes"], got[1]["subject"], got[1]["message_id"], got[1]["from_addr"]) == (0, "s", "<m>", "")
    assert got[2]["subject"] == "" and got[2]["lines"] == 0 and got[3]["lines"] is None


def test_following_twice_adds_nothing(spark, wire, tmp_path):
    path, store = wire(12), str(tmp_path / "articles")
    for name in ("one", "two"):  # a fresh checkpoint reads everything again
        follow(spark, store, str(tmp_path / name), group="g", path=path, chunk="5").awaitTermination(60)
    assert spark.read.parquet(store).count() == 12
    wire(15)
    follow(spark, store, str(tmp_path / "two"), group="g", path=path, chunk="5").awaitTermination(60)
    assert spark.read.parquet(store).count() == 15


def test_core_stands_alone():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "threadloom"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "threadloom.llm" not in f.read_text(), f
