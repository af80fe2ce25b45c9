import os
from xml.dom import minidom
from xml.etree import ElementTree

from pyspark.sql import functions as F

from threadloom.plans import manifests

COLS = "message_id string, subject string, from_addr string, date_utc string, bytes bigint, artnum bigint, group_name string"


def sample(spark):
    return spark.createDataFrame(
        [
            ("<b&1@x>", 'q"<&\t (2/2)', "A & B", None, None, 2, "g.h"),
            ("<a@x>", 'q"<&\t (1/2)', "A & B", None, 7, 1, "g.h"),
            (None, "lost (1/3)", None, None, 5, 3, "g.h"),
            ("<c@x>", "bad\u0001 (1/1)", "C", None, 5, 4, "g.h"),
        ],
        COLS,
    )


def expected(files):
    """The document as the standard library writes it."""
    root = ElementTree.Element("nzb", xmlns=manifests.NAMESPACE)
    for poster, subject, group, segs in files:
        f = ElementTree.SubElement(root, "file", poster=poster, date="99", subject=subject)
        ElementTree.SubElement(ElementTree.SubElement(f, "groups"), "group").text = group
        s = ElementTree.SubElement(f, "segments")
        for n, b, i in segs:
            ElementTree.SubElement(s, "segment", bytes=str(b), number=str(n)).text = i
    lines = minidom.parseString(ElementTree.tostring(root, encoding="unicode")).toprettyxml(indent="  ").split("\n")
    return "\n".join([lines[0], manifests.DOCTYPE, *lines[1:]])


def test_single(spark):
    (doc,) = manifests.single(sample(spark), F.lit(99)).collect()
    want = expected([("A & B", 'q"<&', "g.h", [(1, 7, "a@x"), (2, 0, "b&1@x")]), ("", "lost", "g.h", [(1, 5, "")]), ("C", "bad", "g.h", [(1, 5, "c@x")])])
    assert doc["xml"] == want and doc["file_name"] == "output.nzb"
    (whole,) = manifests.single(sample(spark), F.lit(99), require_complete=True).collect()
    assert whole["xml"].count("<file ") == 2
    empty = manifests.single(sample(spark).where("subject LIKE 'lost%'"), F.lit(99), require_complete=True).collect()
    assert empty[0]["xml"] == expected([])
    assert manifests.single(sample(spark), F.lit(99), "no such").count() == 0


def test_escapes_of_attributes(spark):
    df = spark.createDataFrame([("<a>", 'x\ny\t"z (1/1) e', "p\r", None, 1, 1, "g")], COLS)
    (doc,) = manifests.single(df, F.lit(99)).collect()
    assert doc["xml"] == expected([("p\r", 'x\ny\t"z  e', "g", [(1, 1, "a")])])


def test_grouped_written_read_and_split(spark, tmp_path):
    docs = manifests.grouped(sample(spark), F.lit(99))
    manifests.write(docs, str(tmp_path / "out"))
    manifests.write(docs, str(tmp_path / "apart"), by_group=True)
    assert sorted(os.listdir(tmp_path / "out")) == sorted(r["file_name"] for r in docs.collect()) == sorted(os.listdir(tmp_path / "apart" / "g.h"))
    back = manifests.flat(manifests.read(spark, str(tmp_path / "out")))
    assert sorted((r["number"], r["id"] or "") for r in back.collect()) == [(1, "a@x"), (1, "c@x"), (2, "b&1@x")], "the reader leaves out an element without text"
    small = manifests.PIECES
    manifests.PIECES = 2
    try:
        cut = manifests.grouped(sample(spark), F.lit(99))
        assert cut.agg(F.max("block")).first()[0] >= 2
        manifests.write(cut, str(tmp_path / "cut"))
    finally:
        manifests.PIECES = small
    for name in os.listdir(tmp_path / "out"):
        assert (tmp_path / "cut" / name).read_bytes() == (tmp_path / "out" / name).read_bytes()
    assert len(os.listdir(tmp_path / "cut")) == len(os.listdir(tmp_path / "out"))
    assert manifests.folder_name("../x") == ".._x" and manifests.folder_name("..") == "_.."
    one = tmp_path / "one.nzb"
    one.write_text(expected([("p", "A/b? name", "g", [(1, 1, "x")]), ("p", "//", "g", [(1, 1, "y")])]))
    assert manifests.split(spark, str(one), str(tmp_path / "split")) == 2
    assert sorted(os.listdir(tmp_path / "split")) == ["00001_Ab name.nzb", "00002_file_2.nzb"]
    assert (tmp_path / "split" / "00001_Ab name.nzb").read_text() == expected([("p", "A/b? name", "g", [(1, 1, "x")])])
