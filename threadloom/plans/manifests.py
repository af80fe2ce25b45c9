"""Manifests: the XML documents that list a post's segments, made, written, read and split."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import message_id_text
from threadloom.operators import multipart, naming
from threadloom.operators.filters import search
from threadloom.operators.order import numbered
from threadloom.schema import NZB_FILE
from threadloom.session import checkpoint

#: Pieces (segments, beginnings and ends of elements) of one block of a document.
PIECES = 50_000

# The document's declaration, type and namespace.
DECLARATION = '<?xml version="1.0" ?>'
DOCTYPE = '<!DOCTYPE nzb PUBLIC "-//newzbin//DTD NZB 1.1//EN" "http://www.newzbin.com/DTD/nzb/nzb-1.1.dtd">'
NAMESPACE = "http://www.newzbin.com/DTD/2003/nzb"


def _legal(c: Column) -> Column:
    return F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f￾￿]", "")


def escape_text(c: Column) -> Column:
    c = _legal(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_attribute(c: Column) -> Column:
    c = escape_text(c)
    for a, b in (('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def segments(df: DataFrame, scope: list[str], require_complete: bool = False, position: str = "artnum") -> DataFrame:
    """One row per segment of every emitted set: scope, base, m, poster, number, bytes, id, position."""
    rows = multipart.assign_sets(df, scope)
    keys = [*scope, "base", "m", "poster"]
    if require_complete:
        rows = rows.join(multipart.emitted(df, scope, True, position).select(*keys), keys, "left_semi")
    else:
        rows = rows.where(~F.endswith(F.lower("base"), F.lit(".exe")))
    return rows.select(*keys, F.col("n_right").alias("number"), F.coalesce("bytes", F.lit(0)).alias("bytes"), message_id_text(F.col("message_id")).alias("id"), F.col(position).alias("pos"))


def _open(poster: Column, date: Column, subject: Column, groups: Column) -> Column:
    names = F.array_join(F.transform(groups, lambda g: F.concat(F.lit("      <group>"), escape_text(g), F.lit("</group>\n"))), "")
    return F.concat(
        F.lit('  <file poster="'), escape_attribute(poster), F.lit('" date="'), date.cast("string"), F.lit('" subject="'), escape_attribute(subject), F.lit('">\n'),
        F.lit("    <groups>\n"), names, F.lit("    </groups>\n    <segments>\n"),
    )


def _segment(bytes_: Column, number: Column, mid: Column) -> Column:
    head = F.concat(F.lit('      <segment bytes="'), bytes_.cast("string"), F.lit('" number="'), number.cast("string"))
    return F.concat(head, F.when(mid == "", '"/>\n').otherwise(F.concat(F.lit('">'), escape_text(mid), F.lit("</segment>\n"))))


_CLOSE = "    </segments>\n  </file>\n"
_HEAD = f'{DECLARATION}\n{DOCTYPE}\n<nzb xmlns="{NAMESPACE}"'
_FOOT = "</nzb>\n"


def documents(parts: DataFrame, scope: list[str], date: Column, require_complete: bool = False, position: str = "artnum") -> DataFrame:
    """``scope, block, xml``: the documents of the sets that every scope has, each cut into blocks of at most ``PIECES`` pieces.

    A piece is the beginning or end of a document or of a file element, or a segment.  All pieces are put in order by one
    range sort, so neither a document nor a file element has to fit into one task; the blocks of a document, in order, make
    up its text.  Most documents are one block.  ``parts`` are rows with counters.
    """
    sets = checkpoint(multipart.emitted(parts, scope, require_complete, position).select(*scope, "base", "m", "poster", "first_pos"))
    keys = list(dict.fromkeys([*scope, "base", "m", "poster"]))
    rows = multipart.assign_sets(parts, scope)
    here = rows.join(sets.select(*keys, "first_pos"), keys)
    order = ["section", "first_pos", "base", "m", "__who", "kind", "number", "pos", "bytes", "id"]
    kinds = {"first_pos": "bigint", "base": "string", "m": "bigint", "__who": "string", "number": "bigint", "pos": "bigint", "bytes": "bigint", "id": "string"}

    def pieces(df: DataFrame, section: int, kind: int, xml: Column, **have: Column) -> DataFrame:
        rest = [have.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
        return df.select(*scope, F.lit(section).alias("section"), F.lit(kind).alias("kind"), *rest, xml.alias("xml"))

    of_set = {"first_pos": F.col("first_pos"), "base": F.col("base"), "m": F.col("m"), "__who": F.col("poster")}
    number, mid, size = F.col("n_right"), message_id_text(F.col("message_id")), F.coalesce("bytes", F.lit(0))
    whole = sets.select(*scope).distinct()
    all_ = (
        pieces(whole, 0, 0, F.lit(_HEAD + ">\n"))
        .unionByName(pieces(whole, 2, 0, F.lit(_FOOT)))
        .unionByName(pieces(sets, 1, 0, _open(F.col("poster"), date, F.col("base"), F.array("group_name")), **of_set))
        .unionByName(pieces(here, 1, 1, _segment(size, number, mid), **of_set, number=number, pos=F.col(position), bytes=size, id=mid))
        .unionByName(pieces(sets, 1, 2, F.lit(_CLOSE), **of_set))
    )
    placed = numbered(all_, [*[F.col(c) for c in scope], *[F.col(c).asc_nulls_last() for c in order]], "place", scope)
    block = F.floor((F.col("place") - 1) / PIECES).cast("bigint")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "xml"))), lambda x: x["xml"]), "")
    return placed.groupBy(*scope, block.alias("block")).agg(text.alias("xml"))


def single(df: DataFrame, date: Column, subject_like: str | None = None, require_complete: bool = False, **options) -> DataFrame:
    """``group_name, file_name, block, xml``: one document per group with all its matching sets.

    A group with matches but no set still gets an (empty) document; one without matches gets none.
    """
    hits = search(df, subject_like=subject_like, **options)
    name = "".join(c if c.isalnum() or c in " -_" else "_" for c in (subject_like or "")[:30]) or "output"
    parts = checkpoint(multipart.with_counters(hits))
    made = documents(parts, ["group_name"], date, require_complete)
    groups = parts.select("group_name").distinct()
    return groups.join(made, "group_name", "left").select(
        "group_name", F.lit(name + ".nzb").alias("file_name"), F.coalesce("block", F.lit(0)).cast("bigint").alias("block"), F.coalesce("xml", F.lit(_HEAD + "/>\n")).alias("xml")
    )


def grouped(df: DataFrame, date: Column, subject_like: str | None = None, require_complete: bool = False, **options) -> DataFrame:
    """``group_name, file_name, block, xml``: one document per poster and collection that has a set to emit."""
    hits = search(df, subject_like=subject_like, terms=True, **options)
    scope = ["group_name", "poster", "collection"]
    # Names and counters are read out of the subjects once.
    parts = checkpoint(multipart.with_counters(naming.with_collection(hits, subject_like)))
    made = checkpoint(documents(parts, scope, date, require_complete))
    named = naming.numbered(naming.collections(parts).join(made.where("block = 0").select(*scope), scope)).select(*scope, "file_name")
    return made.join(named, scope).select("group_name", "file_name", "block", "xml")


def folder_name(group: str | None) -> str:
    """A group's name as that of one folder: nothing in it leads elsewhere."""
    name = re.sub(r"[\\/\x00]", "_", group or "")
    return name if name.strip(".") else "_" + name


def write(documents: DataFrame, folder: str, by_group: bool = False) -> None:
    """Each document to its file below ``folder``, which all workers share; ``by_group``: a folder per group, so equal names do not meet.

    Blocks are written apart by the tasks that have them and then joined file by file, in order, without being held in memory.
    """

    def where(group: str, name: str) -> str:
        at = os.path.join(folder, folder_name(group)) if by_group else folder
        os.makedirs(at, exist_ok=True)
        return os.path.join(at, folder_name(name))

    def put(rows: Iterator) -> None:
        for r in rows:
            with open(f"{where(r['group_name'], r['file_name'])}.{r['block']}.part", "w", encoding="utf-8", newline="") as f:
                f.write(r["xml"])

    def join(rows: Iterator) -> None:
        for r in rows:
            path = where(r["group_name"], r["file_name"])
            parts = [f"{path}.{k}.part" for k in range(r["n"])]
            if not os.path.exists(parts[0]):  # done by an earlier attempt of this task
                continue
            with open(path + ".new", "wb") as out:
                for p in parts:
                    with open(p, "rb") as f:
                        shutil.copyfileobj(f, out)
            os.replace(path + ".new", path)
            for p in parts:
                os.remove(p)

    documents = checkpoint(documents.select("group_name", "file_name", "block", "xml"))
    documents.foreachPartition(put)
    last = F.max_by("group_name", "block").alias("group_name")
    keys = ["group_name", "file_name"] if by_group else ["file_name"]
    sizes = documents.groupBy(*keys).agg((F.max("block") + 1).alias("n"), *([] if by_group else [last]))
    sizes.foreachPartition(join)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The file elements of the manifests at ``path``."""
    return spark.read.format("xml").option("rowTag", "file").schema(NZB_FILE).load(path)


def flat(elements: DataFrame) -> DataFrame:
    """``poster, date, subject, n_groups, number, bytes, id`` of every segment of file elements."""
    seg = elements.select(
        F.col("_poster").alias("poster"), F.col("_date").alias("date"), F.col("_subject").alias("subject"), F.size(F.coalesce("groups.group", F.array().cast("array<string>"))).alias("n_groups"), F.explode("segments.segment").alias("s")
    )
    return seg.select("poster", "date", "subject", F.col("n_groups").cast("bigint").alias("n_groups"), F.col("s._number").alias("number"), F.col("s._bytes").alias("bytes"), F.col("s._VALUE").alias("id"))


def split_documents(spark: SparkSession, path: str) -> DataFrame:
    """``group_name, file_name, block, xml``: a document of its own for every file element of the manifest at ``path``, numbered in document order.

    The XML reader takes the manifest in splits; the place of a split in the file and of an element in it give the order.
    """
    names = F.coalesce("groups.group", F.array().cast("array<string>"))
    elements = read(spark, path).select("*", F.col("_metadata.file_path").alias("__p"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__r"))
    placed = numbered(checkpoint(elements), [F.col("__p"), F.col("__b"), F.col("__r")], "n")
    segs = F.transform(F.coalesce("segments.segment", F.array()), lambda s: _segment(F.coalesce(s["_bytes"], F.lit(0)), F.coalesce(s["_number"], F.lit(0)), F.coalesce(s["_VALUE"], F.lit(""))))
    subject, other = F.coalesce("_subject", F.lit("")), F.concat(F.lit("file_"), F.col("n").cast("string"))
    safe = F.trim(F.regexp_replace(F.substring(subject, 1, 80), r"[^\p{L}\p{N} _-]", ""))
    name = F.concat_ws("_", F.lpad(F.col("n").cast("string"), 5, "0"), F.when(safe == "", other).otherwise(safe))
    body = F.concat(_open(F.coalesce("_poster", F.lit("")), F.coalesce("_date", F.lit(0)), subject, names), F.array_join(segs, ""), F.lit(_CLOSE))
    return placed.select(F.get(names, F.lit(0)).alias("group_name"), F.concat(name, F.lit(".nzb")).alias("file_name"), F.lit(0).cast("bigint").alias("block"), F.concat(F.lit(_HEAD + ">\n"), body, F.lit(_FOOT)).alias("xml"))


def split(spark: SparkSession, path: str, folder: str) -> int:
    """Write one manifest per file element of the manifest at ``path``; returns how many."""
    made = checkpoint(split_documents(spark, path))
    write(made, folder)
    return made.count()
