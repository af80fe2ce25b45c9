"""Queries of the core operators by name: Spark plans here, the same in SQL in :mod:`threadloom.plans.oracle`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import text, timestamps
from threadloom.functions.timestamps import with_utc_micros
from threadloom.operators import filters, hierarchy, hotkeys, multipart, naming, order, ranges, store
from threadloom.operators.packed import explode_packed
from threadloom.plans import manifests, oracle
from threadloom.schema import ARTICLES
from threadloom.session import checkpoint_dir, tasks
from threadloom.sources import overview, records

Query = Callable[[SparkSession, str], DataFrame]

#: The moment that ages are counted from: 2024-03-01 00:00 UTC.
ASOF_US = 1_709_251_200_000_000
#: Dates already in the stored form: with an offset, to the second.
STORED_FORM = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{2}:\d{2}$"
GROUP = "orb.binaries.scans"

_REGISTERED: dict[str, Query] = {}


def query(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a query over the articles table."""
    _REGISTERED[f.__name__] = lambda spark, sf_dir: f(table(spark, sf_dir, "articles"))
    return f


def tables(f: Query) -> Query:
    """Register a query that picks its own tables."""
    _REGISTERED[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Problems of large collections


@query
def p2_found(a: DataFrame) -> DataFrame:
    return hotkeys.heavy_posters(a)


@query
def p2_totals(a: DataFrame) -> DataFrame:
    return hotkeys.poster_totals(a)


@query
def p4_found(a: DataFrame) -> DataFrame:
    return hierarchy.thread_roots(a)


@query
def p4_trees(a: DataFrame) -> DataFrame:
    return hierarchy.thread_trees(a)


@query
def p4_descendants(a: DataFrame) -> DataFrame:
    return hierarchy.thread_descendants(a)


@query
def p5_found(a: DataFrame) -> DataFrame:
    odd = a.select("ord", "date_utc").where(~F.col("date_utc").rlike(STORED_FORM))
    return with_utc_micros(odd, "date_utc", "utc_us").where("utc_us IS NOT NULL").select("ord", "utc_us")


@query
def p5_all(a: DataFrame) -> DataFrame:
    return with_utc_micros(a.select("ord", "date_utc"), "date_utc", "utc_us").select("ord", "utc_us")


@tables
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_packed(table(spark, sf_dir, "articles"), "ord", {"refs": "angle", "xref": "entry"}, table(spark, sf_dir, "newsgroups"), min_values=2)


@tables
def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_packed(table(spark, sf_dir, "articles"), "ord", {"refs": "angle", "xref": "entry"}, table(spark, sf_dir, "newsgroups"))


# Searches


@query
def articles_projection(a: DataFrame) -> DataFrame:
    return filters.search(a)


@query
def group_filter(a: DataFrame) -> DataFrame:
    return filters.search(a, group=GROUP)


@query
def subject_like(a: DataFrame) -> DataFrame:
    return filters.search(a, subject_like="WINDOW").select("ord", "subject")


@query
def subject_like_wildcard(a: DataFrame) -> DataFrame:
    return filters.search(a, subject_like="p_rt%OF 2").select("ord", "subject")


@query
def subject_like_terms(a: DataFrame) -> DataFrame:
    return filters.search(a, subject_like="yenc%Garden%", terms=True).select("ord", "subject")


@query
def poster_like(a: DataFrame) -> DataFrame:
    return filters.search(a, from_like="Grum & sons").select("ord", "from_addr")


@query
def subject_not_any(a: DataFrame) -> DataFrame:
    return filters.search(a, not_subject="yenc | part | re:").select("ord", "subject")


@query
def poster_not_any(a: DataFrame) -> DataFrame:
    return filters.search(a, not_from="example|robot").select("ord", "from_addr")


@query
def combined_filters(a: DataFrame) -> DataFrame:
    return filters.search(a, group=GROUP, subject_like="yenc", from_like="a", not_subject=".exe|.nfo", not_from="anon").select("ord", "subject", "from_addr")


@query
def order_by_artnum(a: DataFrame) -> DataFrame:
    """Every article in the order of its number within its group, with its place there."""
    by = [F.col(c).asc() for c in ("group_name", "artnum", "ord")]
    return order.numbered(a.select("ord", "group_name", "artnum"), by, "place", ["group_name"])


@query
def order_by_artnum_limit(a: DataFrame) -> DataFrame:
    """The ten oldest articles of every group."""
    n = F.row_number().over(Window.partitionBy("group_name").orderBy("artnum", "ord"))
    return a.select("ord", "group_name", "artnum").withColumn("place", n.cast("bigint")).where("place <= 10")


@query
def order_by_poster_subject(a: DataFrame) -> DataFrame:
    """The place of every article in the order of poster, subject and number, which groups collections."""
    by = [F.coalesce("from_addr", F.lit("")), F.coalesce("subject", F.lit("")), F.col("artnum").asc(), F.col("ord").asc()]
    return order.numbered(a.select("ord", "from_addr", "subject", "artnum"), by).select("ord", "place")


# Storage


@query
def dedup_first_wins(a: DataFrame) -> DataFrame:
    return store.first_wins(a).select("ord", "group_name", "message_id")


@query
def dedup_by_message_id(a: DataFrame) -> DataFrame:
    return store.first_wins(a, ("message_id",)).select("ord", "message_id")


@query
def null_ids_kept(a: DataFrame) -> DataFrame:
    return store.first_wins(a).where("message_id IS NULL").groupBy("group_name").agg(F.count("*").alias("n"))


@tables
def upsert_ignore_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire records inserted into the stored articles: what is added."""
    stored = table(spark, sf_dir, "articles")
    batch = records.articles(table(spark, sf_dir, "overviews"))
    return store.insert_or_ignore(stored, batch, order="artnum").select("group_name", "artnum", "message_id")


@tables
def high_water_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.high_water(table(spark, sf_dir, "articles"), table(spark, sf_dir, "newsgroups"))


@tables
def next_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "newsgroups")
    return ranges.next_range(spark, store.high_water(table(spark, sf_dir, "articles")), groups)


@tables
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "newsgroups")
    return g.select("group_name", store.article_count(F.col("first_article"), F.col("last_article")).alias("article_count"))


@tables
def groups_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after the groups of the stored articles are listed anew."""
    a = table(spark, sf_dir, "articles")
    new = a.groupBy("group_name").agg(F.min("artnum").alias("first_article"), F.max("artnum").alias("last_article"), F.lit("y").alias("status_flag"), F.max("ord").alias("ord"))
    new = new.withColumn("article_count", store.article_count(F.col("first_article"), F.col("last_article")))
    old = table(spark, sf_dir, "newsgroups").withColumn("last_updated", F.col("last_updated").cast("timestamp"))
    asof = F.timestamp_micros(F.lit(ASOF_US))
    return store.replace_groups(old, new, asof).select("group_name", "first_article", "last_article", "article_count", "status_flag", F.unix_micros("last_updated").alias("updated_us"))


# Text


@query
def subject_base(a: DataFrame) -> DataFrame:
    return a.select("ord", text.subject_base(F.col("subject")).alias("base"))


@query
def counters(a: DataFrame) -> DataFrame:
    (nl, ml), (nr, mr) = text.counter_left(F.col("subject")), text.counter_right(F.col("subject"))
    return a.select("ord", nl.alias("n_left"), ml.alias("m_left"), nr.alias("n_right"), mr.alias("m_right"))


@query
def message_id_text(a: DataFrame) -> DataFrame:
    return a.select("ord", text.message_id_text(F.col("message_id")).alias("id"))


@query
def sanitize_filename(a: DataFrame) -> DataFrame:
    return a.select("ord", text.sanitize_filename(F.substring("subject", 1, 30)).alias("name"))


@query
def collection_name(a: DataFrame) -> DataFrame:
    return a.select("ord", text.collection_name(F.col("subject")).alias("collection"))


@query
def collection_name_without_term(a: DataFrame) -> DataFrame:
    return a.select("ord", text.collection_name(F.col("subject"), "lantern%file").alias("collection"))


@query
def to_iso(a: DataFrame) -> DataFrame:
    """Every date as UTC in the stored form; NULL where it denotes no instant."""
    return with_utc_micros(a.select("ord", "date_utc"), "date_utc", "us").select("ord", timestamps.to_iso(F.col("us")).alias("iso"))


# Multipart posts


def kept(a: DataFrame) -> DataFrame:
    return store.first_wins(a)


@query
def singles(a: DataFrame) -> DataFrame:
    return multipart.singles(kept(a)).select("ord", "base")


@query
def strategy_choice(a: DataFrame) -> DataFrame:
    return multipart.strategy(kept(a), [])


@query
def strategy_by_group(a: DataFrame) -> DataFrame:
    return multipart.strategy(kept(a), ["group_name"])


@query
def strategy_by_collection(a: DataFrame) -> DataFrame:
    return multipart.strategy(naming.with_collection(kept(a)), ["group_name", "poster", "collection"])


@query
def set_sizes(a: DataFrame) -> DataFrame:
    return multipart.sets(kept(a), ["group_name"]).select("group_name", "base", "m", "poster", "n_rows", "n_parts", "first_pos", F.col("total_bytes").cast("bigint").alias("total_bytes"), "complete", "is_program")


@query
def complete_sets(a: DataFrame) -> DataFrame:
    return multipart.emitted(kept(a), ["group_name"], True).select("group_name", "base", "m", "poster", "n_rows", "first_pos")


@query
def missing_parts(a: DataFrame) -> DataFrame:
    """Missing parts as ranges, of sets of any total."""
    return multipart.missing_ranges(kept(a), ["group_name"])


@query
def programs_dropped(a: DataFrame) -> DataFrame:
    """Sets that a manifest leaves out by name, the subjects taken without their quotes (a closing quote hides the ending)."""
    bare = kept(a).withColumn("subject", F.translate("subject", '"', ""))
    return multipart.sets(bare, ["group_name"]).where("is_program").select("group_name", "base", "m", "poster", "n_rows")


@query
def segments_sorted(a: DataFrame) -> DataFrame:
    segs = manifests.segments(kept(a), ["group_name"], True, "ord")
    n = F.row_number().over(Window.partitionBy("group_name", "base", "m", "poster").orderBy("number", "pos"))
    return segs.select("group_name", "base", "m", "poster", n.cast("bigint").alias("place"), "number", "bytes", "id")


@query
def collections(a: DataFrame) -> DataFrame:
    return naming.collections(kept(a)).select("group_name", "poster", "collection", "n_rows")


@query
def collection_files(a: DataFrame) -> DataFrame:
    return naming.numbered_files(kept(a))


@query
def collection_files_complete(a: DataFrame) -> DataFrame:
    return naming.numbered_files(kept(a), None, True)


@query
def manifest_single(a: DataFrame) -> DataFrame:
    return manifests.single(kept(a), F.lit(ASOF_US // 1_000_000), None, True)


@query
def manifest_grouped(a: DataFrame) -> DataFrame:
    return manifests.grouped(kept(a), F.lit(ASOF_US // 1_000_000), None, True)


@query
def manifest_totals(a: DataFrame) -> DataFrame:
    """Per group: collections, collections with something to emit, and those skipped."""
    all_ = naming.collections(kept(a)).groupBy("group_name").agg(F.count("*").alias("n_collections"))
    out = naming.numbered_files(kept(a), None, True).groupBy("group_name").agg(F.count("*").alias("n_files"))
    return all_.join(out, "group_name", "left").select("group_name", "n_collections", F.coalesce("n_files", F.lit(0)).alias("n_files"), (F.col("n_collections") - F.coalesce("n_files", F.lit(0))).alias("n_skipped"))


# Ranges


@query
def age_days(a: DataFrame) -> DataFrame:
    """Age of every article whose date denotes an instant, in whatever form it is written."""
    dated = with_utc_micros(a.select("ord", "date_utc"), "date_utc", "us").where("us IS NOT NULL")
    return dated.select("ord", (F.floor(ranges.age_days(F.col("us"), ASOF_US) * 1000) / 1000.0).alias("age"))


@query
def date_boundaries(a: DataFrame) -> DataFrame:
    """Bounds by age over the instants of all articles, with the ages of the two bounds."""
    dated = with_utc_micros(a.select("group_name", "artnum", "date_utc"), "date_utc", "us")
    bounds = ranges.date_bounds(dated, "group_name", "artnum", "us", 200.0, 400.0, ASOF_US)
    milli = lambda c: F.floor(F.col(c) * 1000) / 1000.0
    return bounds.withColumns({"lower_age": milli("lower_age"), "upper_age": milli("upper_age")})


@tables
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.chunk_plan(table(spark, sf_dir, "newsgroups"), 1_000)


@tables
def chunk_plan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.chunk_plan(table(spark, sf_dir, "newsgroups"), 100, 250)


@tables
def chunk_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored articles per planned chunk: chunks are equal steps from a group's first article, so the chunk is computed, not range-joined."""
    g, a = table(spark, sf_dir, "newsgroups"), table(spark, sf_dir, "articles")
    plan = ranges.chunk_plan(g, 1_000)
    at = a.join(g.select("group_name", "first_article", "last_article"), "group_name").where("artnum BETWEEN first_article AND last_article")
    n = at.groupBy("group_name", (F.col("first_article") + F.floor((F.col("artnum") - F.col("first_article")) / 1_000) * 1_000).alias("chunk_start")).agg(F.count("*").alias("n"))
    return plan.join(n, ["group_name", "chunk_start"], "left").select("group_name", "chunk_start", F.coalesce("n", F.lit(0)).alias("n"))


# Sources


@tables
def overview_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.with_iso_dates(records.articles(table(spark, sf_dir, "overviews")))


@tables
def overview_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records read through the data source, in chunks of article numbers."""
    overview.register(spark)
    got = spark.read.format("overview").options(path=f"{sf_dir}/overviews.parquet".removeprefix("file://"), group="*", max_workers=str(tasks(spark))).load()
    return records.with_iso_dates(got.drop("chunk_error"))


@tables
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that the transport lists."""
    overview.register(spark)
    return spark.read.format("overview").options(path=f"{sf_dir}/overviews.parquet".removeprefix("file://"), mode="groups").load()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stored(a: DataFrame) -> DataFrame:
    return a.select("ord", *ARTICLES.names)


@tables
def upsert_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table after the articles and then the wire records were inserted into it."""
    path = _folder(spark, "articles")
    store.upsert_headers(_stored(table(spark, sf_dir, "articles")), path, order="ord")
    store.upsert_headers(records.articles(table(spark, sf_dir, "overviews")).withColumn("ord", F.col("artnum")), path)
    return store.stored_articles(spark, path).select("group_name", "artnum", "message_id")


@tables
def reload_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table after the groups of the wire records were loaded anew."""
    path = _folder(spark, "articles")
    store.upsert_headers(_stored(table(spark, sf_dir, "articles")), path, order="ord")
    store.reload(records.articles(table(spark, sf_dir, "overviews")).withColumn("ord", F.col("artnum")), path)
    return store.stored_articles(spark, path).select("group_name", "artnum", "message_id")


@query
def archive_roundtrip(a: DataFrame) -> DataFrame:
    """All articles written as an archive of JSON lines and read again."""
    path = _folder(a.sparkSession, "archive")
    store.archive(a.select(*ARTICLES.names), path)
    return store.read_archive(a.sparkSession, path)


@query
def manifests_read_back(a: DataFrame) -> DataFrame:
    """The segments of all manifests of complete sets, written as XML files and read by the XML reader (an element without an id is none to it)."""
    spark = a.sparkSession
    path = _folder(spark, "manifests")
    local = path.removeprefix("file:")
    made = manifests.grouped(kept(a), F.lit(ASOF_US // 1_000_000), None, True)
    # Spark's readers leave out files whose names begin with an underscore, as those of some posters do.
    manifests.write(made.withColumn("file_name", F.concat(F.lit("m"), F.sha2(F.concat_ws("/", "group_name", "file_name"), 256), F.lit(".nzb"))), local, by_group=True)
    return manifests.flat(manifests.read(spark, f"{path}/*")).select("number", "bytes", "id")


@query
def file_reduction(a: DataFrame) -> DataFrame:
    """Per group the manifests with and without grouping by collection."""
    return naming.numbered_files(kept(a), None, True).groupBy("group_name").agg(F.sum("n_sets").alias("n_ungrouped"), F.count("*").alias("n_grouped"))


@tables
def nzb_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.flat(table(spark, sf_dir, "nzb_files"))


@tables
def nzb_segments_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest segments with the stored article of their id in the manifest's groups."""
    segs = manifests.flat(table(spark, sf_dir, "nzb_files")).select("subject", "number", "id").distinct()
    a = kept(table(spark, sf_dir, "articles")).select("group_name", "artnum", text.message_id_text(F.col("message_id")).alias("id")).where("id <> ''")
    return segs.join(a, "id").select("subject", "number", "id", "group_name", "artnum")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_sets(table(spark, sf_dir, "articles"))


def queries() -> dict[str, Query]:
    return dict(_REGISTERED)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.statements(ASOF_US, GROUP).items() if k in _REGISTERED}
