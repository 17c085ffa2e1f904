"""Queries over names, texts and refreshes, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import paths as P
from lodestack.functions import text as X
from lodestack.operators import refresh as R
from lodestack.operators import search as S
from lodestack.operators.snapshots import delivery_order, standing_rows
from lodestack.plans.query_language import QueryFilter, limit_of, parse_log, parse_query
from lodestack.plans.stored import search_store
from lodestack.session import table

NAME_QUERY = "report"
CONTENT_QUERY = "storage report"
SEARCH = "type:doc report"
TREE = ["/storage/card0"]
LIMIT = 300


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return search_store(spark, d).read("catalog")


def _content(spark: SparkSession, d: str) -> DataFrame:
    return search_store(spark, d).read("content")


def name_search(spark: SparkSession, d: str) -> DataFrame:
    return S.name_matches(_catalog(spark, d), NAME_QUERY).select("path", "name", "size", "mtime_ms", "kind", "origin")


def _placed(rows: DataFrame, order: list) -> DataFrame:
    """Few rows with their place in an order."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("bigint"))


def name_rank(spark: SparkSession, d: str) -> DataFrame:
    """The best 100 names, with their place."""
    best = S.name_matches(_catalog(spark, d), NAME_QUERY).orderBy(*S.name_order()).limit(100)
    return _placed(best, S.name_order()).select("pos", "path", F.octet_length("name").cast("bigint").alias("name_bytes"))


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    rows = table(spark, d, "catalog_snapshot").where("path is not null").select("path").distinct()
    return rows.select("path", P.base_name(p).alias("name"), P.ext_of(p).alias("ext"), P.parent_of(p).alias("parent"))


def lower_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "name_record").select("name_id", X.lower_simple(F.col("name")).alias("lowered"))


def name_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return S.gram_postings(_catalog(spark, d), "path", "name_lower", False)


def type_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.filtered(_catalog(spark, d), QueryFilter(types=["doc", "video"]), stored=True).select("path", "ftype")


def dir_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.filtered(_catalog(spark, d), QueryFilter(dirs=["Emulated", "re"]), stored=True).select("path", P.parent_of(F.col("path")).alias("parent"))


def ext_type_stats(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d).where("kind <> 'folder'")
    return c.groupBy("ftype").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def ui_category(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d)
    return c.groupBy(P.category(F.col("path")).alias("category"), "kind").agg(F.count("*").alias("n"))


def prune_dirs(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered path, and whether a scan of its root would list it."""
    rows = table(spark, d, "catalog_snapshot").where("path is not null and scan_root is not null").select("path", "scan_root", (F.col("list_name") == "dirs").alias("folder")).distinct()
    kept = P.is_kept(F.col("path"), F.col("scan_root"), F.coalesce("folder", F.lit(False)))
    return rows.groupBy("path").agg(F.max(kept.cast("int")).cast("bigint").alias("kept"))


def parse_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = R.last_of(table(spark, d, "scan_feed").select("path", "feed_id", "size"), "path", "feed_id")
    return rows.select("path", P.parse_kind(F.col("path"), F.coalesce("size", F.lit(0))).alias("parser"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    t = X.normalize_for_store(F.col("text"))
    return table(spark, d, "content_store").select("row_id", t.alias("text"), X.is_blank(t).cast("int").cast("bigint").alias("blank"))


def truncate_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_store").select("row_id", X.truncate_bytes(F.col("text"), X.MAX_TEXT_BYTES).alias("cut"))


def content_search(spark: SparkSession, d: str) -> DataFrame:
    return S.content_matches(_content(spark, d), S.content_terms(CONTENT_QUERY)).select("path", F.length("text").cast("bigint").alias("chars"))


def content_rank(spark: SparkSession, d: str) -> DataFrame:
    """The best 300 texts, with their place."""
    terms = S.content_terms(CONTENT_QUERY)
    hits = S.content_matches(_content(spark, d), terms).select("path", S.content_score(terms).alias("score"))
    return S.ranked_content(hits, limit_of(LIMIT)).select(F.col("rn").cast("bigint").alias("pos"), "path", "score")


def content_enrich(spark: SparkSession, d: str) -> DataFrame:
    hits = S.content_matches(_content(spark, d), S.content_terms(CONTENT_QUERY)).select("path")
    return S.enriched(hits, _catalog(spark, d))


def snippet(spark: SparkSession, d: str) -> DataFrame:
    c = S.content_matches(_content(spark, d), ["report"])
    return c.select("path", X.snippet(F.col("text"), F.col("text_lower"), "report").alias("snippet"))


def gram_index(spark: SparkSession, d: str) -> DataFrame:
    """The postings, made anew from the texts."""
    return S.gram_postings(S.standing_content(table(spark, d, "content_store")), "path", "text_lower", True)


def gram_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have every gram of the terms, then those that have the terms."""
    terms = S.content_terms(CONTENT_QUERY)
    store = search_store(spark, d)
    content, found = store.read("content"), S.gram_candidates(store.read("grams"), "path", terms)
    whole = S.content_matches(content, terms).select("path", F.lit(1).cast("bigint").alias("verified"))
    return found.join(whole, "path", "left").select("path", "score", F.coalesce("verified", F.lit(0)).alias("verified"))


def word_tf(spark: SparkSession, d: str) -> DataFrame:
    return S.word_postings(_content(spark, d))


def _branches(spark: SparkSession, d: str) -> tuple[dict, DataFrame, list[str]]:
    f = parse_query(SEARCH)
    catalog = _catalog(spark, d)
    return S.branches(catalog, _content(spark, d), f, grams=search_store(spark, d).read("grams")), catalog, S.content_terms(f.joined)


def search_totals(spark: SparkSession, d: str) -> DataFrame:
    return S.totals(_branches(spark, d)[0], limit_of(LIMIT))


def search_merged(spark: SparkSession, d: str) -> DataFrame:
    b, catalog, terms = _branches(spark, d)
    return S.merged(b, catalog, limit_of(LIMIT), terms).select("pos", "source", *S.HIT)


def quota_union(spark: SparkSession, d: str) -> DataFrame:
    b, catalog, terms = _branches(spark, d)
    return S.merged(b, catalog, 20, terms).select("pos", "source", F.col("rn").cast("bigint").alias("rn"), "path")


def tab_views(spark: SparkSession, d: str) -> DataFrame:
    b, catalog, terms = _branches(spark, d)
    hits = S.merged(b, catalog, limit_of(LIMIT), terms)
    return hits.groupBy(P.category(F.col("path")).alias("category"), S.page_of().alias("page")).agg(F.count("*").alias("n"))


def ui_sort(spark: SparkSession, d: str) -> DataFrame:
    best = S.name_matches(_catalog(spark, d), NAME_QUERY).orderBy(*S.shown_order()).limit(200)
    return _placed(best, S.shown_order()).select("pos", "path", "name")


def parsed_queries(spark: SparkSession, d: str) -> DataFrame:
    return parse_log(table(spark, d, "query_log"))


#: What tells the rows of several deliveries and lists apart.
KEYS = ("snap_id", "list_name", "path")


def _deliveries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both lists of all valid deliveries: old and new rows of every consecutive pair under the later snap_id, and the rows of all."""
    order = delivery_order(table(spark, d, "snapshot_head"))
    rows = standing_rows(table(spark, d, "catalog_snapshot").where("list_name in ('names', 'dirs')"), F.broadcast(order))
    under = lambda ids: rows.join(F.broadcast(ids), "ord").select(*KEYS, "size", "mtime_ms")
    return under(order.select((F.col("ord") - 1).alias("ord"), "snap_id")), under(order.where("ord > 1")), under(order)


def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    old, new, _ = _deliveries(spark, d)
    return R.differences(new, old, KEYS)


def scan_stats(spark: SparkSession, d: str) -> DataFrame:
    return incremental_diff(spark, d).groupBy("snap_id", "list_name", "status").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def removed_paths(spark: SparkSession, d: str) -> DataFrame:
    old, new, _ = _deliveries(spark, d)
    return R.removed(old, new, KEYS).select(*KEYS)


def backfill_docs(spark: SparkSession, d: str) -> DataFrame:
    return R.parse_queue(incremental_diff(spark, d), _content(spark, d), KEYS)


def stale_content(spark: SparkSession, d: str) -> DataFrame:
    return R.stale_content(incremental_diff(spark, d), _content(spark, d), KEYS)


def upsert(spark: SparkSession, d: str) -> DataFrame:
    old, new, _ = _deliveries(spark, d)
    return R.upsert(old, new, list(KEYS))  # an unchanged row replaces itself, so no difference is needed


def full_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Each delivery, the first too, as a full scan; external folders go with the list of folders."""
    *_, scanned = _deliveries(spark, d)
    ids = delivery_order(table(spark, d, "snapshot_head")).select("snap_id")
    external = _catalog(spark, d).where("origin = 'external'").withColumn("list_name", F.when(F.col("kind") == "folder", "dirs").otherwise("names"))
    external = external.crossJoin(F.broadcast(ids)).select(*KEYS, "size", "mtime_ms", "origin")
    return external.unionByName(scanned.withColumn("origin", F.lit("main")))


def dedup_last(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "content_store").select("path", "row_id", F.length("text").cast("bigint").alias("chars"))
    return R.last_of(rows, "path", "row_id")


def remove_paths(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "scan_feed").select("path")
    return R.removal_count(asked, _catalog(spark, d), _content(spark, d))


def remove_tree(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).where(~R.in_tree(F.col("path"), TREE)).select("path", "kind")


def external_feed(spark: SparkSession, d: str) -> DataFrame:
    """All names as a feed of one card: those that are valid below it."""
    return R.external_rows(table(spark, d, "name_record").select("path", "kind").distinct(), F.lit("/storage/card0/"))


def display_format(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d)
    return c.select("path", P.size_text(F.col("size")).alias("size_text"), P.time_text(F.col("mtime_ms")).alias("time_text"), P.mime_type(F.col("path")).alias("mime"))


def ext_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Extension: sizes rolled up by origin and type."""
    c = _catalog(spark, d).select("origin", P.file_type(F.col("path")).alias("ftype"), "size")
    rolled = c.rollup("origin", "ftype").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return rolled.select(F.coalesce("origin", F.lit("*")).alias("origin"), F.coalesce("ftype", F.lit("*")).alias("ftype"), "n", "bytes")


def ext_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extension: events an hour and type."""
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("h", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def ext_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Extension: sessions of a user, split by half an hour without an event."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (
        name_search, name_rank, path_parts, lower_names, name_bigrams, type_filter, dir_filter, ext_type_stats, ui_category, prune_dirs, parse_gate,
        normalize_text, truncate_bytes, content_search, content_rank, content_enrich, snippet, gram_index, gram_candidates, word_tf, search_totals,
        search_merged, quota_union, tab_views, ui_sort, parsed_queries, incremental_diff, scan_stats, removed_paths, backfill_docs, stale_content,
        upsert, full_refresh, dedup_last, remove_paths, remove_tree, external_feed, display_format, ext_rollup, ext_event_windows, ext_sessions,
    )
}
