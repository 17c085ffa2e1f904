"""Retrieval, ranking and merging of names, folders, texts and external entries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import paths as P
from lodestack.functions import text as X
from lodestack.plans.query_language import QueryFilter, lower_simple

# fixed values
WORD_WEIGHT = 4
SOURCES = ["names", "content", "folders", "external"]
SHARES = [(1, 2), (1, 4), (3, 20), (1, 10)]

HIT = ["path", "name", "size", "mtime_ms", "matched", "kind", "snippet"]


def standing_catalog(rows: DataFrame) -> DataFrame:
    """One row a path, the one stored last (greatest name_id); empty names are left out.

    Null size and mtime read as 0, a null name as the last segment of its path, a
    null kind as ``file``, a null origin as ``main``; null paths are left out.
    """
    name = F.coalesce("name", P.base_name(F.col("path")))
    last = rows.where("path is not null").groupBy("path").agg(F.max(F.struct("name_id", name.alias("name"), "size", "mtime_ms", "kind", "origin")).alias("r"))
    rows = last.where("r.name <> ''").select("path", "r.name", *(F.coalesce(f"r.{c}", F.lit(d)).alias(c) for c, d in (("size", 0), ("mtime_ms", 0), ("kind", "file"), ("origin", "main"))))
    return stored_catalog(rows)


def stored_catalog(rows: DataFrame) -> DataFrame:
    """Catalog rows (path, name, size, mtime_ms, kind, origin) with what searches ask for: lowered name and folder, type."""
    path = F.col("path")
    lowered = {"name_lower": X.lower_simple(F.col("name")), "parent_lower": X.lower_simple(P.parent_of(path)), "ftype": P.file_type(path)}
    return rows.select("path", "name", *(c.alias(n) for n, c in lowered.items()), F.col("size").cast("bigint").alias("size"), F.col("mtime_ms").cast("bigint").alias("mtime_ms"), "kind", "origin")


def stored_text(raw: Column) -> Column:
    return X.truncate_bytes(X.normalize_for_store(raw), X.MAX_TEXT_BYTES)


def standing_content(rows: DataFrame) -> DataFrame:
    """``(path, text, text_lower)``: the text committed last for a path, in its stored form.

    Blank texts are no documents; a blank text committed later takes the document
    away.  Null paths and null texts are left out.
    """
    last = rows.where("path is not null and text is not null").groupBy("path").agg(F.max(F.struct("indexed_at", "row_id", "text")).alias("r"))
    return stored_content(last.select("path", F.col("r.text").alias("text")))


def stored_content(rows: DataFrame) -> DataFrame:
    """Texts as extracted (path, text) in their stored form, with the lowered text; blank ones are left out.

    Each form is computed once: what follows reads the column, not its expression.
    """
    clean = rows.select("path", X.once(stored_text(F.col("text"))).alias("text")).where(~X.is_blank(F.col("text")))
    return clean.select("path", "text", X.lower_simple(F.col("text")).alias("text_lower"))


def name_matches(catalog: DataFrame, query: str) -> DataFrame:
    """Rows whose lowered name holds the whole query as one text; none for an empty query."""
    q = lower_simple(query.strip())
    return catalog.where(F.contains("name_lower", F.lit(q)) if q else F.lit(False))


def name_order() -> list[Column]:
    """Short names first (bytes), then the newest, then by path."""
    return [F.octet_length("name").asc(), F.col("mtime_ms").desc(), F.col("path").asc()]


def content_terms(query: str) -> list[str]:
    """The terms of a content query: in stored form, lowered, split at white space.

    What a stored text never holds (control characters, the replacement
    character) is dropped from the query as well.
    """
    return [t for t in re.split(X.SPACE_PY, lower_simple(X.stored_form(query.strip()))) if t]


def content_matches(content: DataFrame, terms: list[str]) -> DataFrame:
    """Texts that hold every term."""
    if not terms:
        return content.where(F.lit(False))
    return content.where(reduce(lambda a, b: a & b, [F.contains("text_lower", F.lit(t)) for t in terms]))


def prefiltered(content: DataFrame, grams: DataFrame, terms: list[str]) -> DataFrame:
    """``content_matches`` over the texts that have every gram of the terms.

    ``grams``: gram, path, tf; the index says where to look, the text decides.
    """
    if not terms:
        return content.where(F.lit(False))
    return content_matches(content.join(gram_candidates(grams, "path", terms).select("path"), "path", "left_semi"), terms)


def query_words(terms: list[str]) -> list[str]:
    return [w for w in re.findall(r"[a-z0-9]+|[^\x00-\x7f]+", " ".join(terms).replace(" ", "\n")) if len(w) > 1]


def _is(word: str):
    return lambda x: x == word


def content_score(terms: list[str]) -> Column:
    """Occurrences of the terms' character pairs, and four times those of their words."""
    lowered = F.col("text_lower")
    pairs = [X.gram_count(lowered, g) for t in terms for g in X.term_grams(t)]
    score = reduce(lambda a, b: a + b, pairs, F.lit(0).cast("bigint"))
    wanted = query_words(terms)
    if wanted:
        once = X.words(lowered)
        hits = reduce(lambda a, b: a + b, [F.size(F.filter(once, _is(w))) for w in wanted])
        score = score + WORD_WEIGHT * hits.cast("bigint")
    return score


def enriched(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Size and time of content hits from the catalog; 0 where it has no such path."""
    known = catalog.where("origin = 'main' and kind = 'file'").select("path", "size", "mtime_ms")
    return hits.join(known, "path", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("size", "mtime_ms")})


def filtered(hits: DataFrame, f: QueryFilter, stored: bool = False) -> DataFrame:
    """Hits of the wanted types and folders; ``stored``: from the columns kept for it."""
    if not stored:
        return hits.where(P.matches_types(F.col("kind"), F.col("path"), f.types) & P.matches_dirs(F.col("path"), f.dirs))
    for d in f.dirs:
        hits = hits.where(F.contains("parent_lower", F.lit(lower_simple(d))))
    if f.types:
        hits = hits.where(F.col("kind") != "folder")
        if "file" not in f.types:
            hits = hits.where(F.col("ftype").isin(f.types))
    return hits


def branches(catalog: DataFrame, content: DataFrame, f: QueryFilter, filter_external: bool = False, grams: DataFrame | None = None) -> dict[str, DataFrame]:
    """``named`` (with its source: names, folders, external) and ``content`` hits of a query, filtered.

    External entries are filtered only on demand.  One pass over the catalog
    serves its three sources; with ``grams`` the texts are looked up there first.
    """
    hits = name_matches(catalog, f.joined)
    wanted = filtered(hits, f, stored=True)
    if not filter_external and (f.types or f.dirs):
        wanted = hits.where("origin = 'external'").unionByName(wanted.where("origin <> 'external'"))
    source = F.when(F.col("origin") == "external", "external").when(F.col("kind") == "folder", "folders").otherwise("names")
    terms = content_terms(f.joined)
    texts = content_matches(content, terms) if grams is None else prefiltered(content, grams, terms)
    texts = filtered(texts.withColumn("kind", F.lit("file")), f).withColumn("score", content_score(terms))
    return {
        "named": wanted.where("origin in ('main', 'external')").select("path", "name", "size", "mtime_ms", "kind", source.alias("source")),
        "content": texts.select("path", P.base_name(F.col("path")).alias("name"), "kind", "text", "text_lower", "score"),
    }


def totals(b: dict[str, DataFrame], limit: int) -> DataFrame:
    """One row: how many each retrieval has, exactly, after filtering, and how many hits the list shows (``total``)."""
    counted = b["named"].select("source", "kind").unionByName(b["content"].select(F.lit("content").alias("source"), "kind"))
    of = lambda *n: F.count_if(F.col("source").isin(*n))
    file, folder = F.col("kind") != "folder", F.col("kind") == "folder"
    return counted.agg(
        F.least(F.count("*"), F.lit(limit)).alias("total"),
        F.count("*").alias("total_matches"),
        F.count_if(F.col("source").isin("names") | (F.col("source") == "external") & file).alias("total_files"),
        F.count_if(F.col("source").isin("folders") | (F.col("source") == "external") & folder).alias("total_dirs"),
        of("content").alias("total_content"),
    )


def caps(limit: int) -> dict[str, int]:
    return {s: limit * a // b for s, (a, b) in zip(SOURCES, SHARES)}


def ranked_content(hits: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` content hits (path, score, ...) with their place ``rn``: by score, then path."""
    order = [F.col("score").desc(), F.col("path").asc()]
    return hits.orderBy(*order).limit(limit).withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def merged(b: dict[str, DataFrame], catalog: DataFrame, limit: int, terms: list[str]) -> DataFrame:
    """At most ``limit`` hits: each source's share first, then what is left, in order of the sources.

    Each source gives its best ``limit`` rows only (a limit inside the rank, taken
    before rows travel), so what is numbered is small.
    """
    last = ((F.col("source") == "external") & (F.col("kind") == "folder")).asc()  # external folders after external files
    rank = F.row_number().over(Window.partitionBy("source").orderBy(last, *name_order()))
    named = b["named"].withColumn("rn", rank).where(F.col("rn") <= limit)
    named = named.select("source", "rn", "path", "name", "size", "mtime_ms", F.lit("name").alias("matched"), "kind", F.lit("").alias("snippet"))
    snip = X.snippet(F.col("text"), F.col("text_lower"), terms[0]) if terms else F.lit("")
    texts = enriched(ranked_content(b["content"], limit), catalog)
    texts = texts.select(F.lit("content").alias("source"), "rn", "path", "name", "size", "mtime_ms", F.lit("content").alias("matched"), "kind", snip.alias("snippet"))
    return quota(named.unionByName(texts), limit)


def quota(rows: DataFrame, limit: int) -> DataFrame:
    """Two rounds over ranked rows (``source, rn``): shares, then the rest; adds ``pos``."""
    cap, ordinal = F.lit(0), F.lit(len(SOURCES))
    for k, s in enumerate(SOURCES):
        cap = F.when(F.col("source") == s, caps(limit)[s]).otherwise(cap)
        ordinal = F.when(F.col("source") == s, k).otherwise(ordinal)
    rows = rows.withColumn("round", F.when(F.col("rn") <= cap, 1).otherwise(2)).withColumn("ordinal", ordinal)
    pos = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("round", "ordinal", "rn"))
    return rows.withColumn("pos", pos.cast("bigint")).where(F.col("pos") <= limit).drop("round", "ordinal")


def page_of() -> Column:
    """The page of the result list a hit is on: 0 files by name, 1 content, 2 folders."""
    return F.when(F.col("matched") == "content", 1).when(F.col("kind") == "folder", 2).otherwise(0).cast("bigint")


def shown_order(by: str = "name") -> list[Column]:
    """Order of the result list: by UTF-16 length and lowered name, or the newest first."""
    if by == "mtime":
        return [F.col("mtime_ms").desc(), F.col("path").asc()]
    return [(F.octet_length(F.encode("name", "UTF-16BE")) / 2).asc(), X.lower_simple(F.col("name")).asc(), F.col("path").asc()]


# --- inverted indexes --------------------------------------------------------


def gram_postings(rows: DataFrame, key: str, text: str, both: bool) -> DataFrame:
    """``(gram, key, tf)``: character pairs, and single characters if ``both``; combined before the shuffle."""
    grams = X.uni_bigrams(F.col(text)) if both else X.bigrams(F.col(text))
    return rows.select(F.col(key), F.explode(grams).alias("gram")).groupBy("gram", key).agg(F.count("*").alias("tf"))


def word_postings(content: DataFrame) -> DataFrame:
    """``(term, path, tf)`` of the words of texts."""
    return content.select("path", F.explode(X.words(F.col("text_lower"))).alias("term")).groupBy("term", "path").agg(F.count("*").alias("tf"))


def gram_candidates(postings: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """``(key, score)`` of the documents that have every gram of the terms.

    One aggregation instead of a join per gram; a gram that occurs twice in the
    terms counts twice in the score.
    """
    grams = [g for t in terms for g in X.term_grams(t)]
    times = {g: grams.count(g) for g in grams}
    weight = reduce(lambda acc, g: F.when(F.col("gram") == g, times[g]).otherwise(acc), times, F.lit(0))
    return (
        postings.where(F.col("gram").isin(list(times)))
        .groupBy(key)
        .agg(F.count("*").alias("have"), F.sum(F.col("tf") * weight).alias("score"))
        .where(F.col("have") == len(times))
        .drop("have")
    )
