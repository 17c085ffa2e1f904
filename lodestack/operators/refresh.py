"""Refreshing the catalog: differences, deletions, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import paths as P


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the one with the greatest ``order``; ties go to the greatest row.

    The aggregate combines before the shuffle.  Null keys are left out.
    """
    others = [c for c in rows.columns if c not in (key, order)]
    best = F.max(F.struct(order, *others)).alias("r")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *(F.col(f"r.{c}").alias(c) for c in [order, *others])).select(*rows.columns)


def differences(new: DataFrame, old: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """``(*keys, size, mtime_ms, status)``: added, updated, removed or unchanged.

    Both sides have one row a key.  A removed path shows its old size and time.
    """
    side = lambda df, n: df.select(*keys, F.coalesce("size", F.lit(0)).alias(f"size_{n}"), F.coalesce("mtime_ms", F.lit(0)).alias(f"mtime_{n}"))
    both = side(new, "new").join(side(old, "old"), list(keys), "full_outer")
    same = (F.col("size_new") == F.col("size_old")) & (F.col("mtime_new") == F.col("mtime_old"))
    status = (
        F.when(F.col("size_old").isNull(), "added").when(F.col("size_new").isNull(), "removed").when(same, "unchanged").otherwise("updated")
    )
    return both.select(*keys, F.coalesce("size_new", "size_old").alias("size"), F.coalesce("mtime_new", "mtime_old").alias("mtime_ms"), status.alias("status"))


def removed(old: DataFrame, seen: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    return old.join(seen.select(*keys), list(keys), "left_anti")


def kept(old: DataFrame, seen: DataFrame) -> DataFrame:
    return old.join(seen.select("path").distinct(), "path", "left_semi")


def parse_queue(diff: DataFrame, content: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """``(*keys, size, reason)`` of files whose text has to be extracted.

    Added and updated documents, and unchanged ones that have no text yet.
    """
    docs = diff.where("status <> 'removed'").where(P.parse_kind(F.col("path"), F.col("size")) != "none")
    fresh = docs.where("status in ('added', 'updated')").select(*keys, "size", F.col("status").alias("reason"))
    lacking = docs.where("status = 'unchanged'").join(content.select("path"), "path", "left_anti")
    return fresh.unionByName(lacking.select(*keys, "size", F.lit("backfill").alias("reason")))


def stale_content(diff: DataFrame, content: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Keys of ``diff`` whose stored text no longer holds: removed or updated files, whatever their size now."""
    return diff.where("status in ('removed', 'updated')").select(*keys).join(content.select("path"), "path", "left_semi").select(*keys)


def upsert(table: DataFrame, rows: DataFrame, key: str = "path") -> DataFrame:
    """``rows`` replace the rows of their keys; both have one row a key."""
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def without(table: DataFrame, paths: DataFrame) -> DataFrame:
    return table.join(paths.select("path").distinct(), "path", "left_anti").select(*table.columns)


def removal_count(paths: DataFrame, *tables: DataFrame) -> DataFrame:
    """One row: how many of the (distinct, exact) paths some table has."""
    asked = paths.where("path is not null").select("path").distinct()
    known = tables[0].select("path")
    for t in tables[1:]:
        known = known.unionByName(t.select("path"))
    return asked.join(known, "path", "left_semi").agg(F.count("*").alias("removed"))


def in_tree(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or lies below it."""
    out = F.lit(False)
    for r in roots:
        r = r.rstrip("/") or "/"
        out = out | (path == r) | path.startswith(r if r == "/" else r + "/")
    return out


def external_rows(feed: DataFrame, root: Column) -> DataFrame:
    """Rows of an external feed (``path, kind``) that are valid below ``root``; size and time are 0."""
    ok = feed.where(F.col("path").isNotNull() & P.valid_external(F.col("path"), root) & (P.base_name(F.col("path")) != ""))
    return ok.select("path", P.base_name(F.col("path")).alias("name"), F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mtime_ms"), "kind")
