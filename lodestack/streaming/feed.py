"""Keeping tables up to date from a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import paths as P
from lodestack.operators.refresh import last_of
from lodestack.operators.search import stored_catalog
from lodestack.session import materialize
from lodestack.store import Store

CHANGE = "seq bigint, path string, size bigint, mtime_ms bigint, kind string, deleted boolean"


def change_feed(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of catalog changes from Parquet files that arrive in a folder."""
    return spark.readStream.schema(CHANGE).parquet(folder)


def apply_changes(store: Store, changes: DataFrame) -> None:
    """One batch of changes: the last of a path wins, deletions remove it."""
    last = materialize(last_of(changes.where("path <> ''"), "path", "seq"), "changes")
    rows = last.where("not coalesce(deleted, false)").select(
        "path",
        P.base_name(F.col("path")).alias("name"),
        F.coalesce("size", F.lit(0)).alias("size"),
        F.coalesce("mtime_ms", F.lit(0)).alias("mtime_ms"),
        F.coalesce("kind", F.lit("file")).alias("kind"),
        F.lit("main").alias("origin"),
    )
    gone = last.where("coalesce(deleted, false)").select("path")
    store.change({"catalog": stored_catalog(rows.where("name <> ''"))}, gone)


def follow(changes: DataFrame, store: Store, checkpoint: str, seconds: float | None = None):
    """Apply a change feed; without an interval what is there now is applied and the query ends.

    A batch that is delivered again after a failure gives the same tables.
    """

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            apply_changes(store, df)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events by window and type; rows later than ``late`` are left out."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(span, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("begins"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events by user and session, a session ending with a gap."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), "n")


def settled_queries(typed: DataFrame, pause: str = "150 milliseconds") -> DataFrame:
    """Of queries typed in a row (``user_id, ts, query``), the last before each pause."""
    s = typed.groupBy("user_id", F.session_window("ts", pause)).agg(F.max_by("query", "ts").alias("query"))
    return s.select("user_id", F.col("session_window.start").alias("begins"), "query")
