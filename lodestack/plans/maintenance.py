"""Queries over snapshots and feeds, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.operators.increments import new_or_changed
from lodestack.operators.snapshots import snapshot_changes
from lodestack.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "catalog_snapshot"), table(spark, sf_dir, "snapshot_head"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_or_changed(table(spark, sf_dir, "scan_feed"), table(spark, sf_dir, "scan_run")).select("run_no", "path")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found}

SQL = {
    "p1_found": """
        with heads as (
            select snap_id, row_number() over (order by max(saved_at), snap_id) as ord
            from snapshot_head where snap_version = 4 group by snap_id),
        standing as (
            select ord, list_name, path, arg_max(coalesce(size, 0), row_no) as size, arg_max(coalesce(mtime_ms, 0), row_no) as mtime_ms
            from catalog_snapshot join heads using (snap_id)
            where path not like '%/' group by ord, list_name, path),
        pairs as (
            select coalesce(n.ord, o.ord + 1) as ord, coalesce(n.list_name, o.list_name) as list_name, coalesce(n.path, o.path) as path,
                case when o.path is null then 'added' when n.path is null then 'removed'
                     when n.size <> o.size or n.mtime_ms <> o.mtime_ms then 'changed' end as change_kind
            from standing n full join standing o on n.ord = o.ord + 1 and n.list_name = o.list_name and n.path = o.path)
        select snap_id, list_name, path, change_kind from pairs join heads using (ord)
        where change_kind is not null and ord > 1""",
    "p2_found": """
        with runs as (
            select run_no, finished_at, lag(finished_at) over (order by finished_at, run_no) as before
            from scan_run where run_status = 'ok' and finished_at is not null),
        feed as (select distinct feed_id, path, coalesce(size, 0) as size, coalesce(mtime_ms, 0) as mtime_ms, arrived_at from scan_feed),
        force as (
            select r.run_no, f.path,
                arg_max((f.size, f.mtime_ms), (f.arrived_at, f.feed_id)) as now,
                arg_max((f.size, f.mtime_ms), (f.arrived_at, f.feed_id)) filter (where f.arrived_at <= r.before) as old
            from runs r join feed f on f.arrived_at <= r.finished_at group by r.run_no, f.path)
        select run_no, path from force where old is null or old <> now""",
}
