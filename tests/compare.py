"""Runs queries and their SQL side by side and compares the rows."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings catalog_snapshot snapshot_head scan_feed scan_run "
    "name_record content_store query_log eval_item lang_sample pack_spec"
).split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(_plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


def _plain(v):
    if pd.isna(v):
        return None
    return v if isinstance(v, str) else int(v) if float(v).is_integer() else float(v)


def differences(spark, con, name, query, sql, sf_dir) -> str:
    """Empty if the query and its SQL give the same columns and rows."""
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"{name}: columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if a == b:
        return ""
    first = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"{name}: {len(a)} and {len(b)} rows; first differences {first}"
