"""The search tables built from the raw ones: written once a session, then asked.

A search engine answers from its index.  ``search_store`` builds that index (one
row a path with lowered names, folders and types, cleaned texts, grams of the
texts) below the shared folder, the first time a session asks for it, and again
when the files it was made from have changed.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodestack.operators import search as S
from lodestack.session import table, work_path
from lodestack.store import Store

_built: dict[tuple, Store] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """What tells whether a file or folder of files is still the same."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.getFileStatus(at)
    files = [status] if status.isFile() else list(fs.listStatus(at))
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def build(spark: SparkSession, d: str) -> Store:
    """A new store of the names and texts of ``d``."""
    store = Store(spark, work_path(spark, "search"))
    store.write({"catalog": S.standing_catalog(table(spark, d, "name_record")), "content": S.standing_content(table(spark, d, "content_store"))})
    return store


def search_store(spark: SparkSession, d: str) -> Store:
    key = (spark.sparkContext.applicationId, d, *(_state(spark, f"{d}/{t}.parquet") for t in ("name_record", "content_store")))
    if key not in _built:
        _built[key] = build(spark, d)
    return _built[key]
