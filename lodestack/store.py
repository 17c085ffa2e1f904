"""Versioned tables: folders of Parquet in buckets of path hashes, named by manifests.

A write makes new folders and then publishes a manifest whose number is one
higher; readers keep the version they opened.  Changes (``change``) read and
write only the buckets whose paths they touch, so a small change costs its
buckets, not the table.  The grams of the texts are kept in the same buckets,
sorted by gram: an index sharded by document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.manifests import Manifests
from lodestack.operators import refresh as R
from lodestack.operators import search as S

FORMAT = 5
#: Buckets of a new store; a store keeps the number it began with.
BUCKETS = 16
_S, _L = T.StringType(), T.LongType()
_COLUMNS = {
    "catalog": (("path", _S), ("name", _S), ("name_lower", _S), ("parent_lower", _S), ("ftype", _S), ("size", _L), ("mtime_ms", _L), ("kind", _S), ("origin", _S)),
    "content": (("path", _S), ("text", _S), ("text_lower", _S)),
    "grams": (("gram", _S), ("path", _S), ("tf", _L)),
}
SCHEMAS = {t: T.StructType([T.StructField(n, k) for n, k in columns]) for t, columns in _COLUMNS.items()}
#: How rows lie in the files of a bucket, so that statistics prune.
_SORTED = {"catalog": ("origin", "kind", "path"), "content": ("path",), "grams": ("gram", "path")}


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifests = Manifests(spark, root)
        self._new_buckets = buckets

    def manifest(self, writing: bool = False) -> dict:
        """The newest whole manifest; without one, or of another format, an empty one.

        An error of the file system is raised, to readers and writers alike: a
        store that can't be read isn't empty.
        """
        number, found = self.manifests.latest(writing)
        if found is None or found.get("format") != FORMAT:
            return {"format": FORMAT, "version": number, "buckets": self._new_buckets, "tables": {}}
        return found | {"version": number}

    @property
    def version(self) -> int:
        return self.manifest()["version"]

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The current version of a table, of some of its buckets if these are named."""
        return self._read(self.manifest(), table, buckets)

    def _read(self, manifest: dict, table: str, buckets: list[int] | None = None) -> DataFrame:
        parts = manifest["tables"].get(table, {})
        paths = [f"{self.root}/{folder}/bucket={b}" for b, folder in sorted(parts.items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*paths)

    def _bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(manifest["buckets"])).cast("int")

    def _put(self, manifest: dict, table: str, rows: DataFrame) -> dict[str, str]:
        """Write rows into a new folder, bucket by bucket; the folder of each bucket that has rows."""
        folder = f"{table}/{manifest['version'] + 1}-{uuid.uuid4().hex[:8]}"
        out = rows.select(*SCHEMAS[table].names).withColumn("bucket", self._bucket(manifest)).hint("rebalance", "bucket")
        out = out.sortWithinPartitions("bucket", *_SORTED[table])
        out.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/{folder}")
        fs, at = self.manifests._fs, self.manifests._path(f"{self.root}/{folder}")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return {n.split("=")[1]: folder for n in names if n.startswith("bucket=")}

    def _publish(self, manifest: dict, tables: dict, keep: int) -> int:
        number = manifest["version"] + 1
        self.manifests.publish(number, {"format": FORMAT, "buckets": manifest["buckets"], "tables": tables})
        self.manifests.forget(keep, list(SCHEMAS), lambda m: {f for parts in m.get("tables", {}).values() for f in (parts.values() if isinstance(parts, dict) else [parts])})
        return number

    def write(self, tables: dict[str, DataFrame], keep: int = 2) -> int:
        """Publish whole new versions of the given tables together; others stay as they are.

        Texts bring their grams along.
        """
        now = self.manifest(writing=True)
        after = dict(now["tables"])
        for name, df in tables.items():
            after[name] = self._put(now, name, df)
            if name == "content":
                after["grams"] = self._put(now, "grams", S.gram_postings(self._read(now | {"tables": after}, "content"), "path", "text_lower", True))
        return self._publish(now, after, keep)

    def change(self, rows: dict[str, DataFrame], gone: DataFrame | None = None, textless: DataFrame | None = None, keep: int = 2) -> int:
        """Replace the rows of their paths in the given tables, and drop the paths ``gone`` from all.

        ``textless`` paths lose their text only.  Just the buckets with such paths
        are read and written.  Inputs should be cheap to compute again (written
        tables, small ones): they are asked for their buckets first.
        """
        now = self.manifest(writing=True)
        after = {t: dict(parts) for t, parts in now["tables"].items()}
        bucket, wrote = self._bucket(now), False
        for table in SCHEMAS:
            new = rows.get("content" if table == "grams" else table)
            drop = [df.select("path") for df in (gone, textless if table != "catalog" else None, new) if df is not None]
            buckets = sorted({b for df in drop for b in self._buckets(df, bucket)})
            if not buckets or new is None and not after.get(table):
                continue
            kept = self._read(now, table, buckets)
            for df in drop:
                kept = R.without(kept, df)
            if new is not None:
                fresh = S.gram_postings(new, "path", "text_lower", True) if table == "grams" else new
                kept = kept.unionByName(fresh.select(*SCHEMAS[table].names))
            parts = self._put(now, table, kept)
            had = after.setdefault(table, {})
            for b in buckets:
                had.pop(str(b), None)
            had |= parts
            wrote = True
        return self._publish(now, after, keep) if wrote else now["version"]

    @staticmethod
    def _buckets(rows: DataFrame, bucket: Column) -> list[int]:
        return [r[0] for r in rows.select(bucket.alias("b")).distinct().collect()]  # at most the number of buckets
