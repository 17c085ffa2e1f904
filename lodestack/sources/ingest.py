"""JSON feeds: bulk entries and external listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import paths as P
from lodestack.operators.refresh import external_rows
from lodestack.operators.search import stored_catalog, stored_content

ENTRY = "path string, name string, size bigint, mtime bigint, kind string, content string"
FEED = "root string, dirs array<string>, files array<string>"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON array file; a malformed file fails as a whole."""
    return spark.read.schema(ENTRY).option("multiLine", True).option("mode", "FAILFAST").json(path)


def entries_from_text(spark: SparkSession, text: str) -> DataFrame:
    one = spark.createDataFrame([(text,)], "j string")
    return one.select(F.explode(F.from_json("j", f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in ENTRY.split(', '))}>>", {"mode": "FAILFAST"})).alias("e")).select("e.*")


def catalog_rows(entries: DataFrame) -> DataFrame:
    """Catalog rows of entries: the last of a path wins, empty paths and names are skipped.

    Any kind but ``folder`` is a file; null size and time read as 0.
    """
    ok = entries.where("path <> '' and name <> ''").withColumn("n", F.monotonically_increasing_id())
    last = ok.groupBy("path").agg(F.max_by(F.struct("name", "size", "mtime", "kind"), "n").alias("r"))
    return stored_catalog(
        last.select(
            "path",
            "r.name",
            F.coalesce("r.size", F.lit(0)).alias("size"),
            F.coalesce("r.mtime", F.lit(0)).alias("mtime_ms"),
            F.when(F.col("r.kind") == "folder", "folder").otherwise("file").alias("kind"),
            F.lit("main").alias("origin"),
        )
    )


def content_rows(entries: DataFrame) -> DataFrame:
    """Stored texts of entries that bring some."""
    ok = entries.where("path <> '' and name <> ''").withColumn("n", F.monotonically_increasing_id()).where("content is not null")
    return stored_content(ok.groupBy("path").agg(F.max_by("content", "n").alias("text")))


def feed_from_text(spark: SparkSession, text: str) -> DataFrame:
    """``(path, kind, root)`` of an external feed given as JSON."""
    ddl = "root string, dirs array<string>, files array<string>"
    one = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", ddl, {"mode": "FAILFAST"}).alias("f")).select("f.*")
    none = F.array().cast("array<string>")
    part = lambda c, kind: one.select(F.explode(F.coalesce(c, none)).alias("path"), F.lit(kind).alias("kind"), F.coalesce("root", F.lit("")).alias("root"))
    return part("dirs", "folder").unionByName(part("files", "file"))


def external_catalog(feed: DataFrame) -> DataFrame:
    return stored_catalog(external_rows(feed, F.col("root")).dropDuplicates(["path"]).withColumn("origin", F.lit("external")))


def listing(spark: SparkSession, path: str, kind: str, root: str = "") -> DataFrame:
    """A text file with one path a line, as ``find`` prints it."""
    return spark.read.text(path).select(F.col("value").alias("path"), F.lit(kind).alias("kind"), F.lit(root).alias("root"))


def document_paths(ids: DataFrame, storage: str) -> DataFrame:
    """Tree document ids as paths; ids of other volumes are left out."""
    return ids.select(P.uri_to_path(F.col("uri"), storage).alias("path")).where("path is not null")
