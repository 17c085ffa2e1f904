"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
_written: list = []
_path_of: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: Shuffle files go as soon as what was asked is done; else they stay until the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str | int = "*", app: str = "lodestack", memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Where the setting is missing and the master is local (tests), a temporary
    folder of this machine is made once per application and set as the checkpoint
    folder.  A cluster has to name one: its executors don't share this machine's.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="lodestack-")
        spark.sparkContext.setCheckpointDir(_own_folder[app])
    return _own_folder[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/lodestack-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(_forget)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``by``: a folder for each value of that column.

    Cuts the lineage, so nothing is computed twice and a lost executor costs
    no more than the tasks it was running.  Its shuffle files are removed.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        write = df.write.option("compression", "zstd")
        (write.partitionBy(by) if by else write).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove what ``materialize`` wrote and nobody reads any more."""
    for df in tables:
        if (path := _path_of.pop(df, None)) is not None:
            remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _forget() -> None:
    for spark, path in _written:
        try:
            remove_path(spark, path)
        except Exception:  # the JVM may be gone already
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
