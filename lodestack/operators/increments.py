"""Processing only new or changed records, once each, across failing runs.

The ledger keeps which sequence numbers have been processed, as disjoint
intervals.  What is available minus what is processed are the gaps (late commits
fill old ones); only rows in gaps are taken up, and the scan is told the ranges
that are done, so it doesn't read them again.  Runs that are due are caught up
together: a row belongs to the first of them that ends after it arrived, so a
backlog costs one pass, not one a run.  The output, the records now in force and
the merged intervals are written below a folder of the attempt, and one manifest
makes all of it count.  An attempt that dies before has changed nothing; one
that is started again after its commit finds no gap.

The records in force are kept as a base and what has changed since; when the
changes outgrow the base they are folded into a new one, so over all runs a
record is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.manifests import Manifests
from lodestack.operators import intervals as iv
from lodestack.session import work_path

#: Runs caught up in one pass; a longer backlog takes several.
TOGETHER = 64
#: Processed ranges a scan is told to leave out, the widest ones.
SKIPPED = 64
#: Folders of changes that may lie on a base.
MOST_CHANGES = 16

INTERVALS = T.StructType([T.StructField(c, T.LongType()) for c in ("block", "lo", "hi")])
_RECORD = [
    T.StructField("path", T.StringType()),
    T.StructField("arrived_at", T.TimestampNTZType()),
    T.StructField("feed_id", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime_ms", T.LongType()),
]
FORCE = T.StructType(_RECORD)
CASES = T.StructType([T.StructField("run_no", T.IntegerType()), *(f for f in _RECORD if f.name in ("path", "size", "mtime_ms"))])


@dataclass
class Run:
    run_no: int
    until: str  # a timestamp as text, in the feed's own kind of time


class Ledger:
    """The committed state: manifests that name the folders of committed attempts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifests = Manifests(spark, root)

    def state(self, writing: bool = False) -> dict:
        number, found = self.manifests.latest(writing)
        return (found or {"runs": [], "cases": [], "base": None, "changes": [], "rows": [0, 0], "intervals": None}) | {"number": number}

    def commit(self, before: dict, after: dict) -> None:
        """Publish the next manifest; fails if another writer was faster."""
        self.manifests.publish(before["number"] + 1, {k: v for k, v in after.items() if k != "number"})

    def runs(self) -> list[int]:
        return self.state()["runs"]

    def _table(self, schema: T.StructType, *folders: str | None) -> DataFrame:
        at = [f"{self.root}/{f}" for f in folders if f]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def processed(self, state: dict) -> DataFrame:
        return self._table(INTERVALS, state["intervals"])

    def in_force(self, state: dict) -> DataFrame:
        """The base and the changes on it; of a path, the greatest (arrived_at, feed_id) counts."""
        return self._table(FORCE, state["base"], *state["changes"])

    def output(self) -> DataFrame:
        """``(run_no, path, size, mtime_ms)``: what the committed runs processed."""
        return self._table(CASES, *self.state()["cases"])


def _first_end(arrived: Column, ends: list[Column], low: int = 0, high: int | None = None) -> Column:
    """The index of the first of the (rising) ends at or after ``arrived``, by halving."""
    high = len(ends) - 1 if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(arrived <= ends[mid], _first_end(arrived, ends, low, mid)).otherwise(_first_end(arrived, ends, mid + 1, high))


def _unprocessed(number: Column, processed: DataFrame) -> Column:
    """A condition for scans: the number lies in none of the widest processed ranges."""
    keep = F.lit(True)
    for r in iv.widest(processed, SKIPPED):
        keep = keep & ((number < r.lo) | (number > r.hi))
    return keep


def process_runs(ledger: Ledger, feed: DataFrame, runs: list[Run], fail_before_commit: bool = False) -> None:
    """Runs in the order of their ends: for each, whatever arrived by then and hasn't been processed.

    ``feed``: feed_id (the sequence number), path, size, mtime_ms, arrived_at;
    other columns are ignored.  Rows without feed_id, path or arrived_at can't
    be tracked and are left out; null size and mtime read as 0.  A number that is
    delivered again counts with the run that saw it first.  Runs that were
    committed before are not repeated.
    """
    done = ledger.state(writing=True)
    runs = [r for r in runs if r.run_no not in done["runs"]]
    for k in range(0, len(runs), TOGETHER):
        _process(ledger, feed, runs[k : k + TOGETHER], fail_before_commit)


def process_run(ledger: Ledger, feed: DataFrame, run: Run, fail_before_commit: bool = False) -> None:
    process_runs(ledger, feed, [run], fail_before_commit)


def _process(ledger: Ledger, feed: DataFrame, runs: list[Run], fail_before_commit: bool) -> None:
    spark, before = ledger.spark, ledger.state(writing=True)
    processed = ledger.processed(before)
    kind = feed.schema["arrived_at"].dataType
    ends = [F.lit(r.until).cast(kind) for r in runs]
    rows = feed.where(F.col("path").isNotNull() & F.col("feed_id").isNotNull() & (F.col("arrived_at") <= ends[-1]) & _unprocessed(F.col("feed_id"), processed)).select(
        F.col("feed_id").cast("bigint").alias("feed_id"),
        "path",
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
        F.coalesce("mtime_ms", F.lit(0)).cast("bigint").alias("mtime_ms"),
        F.col("arrived_at").cast("timestamp_ntz").alias("arrived_at"),
        _first_end(F.col("arrived_at"), ends).alias("nth"),
    )
    folder = f"attempt-{uuid.uuid4().hex[:12]}"
    at = f"{ledger.root}/{folder}"

    # numbers meet the processed intervals block by block: what is left are the gaps
    fresh = iv.rows_outside(rows, "feed_id", "nth", processed)
    fresh.write.option("compression", "zstd").parquet(f"{at}/rows")
    fresh = spark.read.schema(fresh.schema).parquet(f"{at}/rows")
    iv.merge(processed, iv.from_numbers(fresh, "feed_id")).write.parquet(f"{at}/intervals")

    # the last record of a path in each run, then run by run what was in force before it
    record = F.struct("arrived_at", "feed_id", "size", "mtime_ms")
    last = fresh.groupBy("path", "nth").agg(F.max(record).alias("r"))
    known = ledger.in_force(before)
    if before["base"] or before["changes"]:
        known = known.join(fresh.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.max(record).alias("r"))
        last = last.unionByName(known.select("path", F.lit(-1).alias("nth"), "r"))
    upto = Window.partitionBy("path").orderBy("nth")
    force = last.withColumn("now", F.max("r").over(upto.rowsBetween(Window.unboundedPreceding, 0))).withColumn("old", F.max("r").over(upto.rowsBetween(Window.unboundedPreceding, -1)))
    force = force.where("nth >= 0").withColumn("final", F.lead("nth").over(upto).isNull())
    force = force.select("path", "nth", "now", "old", "final")
    force.write.option("compression", "zstd").parquet(f"{at}/force")
    force = spark.read.schema(force.schema).parquet(f"{at}/force")
    number = F.element_at(F.array(*(F.lit(r.run_no).cast("int") for r in runs)), F.col("nth") + 1)
    differs = F.col("old").isNull() | (F.col("now.size") != F.col("old.size")) | (F.col("now.mtime_ms") != F.col("old.mtime_ms"))
    force.where(differs).select(number.alias("run_no"), "path", "now.size", "now.mtime_ms").write.option("compression", "zstd").parquet(f"{at}/cases")
    changes = force.where(F.col("final") & (F.col("old").isNull() | (F.col("now") > F.col("old")))).select("path", "now.*")
    changes.write.option("compression", "zstd").parquet(f"{at}/changes")

    after = before | {
        "runs": before["runs"] + [r.run_no for r in runs],
        "cases": before["cases"] + [f"{folder}/cases"],
        "changes": before["changes"] + [f"{folder}/changes"],
        "intervals": f"{folder}/intervals",
    }
    base, grown = before["rows"]
    grown += spark.read.schema(FORCE).parquet(f"{at}/changes").count()  # from the files' footers
    after["rows"] = [base, grown]
    if after["base"] is None and len(after["changes"]) == 1:
        after |= {"base": after["changes"][0], "changes": [], "rows": [grown, 0]}
    elif grown >= base or len(after["changes"]) > MOST_CHANGES:
        whole = ledger.in_force(after).groupBy("path").agg(F.max(record).alias("r")).select("path", "r.*")
        whole.write.option("compression", "zstd").parquet(f"{at}/base")
        after |= {"base": f"{folder}/base", "changes": [], "rows": [spark.read.schema(FORCE).parquet(f"{at}/base").count(), 0]}
    if fail_before_commit:
        raise RuntimeError("stopped before the commit")
    ledger.commit(before, after)


def successful_runs(runs: DataFrame) -> list[Run]:
    """The runs with status ``ok`` and an end, in order; one row a run, so few."""
    ok = runs.where((F.col("run_status") == "ok") & F.col("finished_at").isNotNull() & F.col("run_no").isNotNull())
    ends = ok.groupBy("run_no").agg(F.max("finished_at").alias("until")).orderBy("until", "run_no")
    return [Run(r.run_no, r.until) for r in ends.select("run_no", F.col("until").cast("string").alias("until")).toLocalIterator()]


def new_or_changed(feed: DataFrame, runs: DataFrame, root: str | None = None) -> DataFrame:
    """Run every successful run over the feed; ``(run_no, path, size, mtime_ms)``.

    With a ``root`` the ledger there is continued, otherwise one is begun in the
    shared folder.  No successful run, or an empty feed: no rows.
    """
    spark = feed.sparkSession
    ledger = Ledger(spark, root or work_path(spark, "ledger"))
    process_runs(ledger, feed, successful_runs(runs))
    return ledger.output()
