"""Sets of sequence numbers as disjoint intervals, kept in DataFrames.

An interval set has the columns ``block, lo, hi`` (inclusive).  Intervals are
clipped at block borders, so every operation works block by block on at most
``2**BLOCK_BITS`` numbers, in parallel, however large the set is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 12


def block_of(number: Column) -> Column:
    return F.shiftright(number, BLOCK_BITS)


def from_numbers(numbers: DataFrame, column: str) -> DataFrame:
    """The interval set of a column; nulls are ignored, repeats count once."""
    n = F.col(column).cast("bigint")
    once = numbers.where(n.isNotNull()).select(block_of(n).alias("block"), n.alias("n")).distinct()
    island = F.col("n") - F.row_number().over(Window.partitionBy("block").orderBy("n"))
    return (
        once.withColumn("island", island)
        .groupBy("block", "island")
        .agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
        .select("block", "lo", "hi")
    )


def merge(*sets: DataFrame) -> DataFrame:
    """Union; touching and overlapping intervals of a block become one."""
    rows = sets[0].select("block", "lo", "hi")
    for s in sets[1:]:
        rows = rows.unionByName(s.select("block", "lo", "hi"))
    w = Window.partitionBy("block").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.withColumn("starts", F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0))
    return (
        starts.withColumn("island", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("block", "island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .select("block", "lo", "hi")
    )


def subtract(available: DataFrame, processed: DataFrame) -> DataFrame:
    """What ``available`` covers and ``processed`` doesn't.

    A sweep over the borders: each border starts a segment that ends before the
    next one; segments with available but no processed cover remain.
    """

    def borders(s: DataFrame, a: int, p: int) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("d"))))
        return s.select("block", ends.alias("e")).select("block", "e.at", (F.col("e.d") * a).alias("da"), (F.col("e.d") * p).alias("dp"))

    at = (
        borders(available, 1, 0)
        .unionByName(borders(processed, 0, 1))
        .groupBy("block", "at")
        .agg(F.sum("da").alias("da"), F.sum("dp").alias("dp"))
    )
    w = Window.partitionBy("block").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        at.select(
            "block",
            F.col("at").alias("lo"),
            (F.lead("at").over(w) - 1).alias("hi"),
            F.sum("da").over(upto).alias("a"),
            F.sum("dp").over(upto).alias("p"),
        )
        .where((F.col("a") > 0) & (F.col("p") == 0))
        .select("block", "lo", "hi")
    )


def widest(intervals: DataFrame, most: int) -> list:
    """The ``most`` widest ranges of a set, as rows (lo, hi); touching blocks count as one range.

    A range that crosses a border of 2**18 blocks is given in parts.
    """
    far = F.shiftright("block", 18)
    w = Window.partitionBy("far").orderBy("lo")
    rows = intervals.select(far.alias("far"), "lo", "hi")
    starts = rows.withColumn("starts", F.when(F.col("lo") == F.lag("hi").over(w) + 1, 0).otherwise(1))
    whole = starts.withColumn("island", F.sum("starts").over(w)).groupBy("far", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return whole.select("lo", "hi").orderBy((F.col("hi") - F.col("lo")).desc(), "lo").limit(most).collect()


def rows_outside(rows: DataFrame, column: str, order: str, intervals: DataFrame) -> DataFrame:
    """The rows whose number lies in none of the (disjoint) intervals; of a number, those of its first ``order``.

    Within a block numbers and intervals are sorted together and each number
    looks at the last interval that starts at or before it.  Numbers are reduced
    to distinct ones before they travel; rows meet only those that are to be left out.
    """
    n = F.col(column)
    numbers = rows.groupBy(block_of(n).alias("block"), n.alias("n")).agg(F.min(order).alias("first"), F.max(order).alias("last"))
    both = numbers.select("block", "n", F.lit(1).alias("k"), F.lit(None).cast("bigint").alias("hi"), "first", "last").unionByName(
        intervals.select("block", F.col("lo").alias("n"), F.lit(0).alias("k"), "hi", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    )
    w = Window.partitionBy("block").orderBy("n", "k").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("until", F.last("hi", ignorenulls=True).over(w)).where("k = 1").withColumn("done", F.coalesce(F.col("until") >= F.col("n"), F.lit(False)))
    # nothing to say about a number that is new and came in one run only
    noted = seen.where(F.col("done") | (F.col("first") < F.col("last"))).select(F.col("n").alias("_n"), "done", "first")
    return rows.join(noted, n == F.col("_n"), "left").where(F.col("_n").isNull() | ~F.col("done") & (F.col(order) == F.col("first"))).select(*rows.columns)


def rows_within(rows: DataFrame, column: str, intervals: DataFrame) -> DataFrame:
    """The rows whose number lies in one of the (disjoint) intervals.

    An as-of join: within a block each distinct number looks up the last
    interval that starts at or before it.  Rows themselves meet the few numbers
    that passed in an equi-join, so a number repeated often does no harm.
    """
    n = F.col(column).cast("bigint")
    wanted = intervals.select("block").distinct()
    numbers = rows.where(n.isNotNull()).select(block_of(n).alias("block"), n.alias("n")).distinct().join(wanted, "block", "left_semi")
    both = numbers.select("block", "n", F.lit(1).alias("k"), F.lit(None).cast("bigint").alias("hi")).unionByName(
        intervals.select("block", F.col("lo").alias("n"), F.lit(0).alias("k"), "hi")
    )
    w = Window.partitionBy("block").orderBy("n", "k").rowsBetween(Window.unboundedPreceding, 0)
    hits = both.withColumn("until", F.last("hi", ignorenulls=True).over(w)).where((F.col("k") == 1) & (F.col("until") >= F.col("n")))
    hits = hits.select(F.col("n").alias("_number_in"))
    return rows.join(hits, n == F.col("_number_in"), "left_semi")
