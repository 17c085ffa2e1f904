"""What changed between consecutive full snapshots of a table.

Keys are bucketed into hash ranges, the leaves of a Merkle tree of three levels:
the root of a list, its ``top`` nodes (at most 2**TOP_BITS) and the leaves.  A
leaf's digest covers its rows regardless of their order, a node's digest covers
its children.  Consecutive snapshots are compared from the root down, each list
and pair by itself: tops only under a differing root, leaves only under differing
tops, rows only in differing leaves.

Rows and digests of a snapshot are kept (``SnapshotIndex``), bucketed by top: a
new delivery is read, reduced to its standing rows and digested once, the ones
before it are not read again but for what differs, and comparing leaves and rows
moves nothing between tasks, as all of a leaf lies in one bucket.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.manifests import Manifests
from lodestack.session import work_path

#: Bits of a top node: differing tops are sent to all tasks, at most 2**12 a list and pair.
TOP_BITS = 12
MOST_BITS = 40
#: Rows a leaf has on average at most: with 1 % of rows changed, 4 % of leaves differ.
LEAF_ROWS = 4
#: Rows a bucket has at most on average when the index is begun.
BUCKET_ROWS = 1_000_000
MOST_BUCKETS = 1 << TOP_BITS


def delivery_order(heads: DataFrame, version: int = 4) -> DataFrame:
    """``(ord, snap_id)`` of the valid snapshots, oldest first.

    Heads without id or time, or of another version, don't count; a repeated
    head counts once, at its latest time; equal times go by snap_id.  There is
    one row a delivery, so the ordering window stays tiny.
    """
    valid = (
        heads.where((F.col("snap_version") == version) & F.col("snap_id").isNotNull() & F.col("saved_at").isNotNull())
        .groupBy("snap_id")
        .agg(F.max("saved_at").alias("saved_at"))
    )
    return valid.select("snap_id", F.row_number().over(Window.orderBy("saved_at", "snap_id")).alias("ord"))


def standing_rows(rows: DataFrame, order: DataFrame) -> DataFrame:
    """One row per snapshot, list and path: the one with the greatest row_no.

    Null and empty names (path ends in ``/``) are left out, null size and mtime
    read as 0.  Rows that share even the row_no: the greatest (size, mtime_ms).
    The aggregate combines before the shuffle, so a path repeated millions of
    times sends one row a task.
    """
    return (
        rows.where(F.col("path").isNotNull() & ~F.col("path").endswith("/"))
        .select("snap_id", "list_name", "row_no", "path", "size", "mtime_ms")
        .join(order, "snap_id")
        .groupBy("ord", "list_name", "path")
        .agg(
            F.max(
                F.struct(
                    F.coalesce("row_no", F.lit(-(2**63))).alias("row_no"),
                    F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
                    F.coalesce("mtime_ms", F.lit(0)).cast("bigint").alias("mtime_ms"),
                )
            ).alias("w")
        )
        .select("ord", "list_name", "path", "w.size", "w.mtime_ms")
    )


def bits_for(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Bits of the leaf number that leave at most ``leaf_rows`` rows a leaf."""
    return min(MOST_BITS, math.ceil(math.log2(rows / leaf_rows))) if rows > leaf_rows else 0


def leaf_of(path: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(path), 64 - bits) if bits else F.lit(0).cast("bigint")


def top_of(path: Column, bits: int) -> Column:
    """The top node above a path's leaf: the first bits of the leaf's number."""
    return leaf_of(path, min(bits, TOP_BITS)).cast("int")


def leaf_digests(standing: DataFrame, bits: int) -> DataFrame:
    """``(top, list_name, ord, node, d, n)`` for every leaf that has rows; ``standing`` has its top."""
    return standing.groupBy("top", "list_name", "ord", leaf_of(F.col("path"), bits).alias("node")).agg(
        F.bit_xor(F.xxhash64("path", "size", "mtime_ms")).alias("d"), F.count("*").alias("n")
    )


def parent_digests(nodes: DataFrame, child: str, *parent: str) -> DataFrame:
    """Digests of the level above, over the children in order: ``(*parent, list_name, ord, d)``.

    The digests of children are mixed with their number before they are joined,
    so their order counts and none has to be held with the others.
    """
    return nodes.groupBy(*parent, "list_name", "ord").agg(F.bit_xor(F.xxhash64(child, "d")).alias("d"))


def _differing(nodes: DataFrame, pairs: DataFrame, *key: str) -> DataFrame:
    """``(*key, list_name, pair)`` of nodes whose digest differs between the two snapshots of a pair.

    ``pairs``: ord, pair, now - which snapshots take part in which pairs, a handful of rows.
    """
    sides = nodes.join(F.broadcast(pairs), "ord")
    side = lambda now: F.max(F.when(F.col("now") == now, F.col("d")))
    both = sides.groupBy(*key, "list_name", "pair").agg(side(True).alias("after"), side(False).alias("before"))
    return both.where(~F.col("after").eqNullSafe(F.col("before"))).select(*key, "list_name", "pair")


def _below(nodes: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes of the lists and snapshots of differing parents; ``found`` has a size bound."""
    asked = found.join(F.broadcast(pairs), "pair").select(*(F.col(c).alias(f"_{c}") for c in found.columns if c != "pair"), F.col("ord").alias("_ord")).distinct()
    on = F.col("_ord") == F.col("ord")
    for c in found.columns:
        if c != "pair":
            on = on & F.col(f"_{c}").eqNullSafe(F.col(c))
    return nodes.join(F.broadcast(asked), on, "left_semi")


def differing_leaves(leaves: DataFrame, pairs: DataFrame) -> DataFrame:
    """Compare the trees from the root down; ``(top, node, list_name, pair)`` of the leaves.

    ``pairs``: ord, pair, now, a handful of rows.  Only differing roots and tops
    are sent to all tasks: at most 2**TOP_BITS rows a list and pair.
    """
    tops = parent_digests(leaves, "node", "top")
    roots = _differing(parent_digests(tops, "top"), pairs)
    tops = _differing(_below(tops, roots, pairs), pairs, "top")
    return _differing(_below(leaves, tops, pairs), pairs, "top", "node")


def changed_rows(standing: DataFrame, found: DataFrame, bits: int, pairs: DataFrame) -> DataFrame:
    """``(pair, list_name, path, change_kind)`` within the differing leaves.

    ``standing``: top, ord, list_name, path, size, mtime_ms; ``found`` from
    ``differing_leaves``.  Both lie in the same buckets, so rows are picked and
    compared where they are.
    """
    # of a snapshot a leaf is asked for by the pair it ends, the pair it begins, or both
    asked = found.join(F.broadcast(pairs), "pair").groupBy("top", "node", "list_name", "ord").agg(F.max(F.when(F.col("now"), F.col("pair"))).alias("ends"), F.max(F.when(~F.col("now"), F.col("pair"))).alias("begins"))
    asked = asked.select(F.col("top").alias("t"), F.col("node").alias("m"), F.col("list_name").alias("l"), F.col("ord").alias("o"), "ends", "begins")
    rows = standing.withColumn("node", leaf_of(F.col("path"), bits))
    rows = rows.join(asked, (F.col("t") == F.col("top")) & (F.col("m") == F.col("node")) & (F.col("o") == F.col("ord")) & F.col("l").eqNullSafe(F.col("list_name")))
    sides = F.array(F.struct(F.col("ends").alias("pair"), F.lit(True).alias("now")), F.struct(F.col("begins").alias("pair"), F.lit(False).alias("now")))
    rows = rows.select("top", "list_name", "path", "size", "mtime_ms", F.explode(sides).alias("x")).where("x.pair is not null")
    both = rows.groupBy("top", F.col("x.pair").alias("pair"), "list_name", "path").agg(
        *(F.max(F.when(F.col("x.now") == (side == "after"), F.col(c))).alias(f"{c}_{side}") for side in ("after", "before") for c in ("size", "mtime_ms"))
    )
    kind = (
        F.when(F.col("size_before").isNull(), F.lit("added"))
        .when(F.col("size_after").isNull(), F.lit("removed"))
        .when((F.col("size_before") != F.col("size_after")) | (F.col("mtime_ms_before") != F.col("mtime_ms_after")), F.lit("changed"))
    )
    return both.select("pair", "list_name", "path", kind.alias("change_kind")).where(F.col("change_kind").isNotNull())


@contextmanager
def _buckets_meet(spark: SparkSession) -> Iterator[None]:
    """Joins on more than the bucket's key use the buckets as they lie."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class SnapshotIndex:
    """Rows and digests of the snapshots seen so far, and the changes found between them.

    ``update`` takes what is new: deliveries not seen before are read, reduced to
    their standing rows and digested; pairs of consecutive deliveries not compared
    before are compared.  A delivery that turns up late between two others makes
    two new pairs; the changes of the pair it parts are kept but no longer named.
    A delivery is known by its snap_id: one that is delivered again counts as it
    was first seen.  All of an update counts with its manifest, or nothing: rows
    carry the number of their attempt, and those of a dead one are never asked for.
    """

    _ROWS = "ord int, list_name string, path string, size bigint, mtime_ms bigint, top int, part int"
    _LEAVES = "top int, list_name string, ord int, node bigint, d bigint, n bigint, part int"

    def __init__(self, spark: SparkSession, root: str, leaf_rows: int = LEAF_ROWS):
        self.spark, self.root, self.leaf_rows = spark, root.rstrip("/"), leaf_rows
        self.manifests = Manifests(spark, root)
        self._names: dict[str, str] = {}

    def _table(self, what: str, ddl: str, buckets: int) -> str:
        """The bucketed table of this session over the files below ``what``."""
        if what not in self._names:
            name = f"lodestack_{what}_{uuid.uuid4().hex}"
            place = f"{self.root}/{what}".replace("'", "\\'")
            self.spark.sql(f"create table {name} ({ddl}) using parquet clustered by (top) into {buckets} buckets location '{place}'")
            self._names[what] = name
        return self._names[what]

    def _add(self, df: DataFrame, what: str, ddl: str, buckets: int) -> DataFrame:
        name = self._table(what, ddl, buckets)
        columns = [c.split()[0] for c in ddl.split(", ")]
        out = df.select(*columns).write.mode("append").option("compression", "zstd").format("parquet")
        out.bucketBy(buckets, "top").saveAsTable(name)
        self.spark.catalog.refreshTable(name)
        return self.spark.read.table(name)

    def forget_tables(self) -> None:
        """Drop this session's names; the files stay."""
        for name in self._names.values():
            self.spark.sql(f"drop table if exists {name}")
        self._names.clear()

    def update(self, rows: DataFrame, heads: DataFrame, version: int = 4, fail_before_commit: bool = False) -> None:
        number, state = self.manifests.latest(writing=True)
        state = state or {"bits": None, "buckets": None, "snaps": {}, "pairs": {}, "order": []}
        order = [r.snap_id for r in delivery_order(heads, version).orderBy("ord").collect()]  # one row a delivery
        snaps, pairs, part = dict(state["snaps"]), dict(state["pairs"]), uuid.uuid4().int >> 97  # an attempt's own, so what a dead one left is never asked for
        fresh = [s for s in order if str(s) not in snaps]
        wanted = [(a, b) for a, b in zip(order, order[1:]) if f"{a}>{b}" not in pairs]
        bits, buckets = state["bits"], state["buckets"]
        if not fresh and not wanted and order == state["order"]:
            return
        changes = f"changes-{uuid.uuid4().hex[:12]}"
        with _buckets_meet(self.spark):
            if fresh:
                named = self.spark.createDataFrame([(s, s) for s in fresh], "snap_id int, ord int")
                picked = rows.where(F.col("snap_id").isin(fresh)) if len(fresh) <= 64 else rows.join(F.broadcast(named.select("snap_id")), "snap_id", "left_semi")
                if bits is None:
                    given = picked.count()
                    bits = bits_for(given // len(fresh), self.leaf_rows)
                    buckets = min(MOST_BUCKETS, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-given // BUCKET_ROWS)))
                kept = standing_rows(picked, F.broadcast(named)).withColumn("top", top_of(F.col("path"), bits)).withColumn("part", F.lit(part))
                kept = self._add(kept.repartition(buckets, "top"), "rows", self._ROWS, buckets).where(F.col("part") == part)
                self._add(leaf_digests(kept, bits).withColumn("part", F.lit(part)), "leaves", self._LEAVES, buckets)
                snaps |= {str(s): part for s in fresh}
            if wanted:
                taking = self.spark.createDataFrame([(s, b, s == b) for a, b in wanted for s in (a, b)], "ord int, pair int, now boolean")
                asked = sorted({(snaps[str(s)], s) for pair in wanted for s in pair})
                at = self.spark.createDataFrame(asked, "part int, ord int")
                read = lambda what, ddl: self.spark.read.table(self._table(what, ddl, buckets)).join(F.broadcast(at), ["part", "ord"], "left_semi")
                found = differing_leaves(read("leaves", self._LEAVES), taking)
                changed_rows(read("rows", self._ROWS), found, bits, taking).write.option("compression", "zstd").parquet(f"{self.root}/{changes}")
                pairs |= {f"{a}>{b}": changes for a, b in wanted}
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        self.manifests.publish(number + 1, {"bits": bits, "buckets": buckets, "snaps": snaps, "pairs": pairs, "order": order})

    def changes(self) -> DataFrame:
        """``(snap_id, list_name, path, change_kind)`` between consecutive deliveries as they stand."""
        _, state = self.manifests.latest()
        ddl = "pair int, list_name string, path string, change_kind string"
        named: dict[str, list[int]] = {}
        for a, b in zip(state["order"], state["order"][1:]) if state else []:
            named.setdefault(state["pairs"][f"{a}>{b}"], []).append(b)
        out = self.spark.createDataFrame([], ddl)
        for folder, ids in named.items():
            out = out.unionByName(self.spark.read.schema(ddl).parquet(f"{self.root}/{folder}").where(F.col("pair").isin(ids)))
        return out.select(F.col("pair").alias("snap_id"), "list_name", "path", "change_kind")


def snapshot_changes(rows: DataFrame, heads: DataFrame, version: int = 4, leaf_rows: int = LEAF_ROWS, root: str | None = None) -> DataFrame:
    """``(snap_id, list_name, path, change_kind)`` between consecutive valid snapshots.

    ``rows``: snap_id, list_name, row_no, path, size, mtime_ms (others are
    ignored); ``heads``: snap_id, snap_version, saved_at.  A null list_name is a
    list of its own.  With fewer than two valid snapshots, or no rows, the
    result is empty.  With a ``root`` the index there is continued, otherwise one
    is begun in the shared folder.
    """
    index = SnapshotIndex(rows.sparkSession, root or work_path(rows.sparkSession, "snapshots"), leaf_rows)
    index.update(rows, heads, version)
    index.forget_tables()
    return index.changes()
