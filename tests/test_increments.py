"""Snapshots, intervals, runs that fail, change feeds."""

import datetime as dt
import os
import random

import pytest
from lodestack.manifests import Conflict
from lodestack.operators import intervals as iv
from lodestack.operators.increments import Ledger, Run, _unprocessed, new_or_changed, process_run
from lodestack.operators.snapshots import SnapshotIndex, _buckets_meet, bits_for, changed_rows, differing_leaves, leaf_of, snapshot_changes
from lodestack.store import Store
from lodestack.streaming import feed as fd
from pyspark.sql import functions as F

ROWS = "snap_id int, list_name string, row_no bigint, path string, size bigint, mtime_ms bigint, change_kind string"
HEADS = "snap_id int, snap_version int, saved_at timestamp"


def numbers(df):
    return sorted(n for r in df.collect() for n in range(r.lo, r.hi + 1))


def test_intervals(spark):
    rng = random.Random(1)
    a = sorted({rng.randrange(0, 20000) for _ in range(3000)})
    b = set(rng.sample(a, 1200))
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "n bigint")
    A, B = iv.from_numbers(df([*a, *a[:50], None]), "n"), iv.from_numbers(df(sorted(b)), "n")
    assert numbers(A) == a
    gaps = iv.subtract(A, B)
    assert numbers(gaps) == sorted(set(a) - b)
    m = iv.merge(B, gaps)
    assert numbers(m) == a and m.count() == A.count()
    assert numbers(iv.subtract(A, A)) == [] and numbers(iv.subtract(A, iv.from_numbers(df([]), "n"))) == a
    rows = df([*a, *a, -1, 99999, None])
    assert sorted(r.n for r in iv.rows_within(rows, "n", gaps).collect()) == sorted([*(set(a) - b)] * 2)


def brute_changes(rows, heads):
    order = sorted({h[0]: h for h in heads if h[0] and h[1] == 4 and h[2]}.values(), key=lambda h: (h[2], h[0]))
    out = set()
    state = []
    for h in order:
        best = {}
        for s, l, n, p, size, m, _ in rows:
            if s == h[0] and p is not None and not p.endswith("/"):
                key = (-1 if n is None else n, size or 0, m or 0)
                best[l, p] = max(best.get((l, p), (-2, 0, 0)), key)
        state.append({k: v[1:] for k, v in best.items()})
    for k in range(1, len(order)):
        old, new = state[k - 1], state[k]
        for key in old.keys() | new.keys():
            if old.get(key) != new.get(key):
                out.add((order[k][0], *key, "added" if key not in old else "removed" if key not in new else "changed"))
    return out


def test_snapshots(spark):
    rng = random.Random(5)
    t = lambda d: dt.datetime(2024, 1, d)
    heads = [(1, 4, t(1)), (2, 4, t(9)), (3, 4, t(5)), (3, 4, t(5)), (4, 3, t(6)), (5, 4, None), (None, 4, t(7)), (6, 4, t(11))]
    rows = []
    for s in (1, 2, 3, 4, 5, 6):
        for n in range(400):
            p = f"/d{rng.randrange(9)}/f{rng.randrange(150)}" + rng.choice(["", "", "", "/"])
            rows.append((s, rng.choice(["names", "dirs", None]), n, rng.choice([p, p, p, None, "/hot"]), rng.choice([1, 2, None, 0]), rng.choice([5, None, 0]), "clash"))
    got = snapshot_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(heads, HEADS), leaf_rows=4)
    assert set(map(tuple, got.collect())) == brute_changes(rows, heads)
    assert got.columns == ["snap_id", "list_name", "path", "change_kind"]
    empty = snapshot_changes(spark.createDataFrame([], ROWS), spark.createDataFrame(heads, HEADS))
    assert empty.count() == 0
    assert snapshot_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(heads[:1], HEADS)).count() == 0
    assert bits_for(0) == bits_for(4) == 0 and bits_for(1 << 12) == 10 and bits_for(10**15) == 40


def test_kept_snapshots(spark, tmp_path):
    """Deliveries that come one by one, one late and one again, give what they give together."""
    rng = random.Random(6)
    t = lambda d: dt.datetime(2024, 1, d)
    heads = [(1, 4, t(1)), (2, 4, t(9)), (3, 4, t(5)), (4, 4, t(12))]
    rows = [(s, "names", n, f"/f{rng.randrange(300)}", rng.choice([1, 2]), 5, "x") for s in (1, 2, 3, 4) for n in range(300)]
    index = SnapshotIndex(spark, f"file://{tmp_path}/index")
    for k in (1, 2, 3, 3, 4):
        given = [r for r in rows if r[0] <= k]
        if k == 2:  # an attempt that dies after writing its rows
            with pytest.raises(RuntimeError):
                index.update(spark.createDataFrame(given, ROWS), spark.createDataFrame(heads[:k], HEADS), fail_before_commit=True)
            index = SnapshotIndex(spark, f"file://{tmp_path}/index")  # another session
        index.update(spark.createDataFrame(given, ROWS), spark.createDataFrame(heads[:k], HEADS))
        assert set(map(tuple, index.changes().collect())) == brute_changes(given, heads[:k])
    assert len(index.manifests.numbers()) == 4


def test_few_changes_move_few_rows(spark, tmp_path):
    """With 1 % of the rows changed, under 10 % of the standing rows are compared, and none of them is shuffled."""
    n = 20000
    old = spark.range(n).select(F.lit(1).alias("snap_id"), F.lit("names").alias("list_name"), F.col("id").alias("row_no"), F.concat(F.lit("/p/"), F.col("id")).alias("path"), F.lit(1).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("mtime_ms"))
    new = old.withColumn("snap_id", F.lit(2)).withColumn("size", F.when(F.col("row_no") % 100 == 7, 2).otherwise(1).cast("bigint"))
    heads = spark.createDataFrame([(1, 4, dt.datetime(2024, 1, 1)), (2, 4, dt.datetime(2024, 1, 2))], HEADS)
    index = SnapshotIndex(spark, f"file://{tmp_path}/index")
    index.update(old.unionByName(new), heads)
    assert index.changes().count() == n // 100
    pairs = spark.createDataFrame([(1, 2, False), (2, 2, True)], "ord int, pair int, now boolean")
    state = index.manifests.latest()[1]
    leaves, standing = (spark.read.table(index._names[t]) for t in ("leaves", "rows"))
    with _buckets_meet(spark):
        found = differing_leaves(leaves, pairs)
        moved = standing.join(found.select("node").distinct(), leaf_of(F.col("path"), state["bits"]) == F.col("node"), "left_semi").count()
        assert 2 * n == standing.count() and moved < 0.1 * standing.count()
        changed = changed_rows(standing, found, state["bits"], pairs)
        assert changed.count() == n // 100
        plan = changed._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and ("path" in line or "node" in line)]
    assert not shuffled, plan


FEED = "feed_id bigint, run_no int, path string, size bigint, mtime_ms bigint, arrived_at timestamp, is_case int"
RUNS = "run_no int, finished_at timestamp, run_status string"


def test_runs(spark, tmp_path):
    rng = random.Random(8)
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = []
    for i in range(1500):
        late = rng.random() < 0.1
        rows.append((i if i % 97 else None, 0, rng.choice([f"/p{rng.randrange(60)}", "/hot", None]) if i % 50 == 0 else f"/p{rng.randrange(60)}", rng.choice([1, 2, None]), rng.choice([7, None]), hour(i / 100 + (rng.random() * 5 if late else 0)), 0))
    rows += rows[100:130]
    feed = spark.createDataFrame(rows, FEED)
    runs = [(1, hour(3), "ok"), (2, hour(5), "failed"), (3, None, "ok"), (4, hour(9), "ok"), (5, hour(9), "cancelled"), (6, hour(30), "ok"), (6, hour(30), "ok"), (None, hour(4), "ok")]
    want, before = set(), {}
    for no, end in ((1, hour(3)), (4, hour(9)), (6, hour(30))):
        force = {}
        for f, _, p, s, m, at, _ in sorted((r for r in rows if r[0] is not None and r[2] is not None and r[5] <= end), key=lambda r: (r[5], r[0])):
            force[p] = (s or 0, m or 0)
        want |= {(no, p) for p, v in force.items() if before.get(p) != v}
        before = force
    out = new_or_changed(feed, spark.createDataFrame(runs, RUNS))
    assert sorted((r.run_no, r.path) for r in out.collect()) == sorted(want)

    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    process_run(ledger, feed, Run(1, str(hour(3))))
    with pytest.raises(RuntimeError):
        process_run(ledger, feed, Run(4, str(hour(9))), fail_before_commit=True)
    assert ledger.runs() == [1]
    process_run(ledger, feed, Run(4, str(hour(9))))
    process_run(ledger, feed, Run(4, str(hour(9))))  # started again after its commit
    process_run(ledger, feed, Run(6, str(hour(30))))
    assert sorted((r.run_no, r.path) for r in ledger.output().collect()) == sorted(want)
    with pytest.raises(RuntimeError):
        ledger.commit({"number": 0}, {"runs": [9]})
    assert len(ledger.state()["runs"]) == 3
    assert new_or_changed(feed.limit(0), spark.createDataFrame(runs, RUNS)).count() == 0
    assert new_or_changed(feed, spark.createDataFrame([], RUNS)).count() == 0


def test_processed_ranges_are_not_read_again(spark, tmp_path):
    """What earlier runs took is left out by the scan itself; the state is folded when its changes outgrow it."""
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    at = f"file://{tmp_path}/feed"
    rows = [(i, 0, f"/p{i % 500}", i, 7, hour(i / 1000), 0) for i in range(20000)]
    spark.createDataFrame(rows, FEED).repartitionByRange(20, "feed_id").write.parquet(at)
    feed, ledger = spark.read.parquet(at), Ledger(spark, f"file://{tmp_path}/ledger")
    for no in range(1, 6):
        process_run(ledger, feed, Run(no, str(hour(no * 4))))
        assert [(r.lo, r.hi) for r in iv.widest(ledger.processed(ledger.state()), 4)] == [(0, min(no * 4000, 19999))]
    state = ledger.state()
    assert state["runs"] == [1, 2, 3, 4, 5] and ledger.in_force(state).groupBy("path").count().count() == 500
    assert sum(state["rows"]) <= 1500 and len(state["changes"]) <= 2
    left = feed.where(_unprocessed(F.col("feed_id"), ledger.processed(state)))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(feed_id,19999)" in plan
    assert left.count() == 0
    assert ledger.output().count() == 5 * 500


def test_change_feed(spark, tmp_path):
    folder, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    first = [(1, "/a/x", 1, 1, "file", False), (2, "/a/y", None, None, None, None), (3, "/a/x", 2, 2, "file", False), (4, "/a/", 0, 0, "file", False)]
    spark.createDataFrame(first, fd.CHANGE).write.parquet(folder)
    fd.follow(fd.change_feed(spark, folder), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.path, r.size) for r in store.read("catalog").collect()) == [("/a/x", 2), ("/a/y", 0)]
    spark.createDataFrame([(5, "/a/y", 0, 0, "file", True), (6, "/a/z", 9, 9, "file", False)], fd.CHANGE).write.mode("append").parquet(folder)
    fd.follow(fd.change_feed(spark, folder), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.path for r in store.read("catalog").collect()) == ["/a/x", "/a/z"]
    (tmp_path / "store/manifests/2.json").write_text('{"format": 5, "tab')
    assert sorted(r.path for r in store.read("catalog").collect()) == ["/a/x", "/a/y"]  # the version before
    with pytest.raises(Conflict):
        store.write({})  # someone may be writing it
    os.utime(tmp_path / "store/manifests/2.json", (0, 0))
    os.utime(tmp_path / "store/manifests/.2.json.crc", (0, 0)) if os.path.exists(tmp_path / "store/manifests/.2.json.crc") else None
    assert store.change({"catalog": store.read("catalog").limit(1)}) == 3


def test_windows(spark):
    ts = lambda m: dt.datetime(2024, 1, 1, 0, m)
    e = spark.createDataFrame([(1, ts(1), "a"), (1, ts(20), "a"), (1, ts(55), "b"), (2, ts(3), "a")], "user_id int, ts timestamp, event_type string")
    assert sorted((r.event_type, r.n) for r in fd.windowed_counts(e).collect()) == [("a", 3), ("b", 1)]
    assert sorted((r.user_id, r.n) for r in fd.session_counts(e).collect()) == [(1, 1), (1, 2), (2, 1)]
    typed = e.select("user_id", F.lit(ts(1)).alias("ts"), F.lit("q").alias("query"))
    assert fd.settled_queries(typed).count() == 2
