"""Refreshes over every pair of consecutive valid deliveries and both lists."""

import datetime as dt

import pytest
from lodestack.plans import catalog as C

HEADS = "snap_id int, snap_version int, saved_at timestamp"
ROWS = "snap_id int, list_name string, row_no bigint, scan_root string, path string, size bigint, mtime_ms bigint"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("deliveries"))
    t = lambda n: dt.datetime(2024, 1, n)
    heads = [(1, 4, t(1)), (2, 4, t(2)), (4, 4, t(3)), (4, 4, t(3)), (3, 4, t(4)), (5, 3, t(5)), (6, 4, t(6))]
    held = {  # (list, path): size in 1, 2, 4, 3, 5, 6
        ("names", "/a.txt"): (5, 5, 6, 6, None, 6), ("names", "/b.txt"): (1, 1, 1, None, 1, 1), ("names", "/c.docx"): (None, 2, 2, 2, 2, 2),
        ("dirs", "/d"): (0, 0, None, None, 0, 0), ("dirs", "/a.txt"): (5, 5, 5, 5, 5, None),
    }
    rows = [(s, lst, k, "/", p, n, 7) for k, ((lst, p), sizes) in enumerate(held.items()) for s, n in zip((1, 2, 4, 3, 5, 6), sizes) if n is not None]
    names = [(1, "/x", "x", "x", 3, 4, "folder", "external"), (2, "/y", "y", "y", 3, 4, "file", "external"), (3, "/z", "z", "z", 3, 4, "file", "main")]
    texts = [(1, "/a.txt", "text", t(1)), (2, "/b.txt", "text", t(1))]
    for name, data, ddl in (
        ("snapshot_head", heads, HEADS), ("catalog_snapshot", rows, ROWS),
        ("name_record", names, "name_id bigint, path string, name string, name_lower string, size bigint, mtime_ms bigint, kind string, origin string"),
        ("content_store", texts, "row_id bigint, path string, text string, indexed_at timestamp"),
    ):
        spark.createDataFrame(data, ddl).write.parquet(f"{d}/{name}.parquet")
    return d


def test_every_pair_and_list(spark, tables):
    got = lambda name: {tuple(r) for r in C.QUERIES[name](spark, tables).collect()}
    diff = got("incremental_diff")
    assert {(s, n, p, k) for s, n, p, _, _, k in diff if k != "unchanged"} == {
        (2, "names", "/c.docx", "added"), (4, "names", "/a.txt", "updated"), (4, "dirs", "/d", "removed"), (3, "names", "/b.txt", "removed"),
        (6, "names", "/b.txt", "added"), (6, "dirs", "/d", "added"), (6, "dirs", "/a.txt", "removed"),
    }
    assert {r[0] for r in diff} == {2, 3, 4, 6}
    assert got("removed_paths") == {(4, "dirs", "/d"), (3, "names", "/b.txt"), (6, "dirs", "/a.txt")}
    assert got("stale_content") == {(4, "names", "/a.txt"), (3, "names", "/b.txt"), (6, "dirs", "/a.txt")}
    assert {r for r in got("scan_stats") if r[2] != "unchanged"} >= {(4, "dirs", "removed", 1, 0), (6, "names", "added", 1, 1)}
    assert {r[:3] for r in got("backfill_docs") if r[4] == "backfill"} == {(s, "names", "/c.docx") for s in (3, 4, 6)}
    assert {(r[0], r[2]) for r in got("upsert") if r[1] == "dirs"} == {(s, p) for s in (2, 4) for p in ("/d", "/a.txt")} | {(3, "/a.txt"), (6, "/a.txt"), (6, "/d")}
    full = got("full_refresh")
    assert {r[:3] for r in full if r[5] == "external"} == {(s, n, p) for s in (1, 2, 3, 4, 6) for n, p in (("dirs", "/x"), ("names", "/y"))}
    assert {(r[0], r[2]) for r in full if r[1] == "dirs" and r[5] == "main"} == {(s, "/a.txt") for s in (1, 2, 3, 4)} | {(1, "/d"), (2, "/d"), (6, "/d")}
