"""Versioned tables: small changes, readers, writers and failures."""

import os

import pytest
from lodestack.manifests import Conflict, Manifests
from lodestack.operators import search as S
from lodestack.sources import walker
from lodestack.store import Store
from pyspark.sql import functions as F

CATALOG = "path string, name string, size bigint, mtime_ms bigint, kind string, origin string"


def catalog(spark, names):
    return S.stored_catalog(spark.createDataFrame([(f"/a/{n}", n, 1, 1, "file", "main") for n in names], CATALOG))


def texts(spark, rows):
    return S.stored_content(spark.createDataFrame(rows, "path string, text string"))


def test_change_touches_its_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    names = [f"n{k}.txt" for k in range(200)]
    store.write({"catalog": catalog(spark, names), "content": texts(spark, [(f"/a/{n}", f"Text {n}") for n in names])})
    before = store.manifest()["tables"]
    store.change({"content": texts(spark, [("/a/n7.txt", "Other words")])})
    after = store.manifest()["tables"]
    assert sum(before["content"][b] != after["content"][b] for b in before["content"]) == 1
    assert before["catalog"] == after["catalog"]
    assert {r.path for r in S.prefiltered(store.read("content"), store.read("grams"), ["other"]).collect()} == {"/a/n7.txt"}
    assert store.read("content").count() == 200
    store.change({}, spark.createDataFrame([("/a/n7.txt",), ("/none",)], "path string"))
    assert store.read("catalog").count() == store.read("content").count() == 199
    assert not S.prefiltered(store.read("content"), store.read("grams"), ["other"]).count()
    assert store.read("grams").where("path = '/a/n7.txt'").count() == 0
    store.change({"catalog": catalog(spark, ["n7.txt"])}, None, spark.createDataFrame([("/a/n8.txt",)], "path string"))
    assert store.read("catalog").count() == 200 and store.read("content").count() == 198
    assert store.change({}) == store.version


def test_index_and_text_agree(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    rows = [("/1", "aab aba"), ("/2", "ab"), ("/3", "b a"), ("/4", "文件夹 report"), ("/5", "件文夹"), ("/6", ""), ("/7", None)]
    store.write({"content": texts(spark, rows)})
    for terms in (["ab"], ["aa", "ba"], ["a"], ["文件"], ["夹", "rep"], ["zz"], []):
        want = {r.path for r in S.content_matches(store.read("content"), terms).collect()}
        assert {r.path for r in S.prefiltered(store.read("content"), store.read("grams"), terms).collect()} == want


def test_unreadable_is_not_empty(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.write({"content": texts(spark, [("/1", "kept")])})

    def broken(self, number):
        raise OSError("the store can't be reached")

    with monkeypatch.context() as m:
        m.setattr(Manifests, "read", broken)
        with pytest.raises(OSError):
            store.write({"catalog": catalog(spark, ["x"])})
        with pytest.raises(OSError):
            store.read("content")
    store.write({"catalog": catalog(spark, ["x"])})
    assert store.read("content").count() == 1


def test_two_writers(spark, tmp_path):
    m = Manifests(spark, str(tmp_path / "m"))
    m.publish(1, {"a": 1})
    with pytest.raises(Conflict):
        m.publish(1, {"a": 2})
    assert m.latest() == (1, {"a": 1})


def test_folders_of_others_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    (tmp_path / "s/catalog/9-unfinished").mkdir(parents=True)
    (tmp_path / "s/catalog/1-abandoned").mkdir(parents=True)
    os.utime(tmp_path / "s/catalog/1-abandoned", (0, 0))
    for n in range(4):
        store.write({"catalog": catalog(spark, [str(n)])})
    left = set(os.listdir(tmp_path / "s/catalog"))
    assert "9-unfinished" in left and "1-abandoned" not in left
    assert len(store.manifests.numbers()) == 2


def test_filters_reach_the_scan(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write({"catalog": catalog(spark, ["Report.doc", "x"])})
    plan = S.name_matches(store.read("catalog"), "Report")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(name_lower,report)" in plan


def test_content_terms():
    assert S.content_terms("rep\x01ort\x1cx") == ["reportx"]
    assert S.content_terms(" Ä\r\nb\x0bc　D� ") == ["ä", "b", "c", "d"]
    assert S.content_terms("\x01�") == []


def test_walk_is_spread(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"one/big/d{k % 10}/e{k}").mkdir(parents=True)
        (tmp_path / f"one/big/d{k % 10}/e{k}/f.txt").write_text("x")
    reader = walker.TreeReader({"roots": str(tmp_path), "spread": "8"})
    assert sum(len(p.trees) for p in reader.partitions()) >= 8
    rows = walker.scan(spark, [str(tmp_path)])
    assert rows.count() == 1 + 2 + 10 + 30 + 30 and rows.where(F.col("kind") == "file").count() == 30
    assert walker.scan(spark, [str(tmp_path)], max_entries=7).count() == 7
    assert walker.scan(spark, [str(tmp_path / "none")]).count() == 0
