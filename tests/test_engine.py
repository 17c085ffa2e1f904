"""Scanning, searching and changing through the engine."""

import io
import json
import os
import threading
import zipfile

import pytest
from lodestack.engine import Engine, ScanOptions, progress_gate, roots_of
from lodestack.logs import Ring, ring
from lodestack.plans.query_language import QueryError, parse_query


def _docx(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:body>" + "".join(f"<w:p><w:t>{p}</w:t></w:p>" for p in paragraphs) + "</w:body>")
    return out.getvalue()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for d in ("a/b", ".hidden", "LOST.DIR", "Android/data/x", "Android/media"):
        (root / d).mkdir(parents=True)
    (root / "a" / "Quarterly Report.docx").write_bytes(_docx("The storage report", "of the year"))
    (root / "a" / "b" / "notes.txt").write_text("x")
    (root / ".secret").write_text("x")
    (root / ".hidden" / "in.txt").write_text("x")
    (root / "LOST.DIR" / "in.txt").write_text("x")
    (root / "Android" / "data" / "x" / "in.txt").write_text("x")
    os.symlink(root / "a", root / "link")
    return root


def test_scan_search_and_refresh(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "data"))
    s = e.scan(json.dumps([str(tree)]))
    assert (s.files, s.docs_found, s.docs_indexed, s.first_build) == (3, 1, 1, True)
    paths = {r.path.removeprefix(str(tree)) for r in e.catalog().collect()}
    assert paths == {"", "/a", "/a/b", "/Android", "/Android/media", "/a/Quarterly Report.docx", "/a/b/notes.txt", "/link"}
    hits, totals = e.search("storage report")
    assert [(r.matched, r.name) for r in hits.collect()] == [("content", "Quarterly Report.docx")]
    assert totals.first().total_content == 1
    hits, _ = e.search("type:doc report")
    assert [r.matched for r in hits.collect()] == ["name", "content"]
    assert json.loads(e.search_json("report"))["total"] == 2

    version = e.store.version
    s = e.scan(ScanOptions([str(tree)], "incremental"))
    assert (s.added, s.updated, s.removed) == (0, 0, 0) and e.store.version == version
    (tree / "a" / "c.txt").write_text("new")
    (tree / "a" / "b" / "notes.txt").unlink()
    (tree / "a" / "Quarterly Report.docx").write_bytes(_docx("Nothing else", "in it"))
    s = e.scan(json.dumps({"roots": [str(tree)], "mode": "incremental"}))
    assert (s.added, s.updated, s.removed, s.docs_indexed) == (1, 1, 1, 1)
    assert e.search("storage report")[0].count() == 0 and e.search("nothing else")[0].count() == 1
    assert e.stats().first().updated == 1


def test_changes(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "data"))
    entries = [
        {"path": "/a/x.pdf", "name": "Shown.pdf", "size": 3, "mtime": 5, "kind": "file", "content": "deep text\r\nhere"},
        {"path": "/a", "name": "a", "size": 0, "mtime": 0, "kind": "folder"},
        {"path": "", "name": "none", "size": 0, "mtime": 0, "kind": "file"},
        {"path": "/a/x.pdf", "name": "Last.pdf", "size": 4, "mtime": 6, "kind": "odd"},
    ]
    s = e.ingest(json.dumps(entries))
    assert s.files == 1 and s.docs_indexed == 1
    row = e.catalog().where("kind = 'file'").first()
    assert (row.name, row.size) == ("Last.pdf", 4)
    assert e.search("deep text")[0].first().snippet == "deep text here"
    feed = {"root": "/ext", "dirs": ["/ext/d"], "files": ["/ext/d/report.txt", "/ext/../etc/x", "/extra/y", "/ext/a\nb"]}
    assert e.replace_external(json.dumps(feed)) == 2
    assert e.search("report")[0].first().path == "/ext/d/report.txt"
    e.add_document_text("/a/x.pdf", "other words")
    assert e.search("deep")[0].count() == 0 and e.search("other words")[0].count() == 1
    assert e.remove_paths(["/a/x.pdf", "/nowhere"]) == 1
    assert e.remove_tree(["/ext"]) == 2
    e.ingest(json.dumps(entries[:2]), "merge")
    e.reset()
    assert e.catalog().count() == 0


def test_scan_in_the_background(spark, tree, tmp_path):
    heard = []
    e = Engine(spark, str(tmp_path / "data"), listener=lambda what, values: heard.append((what, values)))
    thread = e.start_scan(json.dumps([str(tree)]))
    with pytest.raises(RuntimeError):
        e.scan(json.dumps([str(tree)]))
    with pytest.raises(RuntimeError):
        e.replace_external('{"root": "", "dirs": [], "files": []}')
    e.remove_paths(["/nowhere"])  # waits for its turn, or finds nothing
    thread.join(120)
    assert not e.is_scanning and [w for w, _ in heard if w != "progress"] == ["started", "finished"]
    assert heard[-1][1]["files"] == 3 and any(w == "progress" and v.get("files") for w, v in heard)
    assert any("finished" in r for r in ring.records)
    row = e.size_stats().first()
    assert row.files > 0 and row.file_bytes > 0 and row.answers == 0
    e.search_json("report")
    assert e.size_stats().first().answers == 1
    with pytest.raises(QueryError):
        e.start_scan("[]")


def test_scan_that_fails(spark, tree, tmp_path, monkeypatch):
    heard = []
    e = Engine(spark, str(tmp_path / "data"), listener=lambda what, values: heard.append(what) or 1 / 0)
    monkeypatch.setattr(Engine, "_refresh", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    e.start_scan(json.dumps([str(tree)])).join(60)
    assert heard == ["started", "error"] and not e.is_scanning
    assert e.stats().first().cancelled and e.stats().first().host_cb_errors == 2
    # a scan that dies without a word is noticed
    e._scan_began = 1.0
    heard.clear()
    dead = threading.Thread(target=int)
    dead.start()
    dead.join()
    e._watch(dead, 1.0, every=0.01)
    assert heard == ["error"] and not e.is_scanning


def test_progress_gate():
    assert progress_gate(200, 1, 0, 0) and progress_gate(401, 5, 0, 0) and progress_gate(7, 1, 0, 1000)
    assert not progress_gate(199, 50, 0, 999) and not progress_gate(250, 50, 0, 0)


def test_scopes():
    disk, dirs = ["/storage/0"], ["/storage/0/a", "/sd/b", "/sd/b"]
    assert roots_of("full_disk_only", disk, dirs) == disk
    assert roots_of("dirs_only", disk, dirs) == ["/storage/0/a", "/sd/b"]
    assert roots_of("full_disk_and_dirs", disk, dirs) == ["/storage/0", "/sd/b"]
    assert ScanOptions.parse('{"roots": ["/storage/0"], "dirs": ["/sd/b"], "scope": "full_disk_and_dirs"}').roots == ["/storage/0", "/sd/b"]
    for bad in (("dirs_only", disk, []), ("other", disk, dirs)):
        with pytest.raises(QueryError):
            roots_of(*bad)


def test_log_ring(tmp_path):
    import logging

    own = Ring(most=3, level=logging.WARNING)
    log = logging.getLogger("lodestack.test")
    log.addHandler(own)
    for k in range(5):
        log.warning("w%d", k)
        log.info("i%d", k)
    log.removeHandler(own)
    assert own.export(str(tmp_path / "log.txt")) == 3
    assert [line.split()[-1] for line in (tmp_path / "log.txt").read_text().splitlines()] == ["w2", "w3", "w4"]


def test_errors(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "data"))
    for bad in ("", "   ", "type:doc", "dir:x"):
        with pytest.raises(QueryError):
            e.search(bad)
    with pytest.raises(QueryError):
        e.scan("[]")
    with pytest.raises(QueryError):
        e.scan("no json")
    with pytest.raises(QueryError):
        e.add_document_text("/x", " \n")
    with pytest.raises(Exception):
        e.ingest("[{]")
    assert e.catalog().count() == 0 and e.stats().first().finished_at is None
    e.close()
    with pytest.raises(RuntimeError):
        e.search("x")


@pytest.mark.parametrize(
    "raw, terms, types, dirs",
    [
        ("type:视频 音乐 type:movie 报告", ["音乐", "报告"], ["video"], []),
        ('dir:"My Documents" 报告', ["报告"], [], ["My Documents"]),
        ("dir:My Documents", ["Documents"], [], ["My"]),
        ('"abc', ["abc"], [], []),
        ("type:nothing x", ["x"], [], []),
        ('TYPE:"doc"y', ["y"], ["doc"], []),
        ("a　b\xa0c", ["a　b", "c"], [], []),
        ("  ", [], [], []),
    ],
)
def test_parse(raw, terms, types, dirs):
    f = parse_query(raw)
    assert (f.terms, f.types, f.dirs) == (terms, types, dirs)
