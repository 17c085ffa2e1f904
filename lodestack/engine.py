"""The engine: scanning, searching and keeping the tables of one data folder."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import API_VERSION, __version__
from lodestack.functions import paths as P
from lodestack.logs import logger
from lodestack.operators import refresh as R
from lodestack.operators import search as S
from lodestack.plans.query_language import QueryError, checked, limit_of
from lodestack.session import materialize
from lodestack.sources import ingest as I
from lodestack.sources import walker
from lodestack.sources.extract import columns as extraction
from lodestack.store import BUCKETS, Store

# fixed values
CACHE_SECONDS, CACHE_ENTRIES, CACHE_BYTES = 3.0, 8, 524_288
PROGRESS_FILES, PROGRESS_MS = 200, 1000
WATCH_SECONDS, WATCH_IDLE, WATCH_MOST = 4.0, 2, 1800.0
SCOPES = ["full_disk_and_dirs", "dirs_only", "full_disk_only"]


def progress_gate(total: int, batch: int, last_ms: int, now_ms: int) -> bool:
    """Whether a batch is worth telling: it crossed a multiple of 200 files, or a second has passed."""
    return total % PROGRESS_FILES < batch or now_ms - last_ms >= PROGRESS_MS


def roots_of(scope: str, disk: list[str], dirs: list[str]) -> list[str]:
    """The roots a scope stands for; folders a disk holds anyway are not walked twice."""
    if scope not in SCOPES:
        raise QueryError(f"no such scope: {scope}")
    if scope == "full_disk_only":
        return list(disk)
    if scope == "dirs_only":
        if not dirs:
            raise QueryError("no folder has been chosen")
        return list(dict.fromkeys(dirs))
    inside = lambda d: any(d == r or d.startswith(r.rstrip("/") + "/") for r in disk)
    return [*disk, *(d for d in dict.fromkeys(dirs) if not inside(d))]


@dataclass
class ScanOptions:
    roots: list[str]
    mode: str = "full"
    #: ``all``: what no root showed is removed; ``roots``: only below the roots.
    prune_scope: str = "all"

    @classmethod
    def parse(cls, text: str) -> "ScanOptions":
        """A JSON list of roots (a full scan), or an object with roots and mode."""
        try:
            given = json.loads(text)
        except ValueError as e:
            raise QueryError("scan options are no JSON") from e
        if isinstance(given, list):
            return cls([str(r) for r in given])
        mode = given.get("mode", "")
        roots = [str(r) for r in given.get("roots", [])]
        if "scope" in given:
            roots = roots_of(given["scope"], roots, [str(d) for d in given.get("dirs", [])])
        return cls(roots, "full" if mode == "full" else "incremental", given.get("prune_scope", "all"))


@dataclass
class Stats:
    files: int = 0
    indexed: int = 0
    added: int = 0
    updated: int = 0
    removed: int = 0
    docs_found: int = 0
    docs_indexed: int = 0
    external: int = 0
    host_cb_errors: int = 0
    duration_ms: int = 0
    cancelled: bool = False
    first_build: bool = False
    finished_at: str | None = None


@dataclass
class _Cached:
    at: float
    version: int
    text: str


@dataclass
class Engine:
    spark: SparkSession
    data_dir: str
    listener: Callable[[str, dict], None] | None = None
    #: Buckets of a new store: a change rewrites those it touches.
    buckets: int = BUCKETS
    _stats: Stats = field(default_factory=Stats)
    _cache: dict = field(default_factory=dict)
    _closed: bool = False

    def __post_init__(self) -> None:
        #: Held by whoever writes: a scan, a removal or a feed waits for the other.
        self._gate = threading.RLock()
        self._scan_began: float | None = None
        self._scan_thread: threading.Thread | None = None
        self._told_ms = 0
        self._group = f"lodestack-scan-{uuid.uuid4().hex[:8]}"
        self.store = Store(self.spark, self.data_dir, self.buckets)
        self.parsers = dict(extraction.PARSERS)

    version = __version__
    abi_version = API_VERSION

    # --- tables -----------------------------------------------------------

    def catalog(self) -> DataFrame:
        self._open()
        return self.store.read("catalog")

    def content(self) -> DataFrame:
        self._open()
        return self.store.read("content")

    def _open(self) -> None:
        if self._closed:
            raise RuntimeError("the engine is closed")

    def close(self) -> None:
        self._cache.clear()
        self._closed = True

    def _tell(self, what: str, **values) -> None:
        logger.log(40 if what == "error" else 20, "%s %s", what, values)
        if self.listener:
            try:
                self.listener(what, values)
            except Exception:
                self._stats.host_cb_errors += 1
                logger.exception("the listener failed")

    # --- scanning -----------------------------------------------------------

    @property
    def is_scanning(self) -> bool:
        return self._scan_began is not None

    def cancel(self) -> None:
        """Ends the jobs of a scan that another thread runs."""
        self.spark.sparkContext.cancelJobGroup(self._group)

    def start_scan(self, options: ScanOptions | str) -> threading.Thread:
        """``scan`` in a thread of its own; the listener hears ``started``, ``progress`` and ``finished`` or ``error``.

        A watchdog looks after it: a scan that has gone without having said so is
        reported as an error, one that takes more than half an hour is cancelled.
        Options that can't be run are refused at once.
        """
        options = self._begin(options)

        def run() -> None:
            try:
                self._scan(options)
            except Exception:
                pass  # told to the listener

        self._scan_thread = InheritableThread(target=run, name=self._group, daemon=True)
        self._scan_thread.start()
        threading.Thread(target=self._watch, args=(self._scan_thread, self._scan_began), daemon=True).start()
        return self._scan_thread

    def _watch(self, thread: threading.Thread, began: float, every: float = WATCH_SECONDS, most: float = WATCH_MOST) -> None:
        idle = 0
        while self._scan_began == began:
            thread.join(every)
            if not thread.is_alive() and self._scan_began == began:
                idle += 1
                if idle >= WATCH_IDLE:
                    self._scan_began = None
                    self._tell("error", message="the scan ended without saying so")
            elif time.time() - began > most:
                self.cancel()
                most = float("inf")
            elif self._scan_began == began:
                self._progress_of_tasks()

    def _progress_of_tasks(self) -> None:
        """A sign of life: tasks done and to do of the stages that run."""
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForGroup(self._group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else []:
                s = tracker.getStageInfo(stage)
                if s:
                    done, total = done + s.numCompletedTasks, total + s.numTasks
        if total:
            self._tell("progress", tasks_done=done, tasks=total)

    def _count(self, total: int, batch: int, **values) -> None:
        now = int(time.time() * 1000)
        if progress_gate(total, batch, self._told_ms, now):
            self._told_ms = now
            self._tell("progress", **values)

    def register_parser(self, ext: str, parser: Callable[[bytes], str | None]) -> None:
        """A parser of this engine; others keep theirs."""
        self.parsers[ext if ext.startswith(".") else f".{ext}"] = parser

    def scan(self, options: ScanOptions | str) -> Stats:
        """Walk the roots and bring the tables up to date.

        ``full`` rebuilds names and texts; ``incremental`` parses what was added or
        changed and what lacks its text, and drops what is gone.  External rows
        stay.  Without any change nothing is written.
        """
        return self._scan(self._begin(options))

    def _begin(self, options: ScanOptions | str) -> ScanOptions:
        self._open()
        options = ScanOptions.parse(options) if isinstance(options, str) else options
        if not options.roots:
            raise QueryError("there are no roots to scan")
        with self._gate:
            if self.is_scanning:
                raise RuntimeError("a scan is running")
            self._scan_began = time.time()
        return options

    def _scan(self, options: ScanOptions) -> Stats:
        began, stats, failed = self._scan_began, Stats(), None
        self.spark.sparkContext.setJobGroup(self._group, "scan", interruptOnCancel=True)
        try:
            with self._gate:
                self._tell("started", roots=options.roots, mode=options.mode)
                stats.first_build = self.store.version == 0
                self._refresh(options, stats)
        except Exception as e:
            stats.cancelled, failed = True, e
            raise
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            stats.duration_ms = int((time.time() - began) * 1000)
            stats.finished_at = datetime.now(timezone.utc).isoformat(timespec="seconds")
            stats.host_cb_errors += self._stats.host_cb_errors
            self._stats = stats
            self._cache.clear()
            self._scan_began = None
            if failed is not None:
                self._tell("error", message=str(failed)[:500])
        self._tell("finished", **vars(stats))
        return stats

    def _refresh(self, options: ScanOptions, stats: Stats) -> None:
        full = options.mode == "full"
        seen = materialize(walker.scan(self.spark, options.roots).where(P.base_name(F.col("path")) != ""), "seen")
        old_all = self.catalog()
        old = old_all.where("origin = 'main'")
        content = self.content()
        if options.prune_scope == "roots" and not full:
            outside = old.where(~R.in_tree(F.col("path"), options.roots))
        else:
            outside = old.limit(0)
        within = R.removed(old, outside)
        base = within.limit(0) if full else within
        diff = materialize(R.differences(seen.where("kind = 'file'"), base.where("kind = 'file'")), "diff")
        counts = {r.status: r.n for r in diff.groupBy("status").agg(F.count("*").alias("n")).collect()}
        if not full:
            stats.added, stats.updated = counts.get("added", 0), counts.get("updated", 0)
        stats.removed = counts.get("removed", 0)
        queue = materialize(R.parse_queue(diff, content.limit(0) if full else content), "queue")
        stats.docs_found = queue.count()
        found = seen.count()
        self._count(found, found, files=found, docs=stats.docs_found)
        texts = materialize(S.stored_content(extraction.texts_at(queue, self.parsers)), "texts")
        stats.docs_indexed = texts.count()
        self._count(stats.docs_indexed, stats.docs_indexed, files=found, docs=stats.docs_found, docs_indexed=stats.docs_indexed)
        folders_changed = full or bool(seen.where("kind = 'folder'").select("path").exceptAll(base.where("kind = 'folder'").select("path")).limit(1).count())
        if not full and not stats.first_build and not (stats.added or stats.updated or stats.removed or stats.docs_indexed or folders_changed):
            stats.files = seen.where("kind = 'file'").count()
            stats.indexed, stats.external = content.count(), old_all.where("origin = 'external'").count()
            return
        named = S.stored_catalog(seen.select("path", P.base_name(F.col("path")).alias("name"), "size", "mtime_ms", "kind", F.lit("main").alias("origin")))
        if full:
            self.store.write({"catalog": named.unionByName(old_all.where("origin = 'external'")), "content": texts})
        else:
            # what is as it was stays where it is: only the buckets of what changed are written
            same = within.select("path", "size", "mtime_ms", "kind")
            moved = materialize(named.join(same, ["path", "size", "mtime_ms", "kind"], "left_anti"), "moved")
            gone = materialize(within.join(seen.select("path"), "path", "left_anti").select("path"), "gone")
            self.store.change({"catalog": moved, "content": texts}, gone, materialize(R.stale_content(diff, content), "stale"))
        now = self.catalog()
        stats.files = now.where("origin = 'main' and kind = 'file'").count()
        stats.external = now.where("origin = 'external'").count()
        stats.indexed = self.content().count()

    def stats(self) -> DataFrame:
        """One row; ``finished_at`` is null until a scan has finished, the duration of a running one is that so far."""
        if self._scan_began is not None:
            self._stats.duration_ms = int((time.time() - self._scan_began) * 1000)
        types = {"int": "bigint", "bool": "boolean"}
        ddl = ", ".join(f"{n} {types.get(f.type, 'string')}" for n, f in Stats.__dataclass_fields__.items())
        return self.spark.createDataFrame([tuple(vars(self._stats).values())], ddl)

    # --- searching ------------------------------------------------------------

    def search(self, query: str, limit: int = 0, filter_external: bool = False) -> tuple[DataFrame, DataFrame]:
        """``(hits, totals)`` of a query; raises ``QueryError`` for one that can't be run."""
        self._open()
        f = checked(query)
        catalog = self.catalog()
        b = S.branches(catalog, self.content(), f, filter_external, self.store.read("grams"))
        hits = S.merged(b, catalog, limit_of(limit), S.content_terms(f.joined))
        return hits.orderBy("pos").select("pos", *S.HIT), S.totals(b, limit_of(limit))

    def search_json(self, query: str, limit: int = 0) -> str:
        """The answer as JSON; the same question within three seconds is answered from memory."""
        key = (query, limit)
        version, now = self.store.version, time.monotonic()
        known = self._cache.get(key)
        if known and known.version == version and now - known.at < CACHE_SECONDS:
            return known.text
        hits, totals = self.search(query, limit)
        rows = [r.asDict() for r in hits.collect()]  # at most a thousand
        answer = {"query": query, "elapsed_ms": int((time.monotonic() - now) * 1000), **totals.first().asDict(), "total": len(rows)}
        answer["hits"] = [{("mtime" if k == "mtime_ms" else k): v for k, v in r.items() if k != "pos"} for r in rows]
        text = json.dumps(answer, ensure_ascii=False)
        if len(text.encode()) <= CACHE_BYTES:
            self._cache.pop(key, None)
            self._cache[key] = _Cached(now, version, text)
            while len(self._cache) > CACHE_ENTRIES:
                self._cache.pop(next(iter(self._cache)))
        return text

    # --- changes ------------------------------------------------------------------

    def remove_paths(self, paths: list[str] | DataFrame) -> int:
        """Remove exactly these paths from all tables; how many of them some table had."""
        asked = paths if isinstance(paths, DataFrame) else self.spark.createDataFrame([(p,) for p in paths], "path string")
        catalog, content = self.catalog(), self.content()
        n = R.removal_count(asked, catalog, content).first()[0]
        if n:
            with self._gate:
                self.store.change({}, asked.where("path is not null").select("path").distinct())
            self._cache.clear()
        return n

    def remove_tree(self, roots: list[str]) -> int:
        """Remove paths and all that lies below them."""
        found = self.catalog().select("path").unionByName(self.content().select("path")).where(R.in_tree(F.col("path"), roots)).distinct()
        return self.remove_paths(materialize(found, "tree"))

    def add_document_text(self, path: str, text: str) -> None:
        if not path or not text.strip():
            raise QueryError("a path and a text are needed")
        with self._gate:
            self.store.change({"content": S.stored_content(self.spark.createDataFrame([(path, text)], "path string, text string"))})
        self._cache.clear()

    def ingest(self, entries: str | DataFrame, mode: str = "replace") -> Stats:
        """Bulk entries in place of the scanned tables (``replace``) or added to them (``merge``)."""
        began = time.time()
        rows = I.entries_from_text(self.spark, entries) if isinstance(entries, str) else entries
        rows = materialize(rows, "entries")
        catalog, texts = I.catalog_rows(rows), I.content_rows(rows)
        old = self.catalog()
        with self._gate:
            if mode == "merge":
                self.store.change({"catalog": materialize(catalog, "catalog"), "content": materialize(texts, "texts")})
            else:
                self.store.write({"catalog": catalog.unionByName(old.where("origin = 'external'")), "content": texts})
        now = self.catalog()
        self._stats = Stats(
            files=now.where("origin = 'main' and kind = 'file'").count(),
            indexed=self.content().count(),
            docs_indexed=self.content().count(),
            external=now.where("origin = 'external'").count(),
            duration_ms=int((time.time() - began) * 1000),
            finished_at=datetime.now(timezone.utc).isoformat(timespec="seconds"),
        )
        self._cache.clear()
        self._tell("finished", **vars(self._stats))
        return self._stats

    def replace_external(self, feed: str | DataFrame) -> int:
        """The external entries anew; rows outside their root are dropped.  Refused during a scan."""
        if self.is_scanning:
            raise RuntimeError("a scan is running")
        rows = I.external_catalog(I.feed_from_text(self.spark, feed) if isinstance(feed, str) else feed)
        rows = materialize(rows, "external")
        with self._gate:
            self.store.write({"catalog": self.catalog().where("origin <> 'external'").unionByName(rows.select(*self.catalog().columns))})
        self._cache.clear()
        return rows.count()

    def size_stats(self) -> DataFrame:
        """One row: answers kept in memory and their bytes, files of the data folder and their bytes."""
        self._open()
        m = self.store.manifests
        files = size = 0
        at = m._path(self.store.root)
        if m._fs.exists(at):
            found = m._fs.listFiles(at, True)
            while found.hasNext():
                files, size = files + 1, size + found.next().getLen()
        kept = [c.text for c in self._cache.values()]
        return self.spark.createDataFrame([(len(kept), sum(len(t.encode()) for t in kept), files, size)], "answers bigint, answer_bytes bigint, files bigint, file_bytes bigint")

    def reset(self) -> None:
        with self._gate:
            self.store.write({"catalog": self.catalog().limit(0), "content": self.content().limit(0)})
        self._cache.clear()

    def extract_doc(self, name: str, data: bytes) -> str:
        """The text of a document given as bytes, or an empty one."""
        if len(data) > extraction.MOST_FILE:
            raise QueryError("the document is too large")
        ext = "." + name.rpartition(".")[2].lower() if "." in name else ""
        return extraction.extract(ext, data, self.parsers) or ""
