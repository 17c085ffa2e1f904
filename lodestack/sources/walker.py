"""A Python data source that lists directory trees as catalog rows.

The planner lists folders level by level until there are enough subtrees to give
every task some, so one big folder below a root is walked by many tasks.  Links are listed as files and never followed (but for a root itself);
pruned folders are not entered; what can't be read is skipped.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestack.functions.paths import PRUNED_ANYWHERE

#: Subtrees of a root the planner looks for, and how many levels deep.
SPREAD, LEVELS = 64, 6
SCHEMA = "path string, size bigint, mtime_ms bigint, kind string, scan_root string"


def pruned(name: str, parent: str) -> bool:
    """Whether a folder of this name below ``parent`` is left out with all it holds."""
    return name.startswith(".") or name in PRUNED_ANYWHERE or (name in ("data", "obb") and os.path.basename(parent) == "Android")


def _row(path: str, folder: bool, stat: os.stat_result | None, root: str) -> tuple:
    size = 0 if folder or stat is None else stat.st_size
    return path, size, int(stat.st_mtime * 1000) if stat else 0, "folder" if folder else "file", root


def list_folder(path: str, root: str) -> tuple[list[tuple], list[str]]:
    """Rows of a folder's entries, and the folders to go on with."""
    rows, below = [], []
    try:
        entries = sorted(os.scandir(path), key=lambda e: e.name)
    except OSError:
        return rows, below
    for e in entries:
        try:
            folder = e.is_dir(follow_symlinks=False)
            if pruned(e.name, path) if folder else e.name.startswith("."):
                continue
            rows.append(_row(e.path, folder, e.stat(follow_symlinks=False), root))
            if folder:
                below.append(e.path)
        except OSError:
            continue
    return rows, below


def walk(start: str, root: str) -> Iterator[tuple]:
    stack = [start]
    while stack:
        rows, below = list_folder(stack.pop(), root)
        yield from rows
        stack += below


class _Part(InputPartition):
    """Folders to list, and subtrees to walk, of one root."""

    def __init__(self, root: str, folders: list[str], trees: list[str], first: bool = False):
        super().__init__((root, tuple(folders), tuple(trees), first))
        self.root, self.folders, self.trees, self.first = root, folders, trees, first


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options.get("roots", options.get("path", "")).split("\n") if r]
        self.most = int(options.get("max_entries", 0))
        self.spread = int(options.get("spread", SPREAD))

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for root in self.roots:
            root = root.rstrip("/") or "/"
            if not os.path.exists(root):
                continue
            listed, trees = [], [root] if os.path.isdir(root) else []
            for _ in range(LEVELS):
                if not trees or len(trees) >= self.spread:
                    break
                listed += trees
                trees = [f for t in trees for f in list_folder(t, root)[1]]
            parts.append(_Part(root, [], [], True))
            parts += [_Part(root, listed[k::8], []) for k in range(min(8, len(listed)))]
            n = min(len(trees), 4 * self.spread)
            parts += [_Part(root, [], trees[k::n]) for k in range(n)]
        return parts or [_Part("", [], [])]

    def read(self, part: _Part) -> Iterator[tuple]:
        n = 0
        for row in self._rows(part):
            if self.most and n >= self.most:
                return
            n += 1
            yield row

    def _rows(self, part: _Part) -> Iterator[tuple]:
        if part.first:
            try:
                stat = os.stat(part.root)  # a root that is a link is followed
            except OSError:
                return
            yield _row(part.root, os.path.isdir(part.root), stat, part.root)
        for folder in part.folders:
            yield from list_folder(folder, part.root)[0]
        for start in part.trees:
            yield from walk(start, part.root)


class TreeSource(DataSource):
    """``spark.read.format("tree").option("roots", "a\\nb").load()``; missing roots give no rows.

    ``max_entries`` stops each task after so many rows, ``spread`` is the number
    of subtrees the planner looks for.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan(spark, roots: list[str], max_entries: int = 0):
    """Catalog rows of the trees below ``roots``, each path once; at most ``max_entries`` in all, if given."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("roots", "\n".join(roots))
    if max_entries:
        reader = reader.option("max_entries", str(max_entries))
    rows = reader.load().dropDuplicates(["path"])
    return rows.limit(max_entries) if max_entries else rows
