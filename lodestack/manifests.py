"""Numbered manifests: what a folder of immutable files currently consists of.

A manifest is written under its final name by a create that fails if the name is
taken, so two writers can't both publish one number, on object stores neither.
It ends with a mark; one without (its writer died, or is still writing) isn't
committed: readers go on with the one before, writers refuse while it is young
and take the next number when it is old.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession

#: Seconds after which a manifest without its mark counts as left behind.
ABANDONED_AFTER = 600
#: Seconds a folder that no manifest names is left alone: a writer may be filling
#: it, or a reader of an older manifest may still have it open.
KEEP_UNNAMED = 3600


class Conflict(RuntimeError):
    """Another writer was faster."""


class Manifests:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        at = self._path(f"{self.root}/manifests")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _at(self, number: int):
        return self._path(f"{self.root}/manifests/{number}.json")

    def read(self, number: int) -> dict | None:
        """The content of a manifest, None if it isn't whole; errors of the file system are raised."""
        stream = self._fs.open(self._at(number))
        try:
            data = bytes(stream.readAllBytes())
        except Exception as e:
            if "ChecksumException" in str(e):  # half written, on file systems that keep sums
                return None
            raise
        finally:
            stream.close()
        try:
            found = json.loads(data.decode())
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def latest(self, writing: bool = False) -> tuple[int, dict | None]:
        """``(number, content)`` of the newest whole manifest, ``(0, None)`` without one.

        A writer is told the greatest number in use, and refuses to go on beside
        a manifest that is just being written.
        """
        numbers = self.numbers()
        for n in reversed(numbers):
            content = self.read(n)
            if content is not None:
                return (numbers[-1] if writing else n), content
            age = time.time() - self._fs.getFileStatus(self._at(n)).getModificationTime() / 1000
            if writing and age < ABANDONED_AFTER:
                raise Conflict(f"manifest {n} of {self.root} is being written")
        return (numbers[-1] if writing and numbers else 0), None

    def publish(self, number: int, content: dict) -> None:
        """Create manifest ``number``; fails if it exists."""
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        try:
            stream = self._fs.create(self._at(number), False)
        except Exception as e:
            if self._fs.exists(self._at(number)):
                raise Conflict(f"another writer has published version {number} of {self.root}") from e
            raise
        stream.write(json.dumps(content).encode())
        stream.close()

    def forget(self, keep: int, parents: list[str], named) -> None:
        """Drop manifests but the last ``keep``, and folders below ``parents`` none of these names.

        ``named(content)`` lists a manifest's folders.  Folders younger than
        ``KEEP_UNNAMED`` stay: a writer or an older reader may use them.
        """
        numbers = self.numbers()
        used: set[str] = set()
        for n in numbers[-keep:]:
            content = self.read(n)
            if content is None:
                return  # someone is writing: another time
            used |= set(named(content))
        for n in numbers[:-keep]:
            self._fs.delete(self._at(n), False)
        for parent in parents:
            at = self._path(f"{self.root}/{parent}" if parent else self.root)
            if not self._fs.exists(at):
                continue
            for f in self._fs.listStatus(at):
                name = f"{parent}/{f.getPath().getName()}" if parent else f.getPath().getName()
                if name != "manifests" and name not in used and time.time() - f.getModificationTime() / 1000 > KEEP_UNNAMED:
                    self._fs.delete(f.getPath(), True)
