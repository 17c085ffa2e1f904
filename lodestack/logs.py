"""The last log records of the library, kept in memory and written to a file on demand."""

from __future__ import annotations

import logging
from collections import deque

# fixed value: records kept
KEPT = 3000


class Ring(logging.Handler):
    """Keeps the last ``most`` records of at least ``level``; the oldest go first."""

    def __init__(self, most: int = KEPT, level: int = logging.INFO):
        super().__init__(level)
        self.records: deque[str] = deque(maxlen=most)
        self.setFormatter(logging.Formatter("%(asctime)s %(levelname).1s %(name)s: %(message)s"))

    def emit(self, record: logging.LogRecord) -> None:
        self.records.append(self.format(record))

    def export(self, path: str) -> int:
        """Write what is kept to a file, oldest first; how many records."""
        kept = list(self.records)
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(f"{r}\n" for r in kept)
        return len(kept)


logger = logging.getLogger("lodestack")
logger.setLevel(logging.DEBUG)
ring = Ring()
logger.addHandler(ring)
