"""Streams of a compound file (the container of the old office formats)."""

from __future__ import annotations

import struct

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFA  # this and above mark no sector


class CompoundFile:
    """Reads named streams; raises ``ValueError`` if the file is none or damaged."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift != 6:
            raise ValueError("unknown sector sizes")
        self.sector, self.mini = 1 << shift, 1 << mini_shift
        n_fat, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
        self.cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<5I", data, 56)
        places = list(struct.unpack_from("<109I", data, 76))
        at, seen = first_difat, set()
        per = self.sector // 4 - 1
        while at < _END and at not in seen and len(seen) <= n_difat:
            seen.add(at)
            words = struct.unpack(f"<{per + 1}I", self._at(at))
            places += words[:per]
            at = words[per]
        self.fat: list[int] = []
        for p in [p for p in places if p < _END][:n_fat]:
            self.fat += struct.unpack(f"<{self.sector // 4}I", self._at(p))
        self.entries = self._directory(self._chain(first_dir))
        root = next((e for e in self.entries if e[1] == 5), None)
        self.mini_data = self._chain(root[2])[: root[3]] if root else b""
        mini = self._chain(first_mini)
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4])

    def _at(self, n: int) -> bytes:
        start = (n + 1) * self.sector
        part = self.data[start : start + self.sector]
        if not part:
            raise ValueError("a sector lies outside the file")
        return part.ljust(self.sector, b"\0")

    def _chain(self, at: int) -> bytes:
        out, seen = [], set()
        while at < _END:
            if at in seen or at >= len(self.fat):
                raise ValueError("a chain of sectors is broken")
            seen.add(at)
            out.append(self._at(at))
            at = self.fat[at]
        return b"".join(out)

    @staticmethod
    def _directory(raw: bytes) -> list[tuple[str, int, int, int]]:
        out = []
        for k in range(0, len(raw) - 127, 128):
            length = struct.unpack_from("<H", raw, k + 64)[0]
            name = raw[k : k + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
            start, size = struct.unpack_from("<II", raw, k + 116)
            out.append((name, raw[k + 66], start, size))
        return out

    def stream(self, *names: str) -> bytes | None:
        """The first of the named streams that the file has."""
        for want in names:
            for name, kind, start, size in self.entries:
                if kind == 2 and name.lower() == want.lower():
                    return self._small(start, size) if size < self.cutoff else self._chain(start)[:size]
        return None

    def _small(self, at: int, size: int) -> bytes:
        out, seen = [], set()
        while at < _END and len(out) * self.mini < size:
            if at in seen or at >= len(self.mini_fat):
                raise ValueError("a chain of small sectors is broken")
            seen.add(at)
            out.append(self.mini_data[at * self.mini : (at + 1) * self.mini])
            at = self.mini_fat[at]
        return b"".join(out)[:size]
