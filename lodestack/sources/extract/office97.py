"""Text of doc, wps, xls and ppt files, after the public format descriptions."""

from __future__ import annotations

import re
import struct

from lodestack.sources.extract.cfb import CompoundFile

MOST_CHARS = 1 << 20
# --- fixed values -------------------------------------------------------------
LCID_PAGE = {0x0804: "gb18030", 0x0C04: "gb18030", 0x1004: "gb18030", 0x0404: "big5", 0x0411: "cp932", 0x0412: "euc_kr"}
SHEET_PAGE = {936: "gb18030", 950: "big5", 932: "cp932", 949: "euc_kr", 1252: "cp1252", 65001: "utf-8"}
_DOC_SIGNS = {0x0D: "\n", 0x07: "\n", 0x0B: "\n", 0x0C: "\n", 0x1E: "-", 0x09: "\t"}
# -------------------------------------------------------------------------------


#: A field: its instruction, then maybe its result; without others inside.
_FIELD = re.compile("\x13[^\x13\x14\x15]*(?:\x14([^\x13\x14\x15]*))?\x15")
_SHOWN = dict.fromkeys(range(0x20)) | _DOC_SIGNS


class _Word:
    """A Word document by its information block: where the table of pieces is, and what a narrow piece is encoded in."""

    def __init__(self, data: bytes):
        cfb = CompoundFile(data)
        self.text = cfb.stream("WordDocument") or b""
        ident, _, _, language, _, flags = struct.unpack_from("<6H", self.text.ljust(12, b"\0"))
        if ident != 0xA5EC or len(self.text) < 0x1AA:
            raise ValueError("not a Word document")
        if flags >> 8 & 1:
            raise ValueError("the document is encrypted")
        named = f"{flags >> 9 & 1}Table"
        self.table = cfb.stream(named, "0Table", "1Table") or b""
        self.page = LCID_PAGE.get(language, "cp1252")
        at, size = struct.unpack_from("<II", self.text, 0x1A2)
        self.clx = self.table[at : at + size]
        if not size or len(self.clx) < size:
            raise ValueError("the piece table is missing")

    def pieces(self):
        """``(offset, bytes a character, characters)`` of the pieces in order."""
        clx = memoryview(self.clx)
        while clx and clx[0] == 1:  # formatting runs before the table
            clx = clx[3 + int.from_bytes(clx[1:3], "little") :]
        size = int.from_bytes(clx[1:5], "little") if clx and clx[0] == 2 else 0
        plc = clx[5 : 5 + size]
        if size < 4 or len(plc) < size:
            raise ValueError("the piece table is damaged")
        count = (size - 4) // 12
        ends, descriptors = plc[: 4 * count + 4].cast("i"), plc[4 * count + 4 :]
        for k in range(count):
            place = int.from_bytes(descriptors[8 * k + 2 : 8 * k + 6], "little")
            narrow, place = bool(place >> 30 & 1), place & 0x3FFFFFFF
            yield (place // 2, 1, ends[k + 1] - ends[k]) if narrow else (place, 2, ends[k + 1] - ends[k])

    def read(self) -> str:
        """The text of all pieces that lie inside the file, fields and all."""
        out, size = [], 0
        for place, width, chars in self.pieces():
            raw = self.text[place : place + width * chars] if chars > 0 else b""
            if not raw or len(raw) < width * chars:
                continue
            out.append(raw.decode(self.page if width == 1 else "utf-16-le", "replace"))
            size += len(out[-1])
            if size >= MOST_CHARS:
                break
        return "".join(out)


def doc(data: bytes) -> str:
    """The text of a Word document; of fields, the results.

    Fields are taken away from the innermost outwards; marks of fields that don't
    begin or end are dropped and what stands between them is kept.
    """
    text, n = _Word(data).read(), 1
    while n:
        text, n = _FIELD.subn(lambda m: m[1] or "", text)
    return text.translate(_SHOWN)


def xls(data: bytes) -> str:
    """Texts of the shared string table, or the labels of older workbooks, a line each."""
    cfb = CompoundFile(data)
    book = cfb.stream("Workbook", "Book")
    if book is None:
        raise ValueError("not a workbook")
    page, strings, labels = "gb18030", [], []
    at = size = 0
    while at + 4 <= len(book) and size < MOST_CHARS:
        kind, length = struct.unpack_from("<HH", book, at)
        body = book[at + 4 : at + 4 + length]
        at += 4 + length
        if kind == 0x2F:
            raise ValueError("the workbook is encrypted")
        if kind == 0x42 and length >= 2:
            page = SHEET_PAGE.get(struct.unpack_from("<H", body)[0], "gb18030")
        elif kind == 0xFC:
            parts = [body]
            while at + 4 <= len(book) and struct.unpack_from("<H", book, at)[0] == 0x3C:
                more = struct.unpack_from("<H", book, at + 2)[0]
                parts.append(book[at + 4 : at + 4 + more])
                at += 4 + more
            strings += _shared_strings(parts)
        elif kind == 0x204 and length >= 8:
            count = struct.unpack_from("<H", body, 6)[0]
            if len(body) >= 9 and body[8] in (0, 1) and len(body) == 9 + count * (1 + body[8]):
                labels.append(body[9:].decode("utf-16-le" if body[8] else "latin-1", "replace"))
            else:
                labels.append(body[8 : 8 + count].decode(page, "replace"))
            size += len(labels[-1])
    return "\n".join(s for s in strings + labels if s)


class _Parts:
    """A string table that goes on over several records."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def more(self) -> bool:
        while self.k < len(self.parts) and self.at >= len(self.parts[self.k]):
            self.k, self.at = self.k + 1, 0
        return self.k < len(self.parts)

    def take(self, n: int) -> bytes:
        out = b""
        while n > 0 and self.more():
            piece = self.parts[self.k][self.at : self.at + n]
            self.at += len(piece)
            n -= len(piece)
            out += piece
        if n:
            raise EOFError
        return out

    def chars(self, count: int, wide: bool) -> str:
        """Characters; a new record repeats the flag of their width."""
        out = ""
        first = self.k
        while count > 0 and self.more():
            if self.k != first:
                wide, first = bool(self.take(1)[0] & 1), self.k
            room = (len(self.parts[self.k]) - self.at) // (2 if wide else 1)
            n = min(count, room)
            if n == 0:
                self.at = len(self.parts[self.k])
                continue
            out += self.take(2 * n if wide else n).decode("utf-16-le" if wide else "latin-1", "replace")
            count -= n
        return out


def _shared_strings(parts: list[bytes]) -> list[str]:
    src, out, size = _Parts(parts), [], 0
    try:
        unique = struct.unpack("<II", src.take(8))[1]
        for _ in range(unique):
            if not src.more() or size >= MOST_CHARS:
                break
            count, flags = struct.unpack("<HB", src.take(3))
            runs = struct.unpack("<H", src.take(2))[0] if flags & 8 else 0
            extra = struct.unpack("<I", src.take(4))[0] if flags & 4 else 0
            out.append(src.chars(count, bool(flags & 1)))
            src.take(4 * runs + extra)  # formatting and phonetics follow the characters
            size += len(out[-1])
    except EOFError:
        pass
    return out


def ppt(data: bytes) -> str:
    """The text atoms of a presentation, a line each."""
    stream = CompoundFile(data).stream("PowerPoint Document")
    if stream is None:
        raise ValueError("not a presentation")
    out: list[str] = []
    size = 0

    def records(start: int, end: int, depth: int) -> None:
        nonlocal size
        at = start
        while at + 8 <= end and size < MOST_CHARS:
            version, kind, length = struct.unpack_from("<HHI", stream, at)
            body, at = at + 8, at + 8 + length
            stop = min(at, end)
            if version & 0xF == 0xF:
                if depth < 32:
                    records(body, stop, depth + 1)
                continue
            if kind in (0x0FA0, 0x0FBA):
                text = stream[body : body + (stop - body) // 2 * 2].decode("utf-16-le", "replace")
            elif kind == 0x0FA8:
                text = stream[body:stop].decode("latin-1")
            else:
                continue
            text = text.replace("\r", "\n").replace("\x0b", "\n").strip("\0")
            if text.strip():
                out.append(text)
                size += len(text)

    records(0, len(stream), 0)
    return "\n".join(out)
