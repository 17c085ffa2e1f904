"""Code pages as ways back from characters to bytes and on to other characters."""

from __future__ import annotations

import codecs
import re
from functools import lru_cache

# fixed values: pages that text is misread in, and pages it was written in
READ_IN = ["cp1252", "cp437", "cp850", "cp866", "cp1251", "koi8-r", "mac-roman", "gbk", "cp932", "big5", "euc-jp"]
WRITTEN_IN = ["utf-8", "cp1252", "cp1251", "koi8-r", "cp866", "mac-roman", "cp437", "cp850", "gbk", "cp932", "euc-jp", "big5"]
WIDE = {"utf-8", "gbk", "cp932", "big5", "euc-jp"}

_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


@lru_cache(maxsize=None)
def to_byte(page: str) -> dict[str, int]:
    """Characters of a one-byte page; bytes it leaves out stand for themselves."""
    out: dict[str, int] = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(page)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, b)
    if page == "cp1252":  # text misread as Latin-1 shows bytes as control characters
        for b in range(0x80, 0x100):
            out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def from_byte(page: str) -> list[str | None]:
    out: list[str | None] = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(None)
    return out


@lru_cache(maxsize=None)
def _charmaps(page: str) -> tuple[dict[int, int], str]:
    """Both ways of a one-byte page, as the codecs module takes them."""
    return {ord(c): b for c, b in to_byte(page).items()}, "".join("\ufffe" if c is None else c for c in from_byte(page))


def encode(text: str, page: str) -> bytes | None:
    """The bytes that ``page`` shows as ``text``; None if it can't."""
    try:
        if page in WIDE:
            return text.encode(page)
        return codecs.charmap_encode(text, "strict", _charmaps(page)[0])[0]
    except UnicodeEncodeError:
        return None


def decode(data: bytes, page: str) -> str | None:
    try:
        if page in WIDE:
            return data.decode(page)
        return codecs.charmap_decode(data, "strict", _charmaps(page)[1])[0]
    except UnicodeDecodeError:
        return None


def sequences(text: str, read: str) -> list[tuple[str, str]]:
    """``(signs, character)`` of a text of UTF-8 shown in a one-byte page; what is no sequence stands for itself."""
    data = encode(text, read)
    if data is None:
        return [(c, c) for c in text]
    out: list[tuple[str, str]] = []
    at = 0  # characters map to bytes one to one here, so positions agree
    for m in _UTF8.finditer(data):
        try:
            ch = m[0].decode()
        except UnicodeDecodeError:
            continue
        out += [(c, c) for c in text[at : m.start()]] + [(text[m.start() : m.end()], ch)]
        at = m.end()
    return out + [(c, c) for c in text[at:]]


def reread(text: str, read: str, written: str, data: bytes | None = None, table: dict[str, str] | None = None) -> str | None:
    """``text``, shown in ``read``, as it was written in ``written``.

    Of UTF-8, whole sequences are put right and what lies between is kept, as a
    word may be garbled in part; ``table`` says what else a sequence stands for.
    None where that isn't possible or nothing changes.  ``data``: the bytes of
    ``text`` in ``read``, if they are known.
    """
    if data is None:
        data = encode(text, read)
    if data is None:
        return None
    if written == "utf-8" and read not in WIDE:
        if not _UTF8.search(data):
            return None
        new = "".join((table or {}).get(signs, ch) for signs, ch in sequences(text, read))
        return None if new == text else new
    to = decode(data, written)
    return None if to is None or to == text else to
