"""Text of docx, pptx and xlsx files."""

from __future__ import annotations

import io
import re
import zipfile

from lodestack.sources.extract.xmltext import element_text

#: Uncompressed bytes read of one entry at most.
MOST_ENTRY = 128 << 20
MOST_TEXT = 1 << 20
_SLIDE = re.compile(r"ppt/(slides/slide|notesSlides/notesSlide)(\d*)[^/]*\Z")
_SHEET = re.compile(r"xl/worksheets/[^/]*\.xml\Z")


def _read(z: zipfile.ZipFile, name: str) -> str:
    with z.open(name) as f:
        return f.read(MOST_ENTRY).decode("utf-8-sig", "replace")


def docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n == "word/document.xml"]
        return "".join(element_text(_read(z, n), "t", frozenset("p")) for n in names[:1])


def pptx(data: bytes) -> str:
    """Slides in numeric order, each before its notes; blank ones are skipped."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = [(int(m[2] or 0), m[1].startswith("notes"), n) for n in z.namelist() if (m := _SLIDE.match(n))]
        parts, size = [], 0
        for *_, name in sorted(found):
            text = element_text(_read(z, name), "t", frozenset("p"))
            if text.strip():
                parts.append(text)
                size += len(text)
            if size > MOST_TEXT:
                break
        return "\n".join(parts)


def xlsx(data: bytes) -> str:
    """Shared strings and the sheets' own texts, in the order of the file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts, size = [], 0
        for name in z.namelist():
            if name == "xl/sharedStrings.xml" or _SHEET.match(name):
                parts.append(element_text(_read(z, name), "t", frozenset(["row"])))
                size += len(parts[-1])
            if size > MOST_TEXT:
                break
        return "\n".join(parts)
