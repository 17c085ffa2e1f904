"""Text of PDF files: pages in order, strings of the text operators, through the fonts' maps to Unicode.

Objects are found by scanning for them rather than by the cross-reference table,
so files with a damaged table are read too.  Streams may be packed with Flate;
encrypted files, scanned pages and fonts without a map beyond Latin give nothing.
"""

from __future__ import annotations

import re
import zlib

MOST_STREAM = 64 << 20
MOST_CHARS = 1 << 20
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|[+-]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*][A-Za-z0-9'\"*]*|[{}])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name, to be told from an operator."""


class Ref(int):
    """The number of another object."""


class Op(str):
    """An operator or keyword."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets that begins before ``at``; brackets inside may nest."""
    out, depth = bytearray(), 1
    while at < len(data):
        ch = data[at : at + 1]
        at += 1
        if ch == b"\\":
            nxt = data[at : at + 1]
            octal = re.match(rb"[0-7]{1,3}", data[at : at + 3])
            if octal:
                out.append(int(octal[0], 8) & 255)
                at += len(octal[0])
            elif nxt in (b"\r", b"\n"):
                at += 2 if data[at : at + 2] == b"\r\n" else 1
            else:
                out += _ESCAPES.get(nxt, nxt)
                at += 1
            continue
        depth += (ch == b"(") - (ch == b")")
        if not depth:
            break
        out += ch
    return bytes(out), at


def tokens(data: bytes, at: int = 0):
    """``(value, end)``: numbers, names, strings (bytes), lists, dictionaries, references, operators."""
    stack: list[tuple[str, list]] = []
    while m := _TOKEN.match(data, at):
        raw, at = m[1], m.end()
        if raw in (b"<<", b"["):
            stack.append(("d" if raw == b"<<" else "l", []))
            continue
        if raw in (b">>", b"]"):
            if not stack:
                continue
            kind, items = stack.pop()
            value = dict(zip(items[::2], items[1::2])) if kind == "d" and all(isinstance(k, Name) for k in items[::2]) else items if kind == "l" else {}
        elif raw == b"(":
            value, at = _string(data, at)
        elif raw[:1] == b"<":
            digits = re.sub(rb"\s", b"", raw[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif raw[:1] == b"/":
            value = Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda h: chr(int(h[1], 16)), raw[1:].decode("latin-1")))
        elif raw[:1] in b"+-.0123456789":
            value = float(raw) if b"." in raw else int(raw)
        else:
            value = Op(raw.decode("latin-1"))
            if value == "R" and stack and len(stack[-1][1]) >= 2:
                items = stack[-1][1]
                number = items[-2]
                del items[-2:]
                value = Ref(number) if isinstance(number, int) else None
        if stack:
            stack[-1][1].append(value)
        else:
            yield value, at


class File:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("the file is encrypted")
        self.objects: dict[int, tuple[object, bytes]] = {}  # value and packed stream; later ones replace earlier ones
        at = 0
        while m := _OBJECT.search(data, at):
            value, end = next(tokens(data, m.end()), (None, m.end()))
            packed, start = b"", re.compile(rb"\s*stream\r?\n?").match(data, end)
            if start:
                length = value.get("Length") if isinstance(value, dict) else None
                stop = start.end() + length if type(length) is int and data[start.end() + length :].lstrip()[:9] == b"endstream" else data.find(b"endstream", start.end())
                end = stop if stop >= 0 else len(data)
                packed = data[start.end() : end]
            self.objects[int(m[1])] = (value, packed)
            at = max(end, m.end())
        for value, packed in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                self._unpack(value, self._inflate(value, packed))

    def _unpack(self, head: dict, data: bytes) -> None:
        first, count = head.get("First", 0), head.get("N", 0)
        places = [v for v, _ in tokens(data[:first])][: 2 * count]
        for number, place in zip(places[::2], places[1::2]):
            self.objects.setdefault(number, (next(tokens(data, first + place), (None, 0))[0], b""))

    def get(self, value):
        seen = 0
        while isinstance(value, Ref) and seen < 20:
            value, seen = self.objects.get(int(value), (None, b""))[0], seen + 1
        return value

    def stream(self, value) -> bytes:
        if not isinstance(value, Ref) or int(value) not in self.objects:
            return b""
        head, packed = self.objects[int(value)]
        return self._inflate(head, packed)

    def _inflate(self, head, packed: bytes) -> bytes:
        filters = self.get(head.get("Filter")) if isinstance(head, dict) else None
        filters = [self.get(f) for f in filters] if isinstance(filters, list) else [filters] if filters else []
        for f in filters:
            if f not in ("FlateDecode", "Fl"):
                return b""
            packed = zlib.decompressobj().decompress(packed, MOST_STREAM)
        return packed

    def pages(self) -> list[dict]:
        """Page dictionaries in reading order, each with the resources it inherits."""
        out: list[dict] = []
        roots = [v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]

        def visit(node, resources, depth: int) -> None:
            node = self.get(node)
            if not isinstance(node, dict) or depth > 60 or len(out) > 100_000:
                return
            resources = node.get("Resources", resources)
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    visit(kid, resources, depth + 1)
            else:
                out.append(node | {"Resources": resources})

        for root in roots[-1:]:
            visit(root.get("Pages"), None, 0)
        return out or [v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Page"]


class Font:
    """Codes of a font's strings as characters."""

    def __init__(self, file: File, font: dict):
        self.map: dict[bytes, str] = {}
        self.wide = font.get("Subtype") == "Type0"
        held: list = []
        for value, _ in tokens(file.stream(font.get("ToUnicode"))):
            if isinstance(value, Op):
                if value in ("endbfchar", "endbfrange"):
                    self._add(held, 2 if value == "endbfchar" else 3)
                held = []
            else:
                held.append(value)
        if self.map:
            self.wide = max(map(len, self.map)) > 1

    def _add(self, held: list, each: int) -> None:
        for k in range(0, len(held) - each + 1, each):
            first, to = held[k], held[k + each - 1]
            if not isinstance(first, bytes):
                continue
            last = held[k + 1] if each == 3 else first
            low, high = int.from_bytes(first), int.from_bytes(last) if isinstance(last, bytes) else -1
            for n in range(low, min(high, low + 65535) + 1):
                if isinstance(to, list):
                    text = to[n - low].decode("utf-16-be", "replace") if n - low < len(to) and isinstance(to[n - low], bytes) else ""
                else:
                    start = to.decode("utf-16-be", "replace") if isinstance(to, bytes) else ""
                    text = start[:-1] + chr(min(ord(start[-1]) + n - low, 0x10FFFF)) if start else ""
                self.map[n.to_bytes(len(first))] = text

    def read(self, raw: bytes) -> str:
        if not self.map:
            return "" if self.wide else raw.decode("cp1252", "replace")
        step = 2 if self.wide else 1
        return "".join(self.map.get(raw[i : i + step], "") for i in range(0, len(raw), step))


def _page(file: File, page: dict, fonts: dict) -> str:
    resources = file.get(page.get("Resources")) or {}
    named = file.get(resources.get("Font")) if isinstance(resources, dict) else None
    named = named if isinstance(named, dict) else {}
    contents = page.get("Contents")
    parts = file.get(contents) if not isinstance(contents, Ref) or isinstance(file.get(contents), list) else [contents]
    data = b"\n".join(file.stream(p) for p in parts or [])
    out: list[str] = []
    held: list = []
    font, line = None, None

    def fresh_line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for value, _ in tokens(data):
        if not isinstance(value, Op):
            held.append(value)
            continue
        if value == "Tf" and len(held) >= 2:
            key = str(held[-2])
            if key not in fonts.setdefault(id(named), {}):
                found = file.get(named.get(key))
                fonts[id(named)][key] = Font(file, found) if isinstance(found, dict) else None
            font = fonts[id(named)][key]
        elif value in ("Td", "TD") and len(held) >= 2:
            if held[-1]:
                fresh_line()
            elif out and not out[-1].endswith((" ", "\n")):
                out.append(" ")
        elif value == "Tm" and len(held) >= 6:
            if line is not None and held[-1] != line:
                fresh_line()
            line = held[-1]
        elif value in ("T*", "ET"):
            fresh_line()
        if value in ("Tj", "TJ", "'", '"') and held:
            if value in ("'", '"'):
                fresh_line()
            for item in held[-1] if isinstance(held[-1], list) else held[-1:]:
                if isinstance(item, bytes):
                    out.append(font.read(item) if font else item.decode("cp1252", "replace"))
                elif isinstance(item, (int, float)) and item < -200:  # a gap as wide as a space
                    out.append(" ")
        held = []
    fresh_line()
    return "".join(out)


def text(data: bytes) -> str:
    """Text of all pages, each ended by a line feed."""
    file, out, size = File(data), [], 0
    fonts: dict = {}
    for page in file.pages():
        out.append(_page(file, page, fonts))
        size += len(out[-1])
        if size >= MOST_CHARS:
            break
    return "".join(out)
