"""A tolerant reader of the text in XML elements of one name.

Made for documents that may be damaged: it never fails, what was read before an
error is the result.
"""

from __future__ import annotations

import re

_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
_ENTITY = re.compile(r"&(#x[0-9a-fA-F]+|#[0-9]+|[A-Za-z_][\w.-]*);")
_CUT = re.compile(r"&[#\w.-]*\Z")
_TAG = re.compile(r"(/?)([^\s/>]+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")


def _entity(m: re.Match) -> str:
    ref = m[1]
    if ref[0] != "#":
        return _NAMED.get(ref, m[0])
    digits = ref[2:] if ref[1] == "x" else ref[1:]
    code = int(digits, 16 if ref[1] == "x" else 10) if len(digits) < 9 else 0x110000
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def _after_declaration(xml: str, at: int) -> int:
    """Past a declaration with its internal subset; quotes hide brackets."""
    depth, quote = 0, ""
    while at < len(xml):
        ch = xml[at]
        at += 1
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch == "[":
            depth += 1
        elif ch == "]":
            depth -= 1
        elif ch == ">" and depth <= 0:
            return at
        elif ch == "<":
            depth += 1
        elif ch == ">":
            depth -= 1
    return at


def element_text(xml: str, target: str, paragraphs: frozenset[str] = frozenset(), most: int = 1 << 20) -> str:
    """Text inside ``target`` elements, with a line feed at the end of each paragraph element.

    Names are compared without their prefix.  The end of an inner ``target`` ends
    collecting; an end tag that doesn't fit closes elements outwards until one
    does, and one without anything open ends the reading.
    """
    xml = xml.replace("\r\n", "\n").replace("\r", "\n")
    out: list[str] = []
    size, at, inside = 0, 0, False
    open_: list[str] = []

    def emit(s: str) -> None:
        nonlocal size
        out.append(s)
        size += len(s)

    def close(name: str) -> None:
        nonlocal inside
        if name == target:
            inside = False
        if name in paragraphs:
            emit("\n")

    while at < len(xml) and size < most:
        next_ = xml.find("<", at)
        end = next_ if next_ >= 0 else len(xml)
        if end > at and inside:
            node = xml[at:end]
            if next_ >= 0 or not _CUT.search(node):  # a reference cut off by the end spoils its text
                emit(_ENTITY.sub(_entity, node))
        if next_ < 0:
            break
        at = next_ + 1
        if xml.startswith("!--", at):
            stop = xml.find("-->", at + 3)
            at = stop + 3 if stop >= 0 else len(xml)
        elif xml.startswith("![CDATA[", at):
            stop = xml.find("]]>", at + 8)
            if inside:
                emit(xml[at + 8 : stop if stop >= 0 else len(xml)])
            at = stop + 3 if stop >= 0 else len(xml)
        elif xml.startswith("!", at):
            at = _after_declaration(xml, at + 1)
        elif xml.startswith("?", at):
            stop = xml.find("?>", at)
            at = stop + 2 if stop >= 0 else len(xml)
        else:
            m = _TAG.match(xml, at)
            if not m:
                break
            at = m.end()
            name = m[2].rpartition(":")[2]
            if m[1]:
                fits = False
                while open_ and not fits:
                    top = open_.pop()
                    close(top)
                    fits = top == name
                if not fits:
                    break
            elif m[3].endswith("/"):
                close(name)
            else:
                open_.append(name)
                inside = inside or name == target
    return "".join(out)
