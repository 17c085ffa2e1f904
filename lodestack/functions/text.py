"""Text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
SNIPPET_BYTES = 40
MAX_TEXT_BYTES = 1_048_576
#: Characters dropped from stored text: control characters but tab and line
#: feed, the replacement character, private use and non-characters.
DROPPED = r"[\x{0}-\x{8}\x{E}-\x{1F}\x{7F}-\x{9F}\x{FFFD}\x{E000}-\x{F8FF}\x{FDD0}-\x{FDEF}" + "".join(rf"\x{{{p * 0x10000 + 0xFFFE:X}}}\x{{{p * 0x10000 + 0xFFFF:X}}}" for p in range(17)) + "]"
#: What separates the terms of a content query.
UNICODE_SPACE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACE_PY = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", UNICODE_SPACE)


def lower_simple(c: Column) -> Column:
    """Lower case character by character: no context, no character becomes two."""
    return F.lower(F.when(c.rlike("[İΣ]"), F.translate(c, "İΣ", "iσ")).otherwise(c))


def once(c: Column) -> Column:
    """A column whose expression the optimizer won't copy into what is built on it."""
    return F.explode(F.array(c))


def let(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), of), 1)


def sanitize(c: Column) -> Column:
    """Vertical tabs, form feeds and the Unicode line ends become line feeds; what can't be shown goes.

    ``c`` occurs once in the result, so chains of these stay as long as they look.
    """
    return F.regexp_replace(F.translate(c, "\x0b\x0c\u2028\u2029", "\n\n\n\n"), DROPPED, "")


def normalize_for_store(c: Column) -> Column:
    """One kind of line end, then ``sanitize``."""
    return sanitize(F.regexp_replace(c, "\r\n?", "\n"))


def stored_form(text: str) -> str:
    """``normalize_for_store`` of a single text, for queries."""
    text = re.sub("\r\n?", "\n", text).translate(dict.fromkeys((0x0B, 0x0C, 0x2028, 0x2029), "\n"))
    return "".join(ch for ch in text if not _dropped(ord(ch)))


def _dropped(cp: int) -> bool:
    if cp in (0x9, 0xA, 0xD):
        return False
    return cp < 0x20 or 0x7F <= cp < 0xA0 or cp == 0xFFFD or 0xE000 <= cp <= 0xF8FF or 0xFDD0 <= cp <= 0xFDEF or cp & 0xFFFE == 0xFFFE


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"[^" + UNICODE_SPACE[1:])


def truncate_bytes(c: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` UTF-8 bytes that ends with a whole character."""

    def cut(data: Column) -> Column:
        # bytes of the last, broken character are those after the last byte that begins one
        last = F.substring(data, F.lit(most - 2), 4)
        begins = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.lit(0), lambda acc, k: F.when(~F.hex(F.substring(last, k, F.lit(1))).between("80", "BF"), k).otherwise(acc))
        return F.decode(F.substring(data, F.lit(1), F.lit(most - 4) + begins), "UTF-8")

    if most < 4:
        return F.left(c, F.aggregate(F.sequence(F.lit(0), F.lit(most)), F.lit(0), lambda acc, k: F.when(F.octet_length(F.left(c, k)) <= most, k).otherwise(acc)))
    return F.element_at(F.transform(F.array(c), lambda x: F.when(F.octet_length(x) <= most, x).otherwise(cut(F.encode(x, "UTF-8")))), 1)


def char_array(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def bigrams(c: Column) -> Column:
    """Overlapping character pairs; one character gives itself, none an empty array."""
    a = char_array(c)
    pairs = F.transform(F.arrays_zip(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))).alias("a"), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))).alias("b")), lambda x: F.concat(x["a"], x["b"]))
    return F.when(F.size(a) <= 1, a).otherwise(pairs)


def uni_bigrams(c: Column) -> Column:
    """Every character, and every overlapping pair."""
    a = char_array(c)
    return F.when(F.size(a) <= 1, a).otherwise(F.concat(a, bigrams(c)))


def words(c: Column) -> Column:
    """Maximal runs of ASCII letters and digits, and maximal runs beyond ASCII, of lowered text."""
    return F.regexp_extract_all(lower_simple(c), F.lit(r"[a-z0-9]+|[^\x00-\x7F]+"), F.lit(0))


def gram_count(text: Column, gram: str) -> Column:
    """Overlapping occurrences of one character or of a pair."""
    if len(gram) == 2 and gram[0] == gram[1]:
        return F.regexp_count(text, F.lit("(?=" + _quote(gram) + ")")).cast("bigint")
    return ((F.length(text) - F.length(F.replace(text, F.lit(gram), F.lit("")))) / len(gram)).cast("bigint")


def _quote(s: str) -> str:
    return "".join(f"\\x{{{ord(ch):X}}}" for ch in s)


def term_grams(term: str) -> list[str]:
    return [term] if len(term) == 1 else [term[i : i + 2] for i in range(len(term) - 1)]


def trim_unicode(c: Column) -> Column:
    return F.regexp_replace(c, f"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")


def _most(text: Column, side, fits, start: Column, pick) -> Column:
    """The number of characters ``side`` may take of a short text, by trying all."""
    return F.aggregate(F.sequence(F.lit(0), F.length(text)), start, lambda acc, k: F.when(fits(F.octet_length(side(text, k))), pick(acc, k)).otherwise(acc))


def snippet(text: Column, lowered: Column, term: str) -> Column:
    """The first occurrence with 40 bytes of context on each side, cut at characters.

    Line feeds become spaces, the ends are trimmed, an ellipsis marks a cut.
    """
    n = len(term)

    def body(v: Column) -> Column:
        # context beyond 40 characters can't be within 40 bytes
        near = lambda w: F.right(w["before"], _most(w["before"], F.right, lambda b: b <= SNIPPET_BYTES, F.lit(0), F.greatest))
        rest = lambda w: F.left(w["after"], _most(w["after"], F.left, lambda b: b >= SNIPPET_BYTES, F.length(w["after"]), F.least))
        at, source = v["at"], v["source"]
        parts = F.struct(
            F.right(F.substring(source, F.lit(1), at - 1), F.lit(SNIPPET_BYTES)).alias("before"),
            F.substring(source, at, F.lit(n)).alias("hit"),
            F.substring(source, at + n, F.lit(SNIPPET_BYTES)).alias("after"),
            (at - 1).alias("n_before"),
            F.greatest(F.length(source) - at - n + 1, F.lit(0)).alias("n_after"),
        )
        sides = lambda w: F.struct(near(w).alias("left"), w["hit"].alias("hit"), rest(w).alias("right"), w["n_before"].alias("n_before"), w["n_after"].alias("n_after"))
        cut = lambda more: F.when(more, F.lit("…")).otherwise(F.lit(""))
        shown = lambda w: F.concat(
            cut(w["n_before"] > F.length(w["left"])),
            trim_unicode(F.translate(F.concat(w["left"], w["hit"], w["right"]), "\n", " ")),
            cut(w["n_after"] > F.length(w["right"])),
        )
        return let(let(parts, sides), shown)

    source = F.when(F.length(text) == F.length(lowered), text).otherwise(lowered)
    return let(F.struct(F.instr(lowered, F.lit(term)).alias("at"), source.alias("source")), body)
