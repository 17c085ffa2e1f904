"""One consistent form for text that reads the same.

Reading the same: width, composition of accents, unseen characters, the kind of
space or hyphen, joined letters, variant code points of one character, letters
borrowed from another script.  Not the same, and left alone: letter case, an
accent more or less, raised, lowered or circled figures, signs like the trade
mark, and line breaks.

The method: quick-check properties say which characters can change
(``UNSTABLE``) and which can join with the character before them (``JOINING``).
Only segments made of these, with one character of context in front, are
normalised; the result is spliced into the otherwise untouched text.  Words that
mix scripts are then resolved to the script of their unmistakable letters.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

LAST = 0x30000  # beyond it: variation selectors and tags (ignorable), private use

# --- fixed values -----------------------------------------------------------
# look-alike letters of other scripts and their Latin twins
CYRILLIC = "АВЕКМНОРСТУХІЅЈԚԜӀѴаеорсухіѕјһԁԛԝӏѵ"
CYR_LATIN = "ABEKMHOPCTYXISJQWIVaeopcyxisjhdqwlv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹοϲϳνρ"
GRK_LATIN = "ABEZHIKMNOPTYXCocjvp"
# letters of scripts that lend theirs for their looks only: Armenian, Coptic, Cherokee, Lisu
LENT = "օոսհցգյՕՍՏԼ" + "ⲟⲣⲥⲭⲟⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲎⲂ" + "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏟᏢᏙᏚᏞᏦᏴ" + "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LENT_LATIN = "onuhgqjOUSL" + "opcxoIKMNOPCTYXHB" + "DRTAJEWMHYGZCPVSLKB" + "BPDTGKJCZFMNLSRVHWXYAEIOU"
LATIN_VARIANTS = "ɡɑ"
LATIN_PLAIN = "ga"
# letters hardly used but to imitate Latin ones
IMPOSTORS = "ԁԛԝһѕјϲϳԚԜЅЈϹ"
# hyphens of other kinds; figure, en and em dashes are longer and stay
HYPHENS = "‐‑⁃﹣－"
# format characters that can be seen
VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
# unseen characters that are not of the format category
UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)}
# compatibility characters that are the same character or joined letters
SAME_COMPAT = [(0xB5, 0xB5), (0x132, 0x133), (0x13F, 0x140), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x587, 0x587), (0x2126, 0x212B), (0x2160, 0x217F),
               (0x2E9F, 0x2E9F), (0x2EF3, 0x2EF3), (0x2F00, 0x2FD5), (0xF900, 0xFAFF), (0xFB00, 0xFB4F), (0x2F800, 0x2FA1F)]
SAME_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<vertical>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>"}
# ---------------------------------------------------------------------------


def ignorable(cp: int) -> bool:
    if cp in UNSEEN or 0xE0000 <= cp <= 0xE0FFF:
        return True
    return unicodedata.category(chr(cp)) == "Cf" and cp not in VISIBLE_FORMAT


def fold_char(ch: str) -> str:
    """What one character becomes by itself (before composition)."""
    cp = ord(ch)
    if cp < 0x80:
        return ch
    if ignorable(cp):
        return ""
    if ch in HYPHENS:
        return "-"
    if unicodedata.category(ch) == "Zs":
        return " "
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0][0] == "<":
        if parts[0] not in SAME_TAGS and not (parts[0] == "<compat>" and any(a <= cp <= b for a, b in SAME_COMPAT)):
            return ch
        if parts[0] in ("<isolated>", "<initial>", "<medial>", "<final>") and parts[1] == "0020":
            return ch
        return "".join(fold_char(chr(int(p, 16))) for p in parts[1:])
    if len(parts) == 1:  # a singleton: another code point of the same character
        return fold_char(chr(int(parts[0], 16)))
    if parts and not unicodedata.is_normalized("NFC", ch):
        return unicodedata.normalize("NFC", ch)
    return ch


def _ranges(cps: list[int]) -> str:
    out, start, prev = [], None, None
    for cp in [*cps, None]:
        if start is not None and (cp is None or cp != prev + 1):
            out.append(f"\\U{start:08x}" if start == prev else f"\\U{start:08x}-\\U{prev:08x}")
            start = None
        if start is None:
            start = cp
        prev = cp
    return "".join(out)


class Forms:
    """The tables, derived by rule from the Unicode data of this Python."""

    def __init__(self) -> None:
        fold: dict[int, str] = {}
        joining: set[int] = set()
        for cp in range(0x80, LAST):
            if 0xAC00 <= cp < 0xD7A4 or 0x4E00 <= cp < 0xA000 or 0xD800 <= cp < 0xF900 or 0x3400 <= cp < 0x4DC0:
                continue
            ch = chr(cp)
            to = fold_char(ch)
            if to != ch:
                fold[cp] = to
            if unicodedata.combining(ch):
                joining.add(cp)
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and parts[0][0] != "<":
                joining.add(int(parts[1], 16))
        joining |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # Hangul vowels and finals
        for cp in range(0xE0000, 0xE0200):
            fold[cp] = ""
        self.fold = fold
        self.joining = joining - fold.keys()
        unstable = _ranges(sorted({*fold, *joining}))
        self.unstable = re.compile(f"[{unstable}]")
        self.segment = re.compile(f"[^{unstable}]?[{unstable}]+")
        cyr, grk = dict(zip(CYRILLIC, CYR_LATIN)), dict(zip(GREEK, GRK_LATIN))
        self.lent = dict(zip(LENT, LENT_LATIN))
        twins = {**cyr, **grk, **dict(zip(LATIN_VARIANTS, LATIN_PLAIN)), **self.lent}
        for cp in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:  # accented twins follow their base letters
            d = unicodedata.normalize("NFD", chr(cp))
            if len(d) > 1 and d[0] in twins:
                c = unicodedata.normalize("NFC", twins[d[0]] + d[1:])
                if len(c) == 1:
                    twins[chr(cp)] = c
        self.twins = twins
        back = lambda low, high: {v: k for k, v in twins.items() if low <= ord(k) <= high and k not in IMPOSTORS}
        self.to_cyrillic, self.to_greek = back(0x400, 0x52F), back(0x370, 0x3FF)
        self.latin_with_twin = {*self.to_cyrillic, *self.to_greek, *twins.values()}
        self.skeleton_map = str.maketrans(twins)
        latin, other = "A-Za-zÀ-ɏɡɑḀ-ỿ", "Ͱ-ԯἀ-῿"
        self.mixes = re.compile(f"[{latin}][{other}]|[{other}][{latin}]|[Ͱ-Ͽ][Ѐ-ԯ]|[Ѐ-ԯ][Ͱ-Ͽ]|[{latin}{other}][{LENT}]|[{LENT}][{latin}{other}]|[{IMPOSTORS}{LATIN_VARIANTS}]")
        self.word = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def forms() -> Forms:
    return Forms()


def _script(ch: str) -> int:
    cp = ord(ch)
    if cp < 0x250 or cp in (0x251, 0x261) or 0x1E00 <= cp < 0x1F00:
        return 0
    if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
        return 2
    return 1 if 0x400 <= cp < 0x530 else 3


def _resolve(m: re.Match) -> str:
    """One word: borrowed letters go back to the script of the others."""
    word = m[0]
    f = forms()
    if not f.mixes.search(word):
        return word
    own, letters = [0, 0, 0], [0, 0, 0]
    for ch in word:
        s = _script(ch)
        if s < 3 and ch not in LATIN_VARIANTS:
            letters[s] += 1
            own[s] += not (ch in f.twins or s == 0 and ch in f.latin_with_twin)
    target = max((0, 1, 2), key=lambda s: (own[s], s == 0 and not any(own), letters[s]))
    latin = word.translate(f.skeleton_map) if target == 0 else None
    if target == 0:
        return latin
    back = f.to_cyrillic if target == 1 else f.to_greek
    out = []
    for ch in word:
        if ch not in f.lent and _script(ch) in (target, 3):
            out.append(ch)
        else:
            to = f.twins.get(ch, ch)
            out.append(back.get(to, ch))
    return "".join(out)


def _normalise(m: re.Match) -> str:
    fold = forms().fold
    return unicodedata.normalize("NFC", "".join(fold.get(ord(ch), ch) for ch in m[0]))


def canonical_text(text: str | None) -> str | None:
    """The consistent form of a text; null stays null, empty stays empty.

    Texts that read the same but for wholly borrowed words come out equal; see
    ``reading_key`` for those words too.  Applying it twice changes nothing.
    """
    if text is None or text.isascii():
        return text
    f = forms()
    if f.unstable.search(text):
        text = f.segment.sub(_normalise, text)
    while f.mixes.search(text):  # a letter put right may take up the accent behind it
        before, text = text, unicodedata.normalize("NFC", f.word.sub(_resolve, text))
        if text == before:
            break
    return text


def canonical_spans(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """A text in its form, and for each of its characters where what it was made of begins and ends in the text.

    Should resolving words change the length (an accent taken up), the text is
    left as it is before that.
    """
    f = forms()
    pieces, begins, ends, at = [], [], [], 0
    for m in f.segment.finditer(text):
        new = _normalise(m)
        pieces += [text[at : m.start()], new]
        begins += [np.arange(at, m.start()), np.full(len(new), m.start())]
        ends += [np.arange(at + 1, m.start() + 1), np.full(len(new), m.end())]
        at = m.end()
    pieces.append(text[at:])
    begins.append(np.arange(at, len(text)))
    ends.append(np.arange(at + 1, len(text) + 1))
    formed = "".join(pieces)
    whole = canonical_text(formed)
    return whole if len(whole) == len(formed) else formed, np.concatenate(begins), np.concatenate(ends)


def reading_key(text: str | None) -> str | None:
    """Equal for texts that read the same: look-alike letters as their Latin twins."""
    text = canonical_text(text)
    return text if text is None or text.isascii() else text.translate(forms().skeleton_map)


# --- columns ----------------------------------------------------------------

from pyspark.sql import Column  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

#: Java regex: characters outside these stable ranges, or a mix of scripts.  The ranges
#: are asked one after the other, so the most frequent come first.
_STABLE = r"一-鿿ぁ-ゖА-҂\x00-\x7f¡-¬®-´¶-ıĴ-ľŁ-ǃЀ-ЏҊ-ԀԂ-ԚԞ-ԯ–-―‘-‟•、-〩ゝゞ゠-ヾ"
_LATIN, _OTHER = r"A-Za-zÀ-ɏ", r"Ͱ-ԯἀ-῿"
_MIX = rf"[{_LATIN}][{_OTHER}]|[{_OTHER}][{_LATIN}]|[{IMPOSTORS}]"
NEEDS_WORK = rf"[^{_STABLE}]|{_MIX}"
#: Ranges all letters with a Latin twin lie in.
_TWINS = "Ͱ-ԯɐ-ʯԱ-֏Ꭰ-᏿Ⲁ-⳿ꓐ-꓿ἀ-῿"


def _beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.length(text)


def needs_work(text: Column) -> Column:
    """The quick check inside the JVM: cheap questions first."""
    return _beyond_ascii(text) & (text.rlike(f"[^{_STABLE}]") | text.rlike(f"[{_OTHER}]") & text.rlike(_MIX))


def _canonical_batches(batches):
    import pandas as pd

    for s in batches:
        yield pd.Series([canonical_text(x) for x in s], dtype="object")


def canonical_column(text: Column) -> Column:
    """``canonical_text`` of a string column.

    A regular expression inside the JVM picks the texts that need work; only
    those travel to Python, as the others are null there.
    """
    from collections.abc import Iterator

    import pandas as pd

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _canonical_batches(it)

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, T.StringType())
    return F.coalesce(udf(F.when(needs_work(text), text)), text)


def skeleton_column(text: Column) -> Column:
    """The look-alike letters of a canonical text as their Latin twins; texts without any are passed on."""
    twins = forms().twins
    some = _beyond_ascii(text) & text.rlike(f"[{_TWINS}]")
    return F.when(some, F.translate(text, "".join(twins), "".join(twins.values()))).otherwise(text)
