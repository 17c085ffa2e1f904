"""Tokens of whole batches of texts, as hashes, in numpy.

A token is a maximal run of letters and digits of the lowered text; each Chinese
character and each kana is one by itself; all else separates.  Differences that
``forms`` levels don't count.  A token is represented by a 64-bit polynomial
hash of its characters, mixed once more.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from lodestack.llm.forms import LAST, canonical_text, forms

SEP, WORD, SINGLE, SLOW = 0, 1, 2, 3
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: scatters the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _is_single(cp: int) -> bool:
    return (
        0x3041 <= cp <= 0x3096 or 0x309D <= cp <= 0x309F or 0x30A1 <= cp <= 0x30FA or 0x30FC <= cp <= 0x30FF or 0x31F0 <= cp <= 0x31FF
        or 0x3005 <= cp <= 0x3007 or 0x3400 <= cp <= 0x4DBF or 0x4E00 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF or 0x20000 <= cp < LAST
    )


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(kind, code, script)`` by code point, the last entry for all beyond.

    ``kind`` is SLOW where the character needs its neighbours or becomes several.
    """
    f = forms()
    kind = np.zeros(LAST + 1, np.uint8)
    code = np.arange(LAST + 1, dtype=np.uint64)
    script = np.zeros(LAST + 1, np.uint8)
    slow = {*f.fold, *f.joining}
    skeleton = f.skeleton_map
    for cp in range(LAST):
        if 0xD800 <= cp < 0xE000:
            continue
        if _is_single(cp):
            to = f.fold.get(cp, chr(cp))
            kind[cp] = SINGLE if len(to) == 1 and cp not in f.joining else SLOW
            code[cp] = ord(to[0]) if to else 0
        elif 0xAC00 <= cp < 0xD7A4:
            kind[cp] = WORD
        else:
            ch = chr(cp)
            to = f.fold.get(cp, ch)
            if cp in slow:
                # a fold to one character that nothing joins needs no neighbours
                if len(to) != 1 or cp in f.joining or ord(to) in f.joining:
                    kind[cp] = SLOW
                    continue
            low = to.lower()
            if len(low) != 1:
                kind[cp] = SLOW
                continue
            low = low.translate(skeleton)
            target = ord(low)
            if _is_single(target):
                kind[cp] = SINGLE
            elif unicodedata.category(low)[0] == "L" or unicodedata.category(low) == "Nd":
                kind[cp] = WORD
            code[cp] = target
            if kind[cp] == WORD:
                if target < 0x250 or 0x1E00 <= target < 0x1F00:
                    script[cp] = 1
                elif 0x370 <= target < 0x530 or 0x1F00 <= target < 0x2000:
                    script[cp] = 2
                if "0" <= low <= "9":
                    script[cp] = 0
    for ch in f.twins:  # a twin counts to the script it was borrowed from
        script[ord(ch)] = 2 if ord(ch) >= 0x370 else 1
    kind[LAST] = SLOW
    code = mix(code + np.uint64(0x51ED27))
    return kind, code, script


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    done = 1
    while done < n:  # doubling
        m = min(done, n - done)
        up[done : done + m] = up[:m] * np.multiply(up[done - 1 : done], _BASE)
        down[done : done + m] = down[:m] * np.multiply(down[done - 1 : done], inverse)
        done += m
    return up, down


@dataclass
class Tokens:
    hashes: np.ndarray  # uint64, all texts after one another
    starts: np.ndarray  # of text i: hashes[starts[i]:starts[i + 1]]


def _plain(text: str) -> str:
    """The slow path: form, case and look-alikes, with neighbours in view.

    What still isn't a single letter afterwards (a mark without its base)
    separates.
    """
    f = forms()
    low = canonical_text(canonical_text(text).lower()).translate(f.skeleton_map)
    kind = tables()[0]
    return "".join(ch if ord(ch) < LAST and kind[ord(ch)] != SLOW else " " for ch in low)


def _codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "\n".join(texts) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cps) and cps.max() > LAST:
        cps = np.minimum(cps, LAST)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return cps, ends


def tokenize(texts: list[str]) -> Tokens:
    """Token hashes of each text; null and blank texts have none."""
    texts = [t or "" for t in texts]
    if not texts:
        return Tokens(np.empty(0, np.uint64), np.zeros(1, np.int64))
    kind_of, code_of, script_of = tables()
    cps, ends = _codepoints(texts)
    kind = kind_of[cps]
    script = script_of[cps]
    odd = kind == SLOW
    odd[1:] |= (script[1:] * script[:-1]) == 2
    if odd.any():
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(odd), side="right")):
            texts[i] = _plain(texts[i])
        cps, ends = _codepoints(texts)
        kind = kind_of[cps]
    del script, odd
    word = kind == WORD
    begins = kind == SINGLE
    begins[0] |= word[0]
    begins[1:] |= word[1:] & ~word[:-1]
    at = np.flatnonzero(begins)
    up, down = _powers(1 << max(10, int(len(cps) - 1).bit_length()))
    values = code_of[cps]
    values *= up[: len(cps)]
    values[kind == SEP] = 0
    total = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    stop = np.append(at[1:], len(cps))  # separators in between add nothing
    hashes = mix((total[stop] - total[at]) * down[at])
    starts = np.concatenate(([0], np.searchsorted(at, ends)))
    return Tokens(hashes, starts)


def slices(texts: list, most_chars: int = 1 << 19) -> list[tuple[int, int]]:
    """Consecutive ranges of texts that are tokenised together: bounds the memory."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most_chars:
            out.append((start, i + 1))
            start, held = i + 1, 0
    if start < len(texts):
        out.append((start, len(texts)))
    return out


def ngrams(tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, position, text)`` of every run of n tokens that lies in one text."""
    h = tokens.hashes
    if len(h) < n:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e
    m = len(h) - n + 1
    g = np.zeros(m, np.uint64)
    for i in range(n):
        g = g * np.uint64(0xD1342543DE82EF95) + h[i : i + m]
    owner = np.repeat(np.arange(len(tokens.starts) - 1), np.diff(tokens.starts))
    whole = owner[:m] == owner[n - 1 :]
    pos = np.flatnonzero(whole)
    return mix(g[pos]), pos, owner[pos]
