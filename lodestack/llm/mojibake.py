"""Text that was decoded with the wrong character encoding, and its original.

A code-page swap is a substitution cipher: each sign of the garbled text (of
UTF-8, each sequence of signs) stands for a letter.  What the signs mean is
learned from the texts (``ciphers``): runs that no language would write are
gathered by source, and expectation-maximisation against the letter bigrams of
clean text estimates each source's table from its counts of sign pairs.

A source is one of two things.  Runs that a known pair of pages makes readable
are gathered by that pair; the pages are where their table begins, not what it
has to be.  Runs that no known pair explains are gathered by where they come
from (``source`` of a row); if such a source is garbled throughout, its table is
learned from random starts, so a page nobody listed is read too.  The tables are
applied with ``str.translate``.  East Asian pages, whose signs stand for halves
of thousands of characters, have no letters to learn; they are read again by
their rule and rated by the same bigrams.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import ciphers
from lodestack.llm import codepages as cp
from lodestack.llm.forms import canonical_text, forms
from lodestack.llm.tokens import slices
from lodestack.session import materialize

#: Bigrams rarer than this make a run worth looking at.
SUSPECT = -7.5
LIMIT = 0x30000
#: What a Han character gains at most (nats) for being frequent in the corpus.
MOST_FAMILIAR = 4.0
#: Below this a Han character is one the corpus hardly has.
UNFAMILIAR = -0.9
#: What a letter costs that stands in a word of another script and looks like none of its letters.
FOREIGN = 6.0


# --- the language: bigrams of characters -------------------------------------


def _han_class(cp_: int) -> str:
    """By the first and second level of the basic Chinese and Japanese sets."""
    ch, level = chr(cp_), "rare_han"
    for page, first, last in (("gb2312", 0xB0, 0xD7), ("shift_jis", 0x88, 0x98)):
        try:
            lead = ch.encode(page)[0]
        except UnicodeEncodeError:
            continue
        if first <= lead <= last:
            return "han"
        if page == "gb2312":
            level = "han2"
    return level


#: Classes of characters unknown to the training text: name, share of one
#: character of the class, in nats.
_CLASSES = [
    ("han", -8.2), ("han2", -11.0), ("rare_han", -13.5), ("latin", -9.5), ("letter", -10.0), ("sign", -10.0), ("mark", -12.0), ("half_kana", -10.5),
    ("drawing", -11.0), ("control", -16.0), ("lost", -18.0), ("wide", -8.5), ("punct", -8.0), ("digit", -4.0), ("unseen", -9.0), ("other", -12.0), ("quote", -8.5),
]
_CLASS = {name: k for k, (name, _) in enumerate(_CLASSES)}


def _class_of(cp_: int) -> str:
    if cp_ == 0xFFFD:
        return "lost"
    if 0x30 <= cp_ <= 0x39:
        return "digit"
    if 0x4E00 <= cp_ <= 0x9FFF:
        return _han_class(cp_)
    if cp_ in (0x9, 0xA, 0xD, 0x20):
        return "punct"
    cat = unicodedata.category(chr(cp_))
    if cat == "Cc" or cat == "Co" or cat == "Cn" or cat == "Cs":
        return "control"
    if cat == "Cf":
        return "unseen"
    if 0xFF61 <= cp_ <= 0xFF9F:
        return "half_kana"
    if 0xFF00 <= cp_ <= 0xFF60 or 0x3000 <= cp_ <= 0x30FF:
        return "wide"
    if 0x2500 <= cp_ <= 0x25FF:
        return "drawing"
    if cat[0] == "M":
        return "mark"
    if cat in ("Ll", "Lu") and cp_ < 0x250:
        return "latin"
    if cat[0] == "L":
        return "rare_han" if 0x3400 <= cp_ or cat in ("Lo",) and cp_ >= 0x2E80 else "letter"
    if cp_ < 0x80:
        return "punct"
    if 0x2010 <= cp_ <= 0x2027:
        return "quote"
    return "sign" if cp_ < 0x2500 else "other"


def _foreign(run: str) -> int:
    """Letters beside those of another script that aren't borrowed for their looks."""
    return 0 if run.isascii() else sum(m[0] not in forms().twins for m in _SEAM.finditer(run))


def _fixed(i: int) -> str | None:
    """The class of a code point that is never a symbol by itself."""
    if 0x4E00 <= i <= 0x9FFF:
        return _han_class(i)
    if 0x3400 <= i < 0x4E00 or 0xA000 <= i < 0xE000 or i >= 0x20000:
        return "rare_han" if i < 0xD800 or i >= 0x20000 else "control"
    return None


_FIXED = [_fixed(i) for i in range(LIMIT + 1)]
#: The first code point of its class, for those that are never symbols.
_FOLD = np.arange(LIMIT + 1)
for _name in {c for c in _FIXED if c}:
    _same = [i for i, c in enumerate(_FIXED) if c == _name]
    _FOLD[_same] = _same[0]


def count_pairs(texts: list[str], into: Counter[tuple[int, int]] | None = None) -> Counter[tuple[int, int]]:
    """How often two code points follow one another, a text between spaces; with -1: that a letter occurs in lower case."""
    out = Counter() if into is None else into
    for i, j in slices(texts):
        part = [np.minimum(np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), np.uint32), LIMIT) for t in texts[i:j]]
        if not part:
            continue
        code, n = np.unique(np.concatenate([_FOLD[r[:-1]] << 18 | _FOLD[r[1:]] for r in part]), return_counts=True)
        for k, m in zip(code.tolist(), n.tolist()):
            out[k >> 18, k & (1 << 18) - 1] += m
        for c in set().union(*(t.lower() for t in texts[i:j])):
            if not "0" <= c <= "9" and ord(c) < LIMIT and _FIXED[ord(c)] is None:
                out[ord(c), -1] = 1
    return out


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple[int, int]] = Counter()
    for batch in batches:
        count_pairs(batch.column(0).to_pylist(), counts)
    cols = [pa.array([a for a, _ in counts], pa.int32()), pa.array([b for _, b in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())]
    yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "n"])


class Language:
    """Log probabilities of character pairs, case apart, counted over clean text: the texts, or what ``count_pairs`` gives of them."""

    def __init__(self, texts: list[str] | Counter[tuple[int, int]]):
        pairs = texts if isinstance(texts, Counter) else count_pairs(texts)
        known = sorted(chr(a) for a, b in pairs if b < 0)
        base = len(_CLASSES)
        self.size = base + len(known)
        self.letters = {c: base + k for k, c in enumerate(known)}
        sym = np.empty(LIMIT + 1, np.int16)
        for i in range(LIMIT + 1):
            if _FIXED[i] is not None:
                sym[i] = _CLASS[_FIXED[i]]
                continue
            low = chr(i).lower()
            sym[i] = self.letters.get(low, -1) if len(low) == 1 else -1
            if sym[i] < 0:
                sym[i] = _CLASS[_class_of(i)]
        self.sym = sym
        counts = np.zeros((self.size, self.size))
        of = np.array([(a, b, n) for (a, b), n in pairs.items() if b >= 0], np.int64).reshape(-1, 3)
        np.add.at(counts, (sym[of[:, 0]], sym[of[:, 1]]), of[:, 2])
        n = counts.sum(0)
        self.share = (n + 0.3) / (n + 0.3).sum()  # of each symbol
        self.adjust = np.zeros(LIMIT + 1, np.float32)
        one = np.empty(self.size)
        for k, (name, floor) in enumerate(_CLASSES):
            one[k] = np.exp(floor)
        one[base:] = np.maximum(n[base:], 0.3) / n.sum()
        kana = [k for c, k in self.letters.items() if 0x3041 <= ord(c) <= 0x30FF]
        one[kana] = np.maximum(one[kana], np.exp(-6.5))  # names may use any
        size_of = np.ones(self.size)
        size_of[_CLASS["han"]] = 2500  # characters that share the symbol's count
        size_of[_CLASS["han2"]] = 3000
        total = counts.sum(1, keepdims=True)
        back = 25.0
        joint = (counts / size_of + back * one) / (total + back)
        start = self.letters.get(" ", _CLASS["punct"])
        joint[start] = 0.5 * joint[start] + 0.5 * one  # names begin with what sentences don't
        self.table = np.log(joint).astype(np.float32)

    def with_corpus(self, seen: dict[str, int]) -> None:
        """Tell Han apart by how often the corpus has them; the training text knows them as classes only.

        ``seen``: occurrences outside of garbled runs.  Their square roots are
        compared within each class, so that common sentences don't drown all else;
        a fifth stays with the class.
        """
        members: dict[int, list[int]] = {}
        for c in range(0x3400, 0xA000):
            members.setdefault(int(self.sym[c]), []).append(c)
        for name in ("han", "han2", "rare_han"):
            own = members.get(_CLASS[name], [])
            often = np.sqrt(np.array([seen.get(chr(c), 0) for c in own], float))
            if often.sum():
                self.adjust[own] = np.minimum(np.log(0.2 + 0.8 * often / often.sum() * len(own)), MOST_FAMILIAR)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text, and of its least likely pair."""
        joined = " " + " ".join(texts) + " "
        raw = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), LIMIT)
        s = self.sym[raw]
        pair = self.table[s[:-1], s[1:]]
        pair = pair + _case(raw) + self.adjust[raw[1:]]
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts = np.concatenate(([0], ends[:-1]))
        return np.add.reduceat(pair, starts), np.minimum.reduceat(pair, starts)


_UPPER = np.array([unicodedata.category(chr(i)) == "Lu" for i in range(0x530)] + [False])
_LOWER = np.array([unicodedata.category(chr(i)) == "Ll" for i in range(0x530)] + [False])


def _case(raw: np.ndarray) -> np.ndarray:
    """The cost of case: a capital after a small letter, twice that if it isn't ASCII."""
    r = np.minimum(raw, 0x530)
    up, low = _UPPER[r], _LOWER[r]
    jump = low[:-1] & up[1:]
    return np.where(jump, np.where(raw[1:] < 0x80, -2.0, -5.0), np.where(up[1:], -0.7, 0)).astype(np.float32)


# --- runs --------------------------------------------------------------------

_RUN = re.compile(r"[^\t\n\r ]*[^\x00-\x7f][^\t\n\r ]*")
_LETTER = re.compile(r"[^\W\d_]")
#: A confident run gains this much (nats); it counts towards its source's share.
SURE = 15.0
#: What a run must gain beyond the log odds of its source.
MARGIN = 3.0
#: What a reading by one-byte pages costs where at most three letters beyond ASCII are all there is: lists of letters (ÄÖÜ) read as many things.
SHORT = 6.0
#: What a reading gains for being the usual one of its record.
USUAL = 4.0
#: Most the pairs of a restored run may cost, by kind of writing.
READABLE = {"latin": -8.0, "letters": -5.6, "signs": -10.6, "utf-8": -12.0}
_UNUSUAL = re.compile(
    r"[a-zß-öø-ÿа-яё][À-ÖØ-ÞА-ЯЁ]|[À-ÖØ-ÞА-ЯЁ]{2}[a-zß-öø-ÿа-яё]|[^\x00-\x7fÀ-ÖØ-öø-ÿА-яЁё]"
)
_SEAM = re.compile(r"(?<=[A-Za-z])[Ͱ-ԯ]|[Ͱ-ԯ](?=[A-Za-z])|(?<=[Ͱ-ԯ])[À-ɏ]|[À-ɏ](?=[Ͱ-ԯ])")
_MIXED = re.compile(r"[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]")
#: Han or kana beside a small Latin letter, or one by itself.
_EAST = "ぁ-ヿ㐀-鿿"
_BESIDE = re.compile(rf"[a-z][{_EAST}]|[{_EAST}][a-z]|(?<![{_EAST}0-9])[{_EAST}](?![{_EAST}0-9])")
#: Runs whose readings a task remembers; texts repeat one another.
REMEMBERED = 50_000
#: Han that are Cyrillic letters in UTF-8, read in an East Asian page: a bit a page.
_CYRILLIC = np.zeros(LIMIT + 1, np.uint8)
for _bit, _page in enumerate(sorted(cp.WIDE - {"utf-8"})):
    for _letter in (chr(i) for i in range(0x410, 0x450)):
        _shown = cp.decode(_letter.encode(), _page)
        if _shown and len(_shown) == 1:
            _CYRILLIC[ord(_shown)] |= 1 << _bit
_TWICE = ("cp1252", "cp850", "cp437", "mac-roman")


#: First bytes of punctuation in UTF-8, read in a Western page, whose others were dropped as control characters.
_STRIPPED = re.compile(r"â[\x80-\xbf€]?(?![\x80-\xbf€])")
#: Signs between Han or kana, Latin letters beyond ASCII among them; what stands between marks of a sentence.
_FOREIGN_STRETCH = re.compile(r"[!-~]*[\x80-\u2e7f\ue000-\uf8ff\ufb00-\ufb06][!-\u2e7f\ue000-\uf8ff\ufb00-\ufb06]*")
_CLAUSE = re.compile(r"[^。，、；：！？「」『』（）!-~]+")
#: One of these that can't be a letter of its word.
_NO_LETTER = re.compile(r"â(?:[\x80-\xbf€]|(?!\w))")
#: The name of pages nobody knows.
UNKNOWN = "unknown"


@dataclass
class Candidate:
    text: str  # what is rated
    read: str
    written: str
    cost: float = 0.0
    shown: str | None = None  # what is put in its place, with what is lost marked; else the text
    plain: bool = False  # by the source's table alone


class Reader:
    """Finds garbled runs and reads them again.

    ``shares``: log share of each source among all swaps seen; ``tables``: the
    learned table of each pair of pages, letters by sign; ``broken``: that of each
    source of rows that no pages explain.
    """

    def __init__(self, language: Language, shares: dict[tuple[str, str], float] | None = None, tables: dict[tuple[str, str], dict[str, str]] | None = None, broken: dict[str, dict[str, str]] | None = None):
        self.language = language
        self.shares = shares
        self.tables = tables or {}
        self.one_byte = {k: str.maketrans(t) for k, t in self.tables.items() if k[1] != "utf-8"}
        self.broken = {k: str.maketrans(t) for k, t in (broken or {}).items()}
        self.known: dict = {}
        self.changed: dict = {}  # signs whose letter isn't the page's, by source
        known = {k: _CLASS[k] for k in _CLASS}
        cjk = np.zeros(language.size, bool)
        cjk[[known["han"], known["han2"], known["wide"]]] = True
        for c, k in language.letters.items():
            cjk[k] |= 0x3000 <= ord(c) <= 0x30FF or 0xFF00 <= ord(c) <= 0xFF60
        quiet = cjk.copy()
        quiet[[known["punct"], known["digit"]]] = True
        for c, k in language.letters.items():
            quiet[k] |= ord(c) < 0x80
        odd = language.table < SUSPECT
        unknown = [known[k] for k in ("letter", "sign", "half_kana", "drawing", "control", "lost", "other", "quote")]
        odd[unknown] = True
        odd[np.ix_(quiet, quiet)] = False
        # Latin letters with accents, read in an East Asian page, are common Han or kana inside a word
        latin = [k for c, k in language.letters.items() if "a" <= c <= "z"]
        odd[np.ix_(latin, np.flatnonzero(cjk))] = odd[np.ix_(np.flatnonzero(cjk), latin)] = True
        space = language.letters.get(" ", known["punct"])
        plain = np.ones(language.size, bool)
        plain[[known[k] for k in ("rare_han", "sign", "half_kana", "drawing", "control", "lost", "other")]] = False
        odd[space, plain] = odd[plain, space] = False
        self.odd = odd
        self.cjk = cjk
        # Han the corpus hardly has but in garbled runs may be garbled, common as they are elsewhere
        self.unfamiliar = language.adjust < UNFAMILIAR
        self.strange = np.isin(language.sym, [known["rare_han"], known["half_kana"]]) | self.unfamiliar

    def suspects(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """``(text, start, end)`` of the runs no clean text would be expected to have."""
        at = [k for k, t in enumerate(texts) if t and not t.isascii()]
        out: list[tuple[int, int, int]] = []
        if not at:
            return out
        joined = " " + " ".join(texts[k] for k in at) + " "
        raw = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), LIMIT)
        s = self.language.sym[raw]
        odd = self.odd[s[:-1], s[1:]] | (_case(raw) < -3)
        wide, cyrillic = self.cjk[s], _CYRILLIC[raw]
        odd[1:] |= wide[1:-1] & ~wide[:-2] & ~wide[2:]  # one by itself may be a letter
        odd |= (cyrillic[:-1] & cyrillic[1:]) > 0
        odd |= self.unfamiliar[raw[1:]]
        seen = np.concatenate(([0], np.cumsum(odd)))
        start = 1
        for k in at:
            text = texts[k]
            if seen[start + len(text)] > seen[start - 1]:
                for m in _RUN.finditer(text):
                    if seen[start + m.end()] > seen[start + m.start() - 1]:
                        out.append((k, m.start(), m.end()))
            start += len(text) + 1
        return out

    def _candidates(self, run: str, source: str = "") -> list[Candidate]:
        out: list[Candidate] = []
        if source in self.broken:
            new = run.translate(self.broken[source])
            return [Candidate(new, UNKNOWN, source, plain=True)] if new != run else []
        points = [min(ord(c), LIMIT) for c in run]
        strange = _BESIDE.search(run) is not None or any(self.strange[p] for p in points) or any(_CYRILLIC[p] & _CYRILLIC[q] for p, q in zip(points, points[1:]))
        letters = _LETTER.search(run) is not None
        short = len(_LETTER.findall(run)) <= 3 and not re.search("[A-Za-z]", run)
        word = _UNUSUAL.search(run) is None
        controls = any("\x80" <= c <= "\x9f" for c in run)
        for read in cp.READ_IN:
            if read in cp.WIDE and not strange:
                continue
            data = cp.encode(run, read)
            if data is None:
                continue
            for written in cp.WRITTEN_IN:
                if written == read:
                    continue
                if read not in cp.WIDE and written != "utf-8" and not letters and not controls:
                    continue  # a frame or a sign by itself is no word
                if read not in cp.WIDE and written in cp.WIDE and written != "utf-8" and word:
                    continue  # letters in a usual order of case pair up by chance
                table = self.one_byte.get((read, written))
                new = run.translate(table) if table else cp.reread(run, read, written, data, self.tables.get((read, written)))
                if new and new != run:
                    out.append(Candidate(new, read, written, SHORT if short and written not in cp.WIDE else 0.0, plain=True))
                    if written == "utf-8" and not new.isascii():  # encoded twice, or three times
                        for cost in (2.0, 4.0):
                            again = next((x for x in (cp.reread(new, w, "utf-8") for w in _TWICE) if x), None)
                            if again is None:
                                break
                            out.append(Candidate(again, read, written, cost))
                            new = again
                elif new is None and written == "utf-8" and read in cp.WIDE:  # bytes are missing here and there
                    loose = data.decode("utf-8", "replace")
                    bad = loose.count("�")
                    kept = loose.replace("�", "")
                    if 0 < bad <= sum(c > "\x7f" for c in kept):  # at least as many sequences were whole
                        out.append(Candidate(kept, read, written, 6.0 * bad, loose))
                elif new is None and written == "utf-8" and read == "cp1252" and _NO_LETTER.search(run):
                    marked, bad = _STRIPPED.subn("�", run)
                    if bad:
                        out.append(Candidate(marked.replace("�", ""), read, written, 3.0 * bad, marked))
                elif new is None and written in cp.WIDE and read in cp.WIDE and len(data) > 3:
                    cut = cp.decode(data[1:], written)  # its first byte is lost
                    if cut and not cut.isascii():
                        out.append(Candidate(cut, read, written, 8.0, "�" + cut))
        return out

    def read(self, runs: list[str], sources: list[str] | None = None) -> list[tuple[Candidate, float] | None]:
        """The best reading of each run and what it gains, or None if the run stands."""
        return [options[0] if options else None for options in self.readings(runs, sources)]

    def readings(self, runs: list[str], sources: list[str] | None = None) -> list[list[tuple[Candidate, float]]]:
        """The readings of each run that gain something, the best first.

        The gain is in nats over the run itself, in the form it reads as.
        """
        sets = [self._candidates(r, s) if "�" not in r else [] for r, s in zip(runs, sources or [""] * len(runs))]
        flat = [c for s in sets for c in s]
        if not flat:
            return [[] for _ in runs]
        own = [canonical_text(r) for r in runs]
        as_is = np.maximum(self.language.scores(runs)[0], self.language.scores(own)[0]) - FOREIGN * np.array([_foreign(r) for r in own])
        texts = [c.text for c in flat]
        score = self.language.scores(texts)[0] - np.array([c.cost for c in flat])
        if self.shares is not None:
            score = score + np.array([0.0 if c.read == UNKNOWN else self.shares.get((c.read, c.written), UNSEEN) for c in flat])
        readable = self._readable(texts, [c.written for c in flat])
        out: list[list[tuple[Candidate, float]]] = []
        k = 0
        for n, s in enumerate(sets):
            gains = [(flat[i], float(score[i] - as_is[n])) for i in range(k, k + len(s)) if readable[i] and score[i] > as_is[n]]
            out.append(sorted(gains, key=lambda x: -x[1]))
            k += len(s)
        return out

    def read_runs(self, texts: list[str | None], runs: list[tuple[int, int, int]], sources: list[str]) -> list[tuple[int, int, int, list[tuple[Candidate, float]]]]:
        """``(text, start, end, readings)`` of the runs that have some; where a run has none, of its pieces.

        Chinese and Japanese don't part words: a garbled one stands in a run with
        clean ones, and only the piece by itself can be read again.
        """
        key = lambda k, a, b: (texts[k][a:b], sources[k] if sources[k] in self.broken else "")
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known

        def learn_of(runs) -> None:
            keys = list({key(*r) for r in runs} - known.keys())
            known.update(zip(keys, self.readings([r for r, _ in keys], [o for _, o in keys])))

        learn_of(runs)
        out, again = [], []
        for k, a, b in runs:
            options = known[key(k, a, b)]
            if options:
                out.append((k, a, b, options))
            else:
                again += [(k, a + x, a + y) for x, y in self._pieces(texts[k][a:b])]
        learn_of(again)
        return sorted(out + [(*r, known[key(*r)]) for r in again if known[key(*r)]], key=lambda r: r[:3])

    def _pieces(self, run: str) -> list[tuple[int, int]]:
        """Stretches of a run of Han or kana that may be garbled though the others aren't."""
        if not _WIDE.search(run):
            return []
        out = [m.span() for m in _FOREIGN_STRETCH.finditer(run) if len(m[0]) > 1]
        for m in _CLAUSE.finditer(run):
            if m[0] != run and any(self.strange[min(ord(c), LIMIT)] for c in m[0]):
                out.append(m.span())
        return [x for x in out if x != (0, len(run))]

    def _readable(self, texts: list[str], written: list[str]) -> list[bool]:
        """Whether what was restored could be a language.

        Whole UTF-8 sequences are evidence by themselves, single accented letters
        in Latin words are judged leniently; Cyrillic words have to look like some.
        """
        lang = self.language
        joined = " " + " ".join(texts) + " "
        full = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = np.minimum(full, LIMIT)
        s = lang.sym[raw]
        pair = np.maximum(lang.table[s[:-1], s[1:]] + _case(raw), -20)
        touched = (raw[:-1] > 0x7F) | (raw[1:] > 0x7F)
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
        cost = np.add.reduceat(np.where(touched, pair, 0), starts) / np.maximum(1, np.add.reduceat(touched, starts))
        wide = np.add.reduceat(raw[:-1] >= 0x2E80, starts)
        cyrillic = np.add.reduceat((raw[:-1] >= 0x370) & (raw[:-1] < 0x530), starts)
        void = np.add.reduceat(_VOID[np.minimum(full[:-1], LIMIT)], starts)
        exotic = np.add.reduceat((raw[:-1] >= 0x530) & (raw[:-1] < 0x1E00), starts)
        out = []
        for t, c, w, y, v, page in zip(texts, cost, wide, cyrillic, void + (exotic > 0) * (exotic < 3), written):
            kind = "utf-8" if page == "utf-8" else "signs" if w else "letters" if y else "latin"
            out.append(bool(c >= READABLE[kind]) and not v and not (y and _MIXED.search(t)))
        return out


#: Code points no restored text has: unassigned, private, surrogates, rare planes,
#: accents and modifiers by themselves.
_VOID = np.array(
    [unicodedata.category(chr(i)) in ("Cn", "Co", "Cs", "Mn", "Sk") and i > 0x2AF or 0x2B0 <= i < 0x300 for i in range(0x20000)] + [True] * (LIMIT + 1 - 0x20000)
)

#: Log share of a source without a confident run.
UNSEEN = -9.0


# --- learning ----------------------------------------------------------------

#: Signs a source of rows needs before its cipher is tried, and the share of its letters beyond ASCII that no page explains.
BLIND_SIGNS, BLIND_SHARE = 400, 0.25


def _digest(run: str) -> bytes:
    return blake2b(run.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def _letter(ch: str, language: Language) -> bool:
    return len(ch) == 1 and "\x7f" < ch < "⺀" and ch.isalpha() and ch.lower() in language.letters


def _own(read: str, written: str) -> dict[str, str]:
    """What the signs of a one-byte pair of pages stand for by rule."""
    return {c: t for c, b in cp.to_byte(read).items() if b >= 0x80 and (t := cp.from_byte(written)[b]) is not None}


def symbols(run: str, read: str, written: str, language: Language) -> list[str]:
    """A run as the symbols of its cipher: signs that stand for letters, else what they are."""
    low = lambda c: c.lower() if c < "\x80" else c
    if written != "utf-8":
        own = _own(read, written)
        return [c if _letter(own.get(c, ""), language) else low(own.get(c, c)) for c in run]
    return [sign if _letter(ch, language) else low(ch) for sign, ch in cp.sequences(run, read)]


def _bound(syms: list[str]) -> Iterator[tuple[str, str]]:
    syms = [" ", *syms, " "]
    return zip(syms, syms[1:])


_COUNTED = "kind string, source string, a string, b string, half int, n bigint"


def _gather(shared) -> callable:
    """Pass 1: sources of the sure runs and their sign pairs; pairs of runs no page explains; Han outside of sure runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language: Language = shared.value
        reader = Reader(language)
        han = np.zeros(LIMIT + 1, np.int64)
        counts: Counter[tuple[str, str, str, str, int]] = Counter()
        for batch in batches:
            texts, origins = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, j in slices(texts):
                part = texts[i:j]
                raw = np.minimum(np.frombuffer("".join(t or "" for t in part).encode("utf-32-le", "surrogatepass"), np.uint32), LIMIT)
                han += np.bincount(raw, minlength=LIMIT + 1)
                for t, o in zip(part, origins[i:j]):
                    if t and not t.isascii():
                        counts["letters", o or "", "", "", 0] += len(_BEYOND.findall(t))
                found = reader.suspects(part)
                read = reader.read_runs(part, found, [""] * len(part))
                done = {(k, a, b) for k, a, b, _ in read}
                for (name, origin), n in Counter((part[k][a:b], origins[i + k] or "") for k, a, b in found if (k, a, b) not in done).items():
                    if "�" not in name and not _WIDE.search(name) and _BEYOND.search(name):
                        for a, b in _bound([c.lower() if c < "\x80" else c for c in name]):
                            counts["blind", origin, a, b, _digest(name)[0] & 1] += n
                hits = {part[k][a:b]: options[0] for k, a, b, options in read}
                for name, n in Counter(part[k][a:b] for k, a, b, _ in read).items():
                    (best, gain), digest = hits[name], _digest(name)
                    half = digest[0] & 1
                    if gain < SURE:
                        continue
                    for c in name:
                        if "\u3400" <= c <= "\u9fff":
                            han[ord(c)] -= n
                    source = f"{best.read}>{best.written}"
                    counts["run", source, digest.hex(), "", 0] = 1
                    if best.plain and best.read not in cp.WIDE and (best.written not in cp.WIDE or best.written == "utf-8"):
                        for a, b in _bound(symbols(name, best.read, best.written, language)):
                            counts["pair", source, a, b, half] += n
        for c in np.flatnonzero(han[0x3400:0xA000]) + 0x3400:
            counts["han", "", chr(c), "", 0] = int(han[c])
        keys = list(counts)
        cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(4)]
        cols += [pa.array([k[4] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["kind", "source", "a", "b", "half", "n"])

    return run


#: Letters beyond ASCII that an unknown page may show; characters of East Asian pages.
_BEYOND = re.compile(r"[\x80-\u2fff]")
_WIDE = re.compile(r"[\u3000-\ud7ff\uf900-\ufaff\uff00-\uffee]")


def _halves(rows: list) -> tuple[dict, dict]:
    out: tuple[dict, dict] = ({}, {})
    for r in rows:
        out[r.half][r.a, r.b] = out[r.half].get((r.a, r.b), 0) + r.n
    return out


def _break_open(shared) -> callable:
    """The table of one source from its pairs, one row a sign; none if it can't be opened."""
    import pandas as pd

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        language: Language = shared.value
        halves = _halves(list(pairs.itertuples(index=False)))
        known = {s for p in (*halves[0], *halves[1]) for s in p if s < "\x80"}
        cipher = ciphers.break_open(halves, known, alphabets(language), language)
        table = cipher.table if cipher is not None else {}
        return pd.DataFrame({"source": [pairs["source"].iloc[0]] * len(table), "sign": list(table), "letter": list(table.values())}, dtype="object")

    return run


def learn(rows: DataFrame, samples: DataFrame) -> Reader:
    """A reader fitted to the garbled runs of ``rows`` (src_field, rec_id, text, maybe source).

    ``samples`` (text) is clean text; all of its rows give the bigrams.  Shares,
    tables and the familiarity of Han cover all of ``rows``.  ``source`` says where a row comes from (a folder, a
    device); without it all rows are one source.
    """
    pairs_of = samples.where(F.length("text") > 0).select("text").mapInArrow(_count_pairs, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    of = pairs_of.toArrow()  # at most the square of the letters that occur
    language = Language(Counter(dict(zip(zip(of["a"].to_pylist(), of["b"].to_pylist()), of["n"].to_pylist()))))
    shared = rows.sparkSession.sparkContext.broadcast(language)
    counted = _with_source(rows).mapInArrow(_gather(shared), _COUNTED)
    # a run that occurs often supports its source once; pairs keep their counts
    n = F.when(F.col("kind") == "run", F.max("n")).otherwise(F.sum("n"))
    counted = materialize(counted.groupBy("kind", "source", "a", "b", "half").agg(n.alias("n")), "counted")

    support = {tuple(r.source.split(">")): r.n for r in counted.where("kind = 'run'").groupBy("source").agg(F.sum("n").alias("n")).collect()}
    total = sum(support.values()) + 1
    # one more run each: new sources shouldn't push a rare one below its margin
    shares = {k: max(UNSEEN, SHARE_WEIGHT * float(np.log((n + 1) / total))) for k, n in support.items()}
    pairs: dict[tuple[str, ...], list] = {}
    for r in counted.where("kind = 'pair'").toLocalIterator():  # at most the square of a page's signs for each pair of pages
        pairs.setdefault(tuple(r.source.split(">")), []).append(r)
    tables, changed = {}, {}
    for (read, written), part in pairs.items():
        tables[read, written], changed[read, written] = _page_table(_halves(part), read, written, language)

    # sources of rows that are garbled throughout: few, as clean ones don't pass
    letters = F.sum(F.when(F.col("kind") == "letters", F.col("n")))
    unread = F.sum(F.when((F.col("kind") == "blind") & (F.ascii("b") > 127), F.col("n")))
    bad = counted.where("kind in ('letters', 'blind')").groupBy("source").agg(letters.alias("letters"), unread.alias("unread"))
    bad = bad.where((F.col("unread") >= BLIND_SIGNS) & (F.col("unread") >= BLIND_SHARE * F.col("letters"))).select("source")
    opened = counted.where("kind = 'blind'").join(F.broadcast(bad), "source").groupBy("source").applyInPandas(_break_open(shared), "source string, sign string, letter string")
    broken: dict[str, dict[str, str]] = {}
    for r in opened.toLocalIterator():  # an entry a sign of each source that was opened
        broken.setdefault(r.source, {})[r.sign] = r.letter

    seen = {r.a: r.n for r in counted.where("kind = 'han'").collect()}  # one row a character at most
    language.with_corpus(seen)
    out = Reader(language, shares, tables, broken)
    out.changed = changed
    return out


#: How much the share of a source among the sure runs weighs for the others.
SHARE_WEIGHT = 0.7


def alphabets(language: Language) -> list[list[str]]:
    """What the signs of an unknown page may stand for: accented Latin, Cyrillic, Greek letters of the training text."""
    of = lambda low, high: sorted(c for c in language.letters if low <= ord(c) <= high and c.isalpha())
    return [a for a in (of(0xDF, 0x24F), of(0x430, 0x52F), of(0x370, 0x3FF)) if a]


def _page_table(halves: tuple[dict, dict], read: str, written: str, language: Language) -> tuple[dict[str, str], dict[str, str]]:
    """The letters of a pair of pages, by sign, and those that aren't the pages' own."""
    signs = {s for half in halves for p in half for s in p}
    if written == "utf-8":
        own = {}
        for s in signs:
            if len(s) > 1:
                own[s] = next(ch for _, ch in cp.sequences(s, read))
        everything = dict(own)
    else:
        everything = _own(read, written)
        own = {s: everything[s] for s in signs if _letter(everything.get(s, ""), language)}
    letters = sorted({t.lower() for t in own.values()} | {t.lower() for t in everything.values() if _letter(t, language)})
    found = ciphers.learn(halves, {s: t.lower() for s, t in own.items()}, signs - own.keys(), letters, language)
    cased = {s: t.upper() if own[s].isupper() else t for s, t in found.table.items() if s in own}
    return everything | {s: t for s, t in cased.items() if t.lower() != own[s].lower()}, found.changed


def _with_source(rows: DataFrame) -> DataFrame:
    source = F.coalesce(F.col("source"), F.lit("")) if "source" in rows.columns else F.lit("")
    return rows.select("src_field", F.col("rec_id").cast("bigint").alias("rec_id"), "text", source.alias("source"))


def _restore(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: Reader = shared.value
        for batch in batches:
            fields, ids, texts, origins = (batch.column(k).to_pylist() for k in range(4))
            out: list[tuple] = []
            for i, j in slices(texts):
                part, origin = texts[i:j], origins[i:j]
                found = [f for f in reader.suspects(part) if origin[f[0]] not in reader.broken]
                for k, t in enumerate(part):  # where all is garbled nothing looks odd any more
                    if t and origin[k] in reader.broken:
                        found += [(k, m.start(), m.end()) for m in _RUN.finditer(t)]
                lost = [k for k, t in enumerate(part) if t and "�" in t]
                by: dict[int, list] = {k: [] for k in lost}
                for k, a, b, options in reader.read_runs(part, found, origin):
                    by.setdefault(k, []).append((a, b, options))
                for k, spots in by.items():
                    gains: Counter[tuple[str, str]] = Counter()
                    for *_, options in spots:
                        gains[options[0][0].read, options[0][0].written] += options[0][1]
                    # what is sure of the record counts for each of its runs
                    usual = max(gains, key=gains.get) if len(spots) > 1 else None
                    spots = [(a, b, *max(options, key=lambda x: x[1] + (USUAL if (x[0].read, x[0].written) == usual else 0))) for a, b, options in spots]
                    gains = Counter()
                    for *_, c, gain in spots:
                        gains[c.read, c.written] += gain
                    sure = {s for s, g in gains.items() if g >= MARGIN}
                    spots = [x for x in spots if (x[2].read, x[2].written) in sure]
                    if not spots and "�" not in part[k]:
                        continue
                    pieces, at = [], 0
                    for a, b, c, _ in spots:
                        pieces += [part[k][at:a], c.text if c.shown is None else c.shown]
                        at = b
                    pieces.append(part[k][at:])
                    new = "".join(pieces)
                    names = sorted({"a page of its own" if c.read == UNKNOWN else f"{c.written} read as {c.read}" for _, _, c, _ in spots})
                    out.append((fields[i + k], ids[i + k], new, len(spots), new.count("�"), ", ".join(names)))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("src_field", pa.string()), ("rec_id", pa.int64()), ("restored", pa.string()), ("n_runs", pa.int32()), ("n_lost", pa.int32()), ("swaps", pa.string())])


def restored(rows: DataFrame, reader: Reader) -> DataFrame:
    """``(src_field, rec_id, restored, n_runs, n_lost, swaps)`` of the affected records.

    ``rows``: src_field, rec_id, text, maybe source.  ``n_runs`` runs were read
    again; ``n_lost`` replacement characters mark what nothing is left of, those
    the text came with and those of bytes that are missing.  Null ids and texts
    are left out; clean records don't appear.
    """
    shared = rows.sparkSession.sparkContext.broadcast(reader)
    ddl = "src_field string, rec_id bigint, restored string, n_runs int, n_lost int, swaps string"
    return _with_source(rows).where("rec_id is not null and text is not null").mapInArrow(_restore(shared), ddl)
