"""Evaluation passages inside training documents.

Rare n-gram seeds join documents to test items: of every run of tokens that must
be found, the n-gram that is rarest in the corpus is a seed, so no run escapes.
Around the seeds a document has in common with an item, Smith-Waterman alignment
scores the copy, edited or paraphrased as it may be, and the longest exact run
is measured.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import tokens as tk

SEED = 10  # tokens in a seed
MATCH, MISMATCH, GAP = 2, -1, -1
#: An evaluation set with more tokens than this is taken in blocks, each of which
#: is sent to all tasks and costs a pass over the corpus.
BLOCK_TOKENS = 1_000_000
_FILTER_BITS = 21


class Passages:
    """The distinct passages of a block of items and their n-grams."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], need: dict[str | None, int], default_need: int):
        kept = [(i, lang, p) for i, lang, p in items if i is not None and p]
        t = tk.tokenize([p for *_, p in kept])
        self.tokens: list[np.ndarray] = []
        self.items: list[list[int]] = []  # of each passage
        self.need: list[int] = []  # run length that counts as a leak
        known: dict[tuple[bytes, int], int] = {}
        for k, (item, lang, _) in enumerate(kept):
            h = t.hashes[t.starts[k] : t.starts[k + 1]]
            n = need.get(lang, default_need)
            if len(h) < n:
                continue
            at = known.setdefault((h.tobytes(), n), len(self.tokens))
            if at == len(self.tokens):
                self.tokens.append(h)
                self.items.append([])
                self.need.append(n)
            self.items[at].append(item)
        all_grams = [self._grams(h) for h in self.tokens]
        self.grams = np.unique(np.concatenate(all_grams)) if all_grams else np.empty(0, np.uint64)
        self.where = all_grams

    @staticmethod
    def _grams(h: np.ndarray) -> np.ndarray:
        return tk.ngrams(tk.Tokens(h, np.array([0, len(h)])), SEED)[0]

    def seeds(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted ``(seed, passage, position)``: in each window of a needed run, the rarest gram the corpus has."""
        out = []
        for k, grams in enumerate(self.where):
            seen = counts[np.searchsorted(self.grams, grams)]
            width = self.need[k] - SEED + 1
            chosen = set()
            for i in range(len(grams) - width + 1):
                window = range(i, i + width)
                # what the corpus lacks can't meet anything; of equally rare grams the one
                # chosen before, then the last: fewer seeds
                best = min(window, key=lambda j: (seen[j] == 0, seen[j], j not in chosen, -j))
                if seen[best]:
                    chosen.add(best)
            out += [(grams[j], k, j) for j in sorted(chosen)]
        out.sort()
        g = np.array([x[0] for x in out], np.uint64)
        return g, np.array([x[1] for x in out], np.int64), np.array([x[2] for x in out], np.int64)


def _filter(grams: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[(grams & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
    return bits


def _member(found: np.ndarray, grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indices into ``found`` of the n-grams that are among the sorted ``grams``."""
    maybe = np.flatnonzero(bits[(found & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
    at = np.searchsorted(grams, found[maybe])
    at[at == len(grams)] = 0
    return maybe[grams[at] == found[maybe]]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two token sequences, and their longest exact run."""
    return align_many([(a, b)])[0]


def align_many(pairs: list[tuple[np.ndarray, np.ndarray]], block: int = 64) -> list[tuple[int, int]]:
    """``align`` of many pairs, those of like length side by side.

    One row of all tables at a time; gaps along a row are a running maximum.
    Shorter sequences are filled up with tokens that match nothing.
    """
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    for i in range(0, len(order), block):
        part = order[i : i + block]
        n = max(len(pairs[k][1]) for k in part)
        m = max(len(pairs[k][0]) for k in part)
        if not n or not m:
            continue
        a, used_a = np.zeros((m, len(part)), np.uint64), np.zeros((m, len(part)), bool)
        b, used_b = np.zeros((len(part), n), np.uint64), np.zeros((len(part), n), bool)
        for j, k in enumerate(part):
            used_a[: len(pairs[k][0]), j] = True
            used_b[j, : len(pairs[k][1])] = True
            a[: len(pairs[k][0]), j] = pairs[k][0]
            b[j, : len(pairs[k][1])] = pairs[k][1]
        slope = np.arange(1, n + 1, dtype=np.int32) * -GAP
        row, run = np.zeros((len(part), n + 1), np.int32), np.zeros((len(part), n + 1), np.int32)
        top, longest, step = (np.zeros((len(part), n), np.int32) for _ in range(3))
        for tokens, used in zip(a, used_a):
            same = b == tokens[:, None]
            same &= used_b
            same &= used[:, None]
            np.multiply(same, MATCH - MISMATCH, out=step)
            step += MISMATCH
            step += row[:, :-1]
            np.maximum(step, row[:, 1:] + GAP, out=step)
            np.maximum(step, 0, out=step)
            step += slope
            np.maximum.accumulate(step, axis=1, out=step)
            step -= slope
            row[:, 1:] = step
            np.maximum(top, step, out=top)
            run[:, 1:] = (run[:, :-1] + 1) * same
            np.maximum(longest, run[:, 1:], out=longest)
        for k, x, y in zip(part, top.max(1), longest.max(1)):
            out[k] = (int(x), int(y))
    return out


def _texts(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def _count(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        bits = _filter(grams)
        total = np.zeros(len(grams), np.int64)
        for batch in batches:
            texts = _texts(batch, "text")
            for i, j in tk.slices(texts):
                g, *_ = tk.ngrams(tk.tokenize(texts[i:j]), SEED)
                hit = _member(g, grams, bits)
                np.add.at(total, np.searchsorted(grams, g[hit]), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(grams[some].view(np.int64)), "n": pa.array(total[some])})

    return run


def _windows(begin: np.ndarray, length: int, size: int) -> list[tuple[int, int]]:
    """Stretches of a document that an item may cover, if it began at ``begin``.

    A quarter of the item is left on each side for insertions.
    """
    slack = max(8, length // 4)
    out: list[list[int]] = []
    for p in np.unique(begin):
        lo, hi = max(0, int(p) - slack), min(size, int(p) + length + slack)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _match(shared, id_col: str) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, owner, place, passages, items, need = shared.value
        once = np.unique(grams)
        bits = _filter(once)
        for batch in batches:
            ids, texts = _texts(batch, id_col), _texts(batch, "text")
            out: dict[str, list] = {"doc_id": [], "item_id": [], "score": [], "share": [], "run": [], "needed": []}
            for i, j in tk.slices(texts):
                t = tk.tokenize(texts[i:j])
                g, pos, doc = tk.ngrams(t, SEED)
                hit = _member(g, once, bits)
                lo, hi = np.searchsorted(grams, g[hit]), np.searchsorted(grams, g[hit], side="right")
                if not len(hit):
                    continue
                index = np.repeat(hit, hi - lo)
                offset = np.arange(len(index)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
                seed = np.repeat(lo, hi - lo) + offset
                who = owner[seed]
                pair = doc[index] * len(passages) + who
                order = np.argsort(pair, kind="stable")
                cuts = np.flatnonzero(np.diff(pair[order])) + 1
                wanted: dict[tuple[bytes, int], int] = {}  # copies within a slice are aligned once
                tasks: list[tuple[np.ndarray, np.ndarray]] = []
                found: list[tuple[int, int, list[int]]] = []
                for part in np.split(order, cuts):
                    d, p = divmod(int(pair[part[0]]), len(passages))
                    if ids[i + d] is None:
                        continue
                    first = t.starts[d]
                    size = int(t.starts[d + 1] - first)
                    own = []
                    for a, b in _windows(pos[index[part]] - first - place[seed[part]], len(passages[p]), size):
                        piece = t.hashes[first + a : first + b]
                        key = (piece.tobytes(), p)
                        if key not in wanted:
                            wanted[key] = len(tasks)
                            tasks.append((passages[p], piece))
                        own.append(wanted[key])
                    found.append((d, p, own))
                scores = align_many(tasks)
                for d, p, own in found:
                    best, longest = (max(scores[k][n] for k in own) for n in (0, 1))
                    for item in items[p]:
                        for k, v in zip(out, (ids[i + d], item, best, best / (MATCH * len(passages[p])), longest, need[p])):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int32()), ("score", pa.int32()), ("share", pa.float64()), ("run", pa.int32()), ("needed", pa.int32())])
_DDL = "doc_id bigint, item_id int, score int, share double, run int, needed int"


def leaks(documents: DataFrame, items: DataFrame, need: dict[str, int] | None = None, default_need: int = 20, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, item_id, score, share, run, needed)`` of documents that share seeds with items.

    ``share`` is the alignment score over that of the whole passage, ``run`` the
    longest exact run of tokens, ``needed`` the run that counts as a leak for
    the item's language (``need``, else ``default_need``; at least ``SEED``).
    Null ids, texts and passages are left out; a passage shorter than the run it
    needs can't leak.  An evaluation set above ``BLOCK_TOKENS`` is taken in
    blocks by a hash of its ids; repeated items give repeated rows once.
    """
    need = {"zh": 40, "ja": 40} if need is None else need
    if min([default_need, *need.values()]) < SEED:
        raise ValueError(f"a run needs at least {SEED} tokens")
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    items = items.select("item_id", "lang", "passage").where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).distinct()
    size = items.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]  # characters: at least as many as tokens
    blocks = max(1, -(-int(size) // BLOCK_TOKENS))
    found = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == k)
        passages = Passages([(r.item_id, r.lang, r.passage) for r in block.toLocalIterator()], need, default_need)
        if not passages.tokens:
            part = spark.createDataFrame([], _DDL)
        else:
            shared = spark.sparkContext.broadcast(passages.grams)
            counted = docs.select("text").mapInArrow(_count(shared), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
            counts = np.zeros(len(passages.grams), np.int64)
            for r in counted.toLocalIterator():  # no more rows than the block has n-grams
                counts[np.searchsorted(passages.grams, np.uint64(r.gram % (1 << 64)))] = r.n
            seeds, owner, place = passages.seeds(counts)
            sent = spark.sparkContext.broadcast((seeds, owner, place, passages.tokens, passages.items, passages.need))
            part = docs.mapInArrow(_match(sent, "doc_id"), _DDL)
        found = part if found is None else found.unionByName(part)
    return found


def leaked(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``(doc_id, item_id)`` whose longest exact run reaches the needed length."""
    return leaks(documents, items, **options).where("run >= needed").select("doc_id", "item_id").distinct()
