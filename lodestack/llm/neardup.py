"""Near-duplicate texts: small edits, insertions, another order.

Similarity is the Jaccard coefficient of the sets of n consecutive tokens.  Each
distinct set is one class; a class has a signature of ``COORDS`` min-hashes, and
two classes agree in each coordinate with the probability of their similarity.

The join is inverted: classes are posted under coordinate-value pairs.  A pair
that agrees in ``AGREE`` coordinates must meet in one of the ``COORDS - AGREE +
1`` rarest of either, so only this prefix is posted; the remaining, longer lists
are skipped and their collisions counted on the packed signatures that travel
with a posting.  What reaches the threshold is checked on the token sets.

A list longer than ``HOT`` comes from a template that many texts share, and its
pairs grow with its square though few are alike.  Such lists aren't joined.  The
classes that would have been posted there are joined exactly on their n-grams
instead: a pair that reaches the threshold has one of its rarest n-grams in
common (prefixes as long as size and threshold ask for), at a place that leaves
enough behind it.  A template's n-grams are common, so they lie beyond the prefix
unless the texts are alike by it.

What is joined is many times what is read: postings, prefixes, and a set of
n-grams for each candidate.  So the joins are done in passes, each over a part of
the keys; what a pass shuffles is gone before the next.  Candidates are first
rated by marks, a bit a n-gram hash: an n-gram whose bit the other text hasn't is
not shared, which leaves out most and never a pair that reaches the threshold.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm import tokens as tk
from lodestack.session import materialize, release

COORDS = 40
#: Of 40 coordinates a pair of similarity 0.6 agrees in 14 or more with a
#: probability of 0.999, one of 0.66 with 0.99998.
AGREE = 14
#: Lower thresholds ask for fewer, so that a pair at the threshold is met with
#: this probability.
MET = 0.999
#: Counters of the frequency sketch: a few for each posting, at least and at most so many (bits); one byte each.
SKETCH_BITS = (16, 24)
#: A posting list longer than this, beyond what its counter holds by chance, is joined exactly instead.
HOT = 2048
#: Rows of a class, or of a list of n-grams, one task compares with the others.
PART = 2048
#: Words of 64 bits that mark the n-grams of a set.
MARKS = 16
#: Postings or candidates one pass joins at least, sets of n-grams one part of them has at least.
PASS_ROWS, PASS_SETS = 1 << 22, 1 << 17
#: Passes over the postings, over the rarest n-grams (more if their lists are long), and parts of the sets, at most.
SLOT_PASSES, GRAM_PASSES, SET_PARTS = 4, 8, 4
#: Pairs on the lists of a pass for each of its rows; most of them fail by size or place.
PASS_PAIRS = 1024

_SEED = np.random.default_rng(20240607)
_A = _SEED.integers(0, 1 << 62, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 1 << 63, COORDS, dtype=np.uint64)


def agreement(threshold: float) -> int:
    """Coordinates a pair of that similarity agrees in with probability ``MET``, at most ``AGREE``."""
    tail = lambda least: sum(math.comb(COORDS, k) * threshold**k * (1 - threshold) ** (COORDS - k) for k in range(least, COORDS + 1))
    if not 0 < threshold <= 1 or tail(1) < MET:
        raise ValueError(f"{COORDS} coordinates can't find pairs of similarity {threshold}")
    return max(a for a in range(1, AGREE + 1) if tail(a) >= MET)


def shingle_sets(texts: list, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    out: list[np.ndarray] = []
    for i, j in tk.slices(texts):
        t = tk.tokenize(texts[i:j])
        g, _, owner = tk.ngrams(t, n)
        cut = np.searchsorted(owner, np.arange(j - i + 1))
        out += [np.unique(g[cut[k] : cut[k + 1]]) for k in range(j - i)]
    return out


_MARKS = [f"m{k}" for k in range(MARKS)]
_SIGNED = "row_id bigint, k1 bigint, k2 bigint, shingles boolean, sig binary, size int, " + ", ".join(f"{m} bigint" for m in _MARKS)


def _sign(n: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in tk.slices(texts):
                t = tk.tokenize(texts[i:j])
                g, _, owner = tk.ngrams(t, n)
                cut = np.searchsorted(owner, np.arange(j - i + 1))
                count = np.diff(t.starts)
                some = np.flatnonzero(count)  # texts with at least one token
                if not len(some):
                    continue
                sig = np.zeros((len(some), COORDS), np.uint32)
                long = np.flatnonzero(np.diff(cut)[some])
                if len(long):
                    for c in range(COORDS):
                        h = (tk.mix(g * _A[c] + _B[c]) >> np.uint64(32)).astype(np.uint32)
                        sig[long, c] = np.minimum.reduceat(h, cut[some[long]])
                key = np.empty((len(some), 2), np.uint64)
                size = np.zeros(len(some), np.int32)
                marks = np.zeros((len(some), MARKS * 64), np.uint8)
                for k, d in enumerate(some):
                    own = np.unique(g[cut[d] : cut[d + 1]])
                    size[k] = len(own)
                    marks[k, (tk.mix(own) % np.uint64(MARKS * 64)).astype(np.int64)] = 1
                    if not len(own):  # too short for an n-gram: only equal tokens are copies
                        own = np.concatenate(([np.uint64(1)], t.hashes[t.starts[d] : t.starts[d + 1]]))
                        own = own * np.arange(1, 2 * len(own), 2, dtype=np.uint64)
                    key[k, 0] = tk.mix(own).sum(dtype=np.uint64)
                    key[k, 1] = tk.mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(own))
                words = np.packbits(marks, axis=1).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row_id": pa.array([ids[i + d] for d in some], pa.int64()),
                        "k1": pa.array(key[:, 0].view(np.int64)),
                        "k2": pa.array(key[:, 1].view(np.int64)),
                        "shingles": pa.array(np.array([cut[d + 1] > cut[d] for d in some])),
                        "sig": pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDS * 4), len(some), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary()),
                        "size": pa.array(size),
                    }
                    | {m: pa.array(np.ascontiguousarray(words[:, k])) for k, m in enumerate(_MARKS)}
                )

    return run


def _slots(sig: np.ndarray) -> np.ndarray:
    """The posting key of every coordinate of every signature."""
    return tk.mix(sig.astype(np.uint64) * np.uint64(64) + np.arange(COORDS, dtype=np.uint64)[None, :])


def _signatures(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint32).reshape(-1, COORDS)


def sketch_bits(postings: int) -> int:
    return min(SKETCH_BITS[1], max(SKETCH_BITS[0], math.ceil(math.log2(max(postings, 1)))))


class Sketch:
    """How often hashes occur, about: one byte a counter, in eighths of a power of two."""

    def __init__(self, total: np.ndarray):
        self.bits = int(len(total)).bit_length() - 1
        self.level = np.rint(8 * np.log2(1 + total)).astype(np.uint8)
        self.usual = float(total.mean())

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return self.level[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)]

    @staticmethod
    def count(level: np.ndarray) -> np.ndarray:
        return np.exp2(level / 8) - 1


def _counted(rows: DataFrame, hashes, bits: int) -> Sketch:
    """The sketch of the hashes ``hashes(batch)`` gives; its size depends on ``bits`` only.

    A task gives its counters at the end, so there are no more tasks than cores.
    """
    spark = rows.sparkSession
    rows = rows.coalesce(max(1, spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount((hashes(batch) >> np.uint64(64 - bits)).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        for i in range(0, len(some), 1 << 16):
            yield pa.RecordBatch.from_pydict({"slot": pa.array(some[i : i + (1 << 16)]), "n": pa.array(total[some[i : i + (1 << 16)]])})

    total = np.zeros(1 << bits, np.int64)
    counted = materialize(rows.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")), "sketch")
    for b in counted.toArrow().to_batches():
        total[b.column(0).to_numpy()] = b.column(1).to_numpy()
    release(counted)
    return Sketch(total)


def _post(shared, agree: int, hot: float) -> callable:
    """Postings of the prefix; the list of a hot slot isn't kept, but who would have been on it is said (slot null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch: Sketch = shared.value
        prefix = COORDS - agree + 1
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            for i in range(0, len(ids), 2000):
                sig = _signatures(batch.slice(i, 2000), 1)
                slots = _slots(sig)
                seen = sketch.of(slots)
                # one order for all: estimated frequency, then the key itself
                order = np.lexsort((slots, seen), axis=1)[:, :prefix]
                packed = np.ascontiguousarray(sig.astype(np.uint8)).view(np.int64)
                often = Sketch.count(np.take_along_axis(seen, order, 1)) > hot
                keep = ~often
                keep[:, 0] |= often.any(1)  # one row says so
                templated = np.zeros_like(often)
                templated[:, 0] = often.any(1)
                slot = np.take_along_axis(slots, order, 1).view(np.int64)
                row = np.repeat(np.arange(len(sig)), prefix)[keep.ravel()]
                cols = {
                    "slot": pa.array(slot[keep], mask=often[keep]),
                    "templated": pa.array(templated[keep]),
                    "row_id": pa.array(ids[i : i + 2000][row]),
                }
                cols |= {f"s{k}": pa.array(packed[row, k]) for k in range(COORDS // 8)}
                yield pa.RecordBatch.from_pydict(cols)

    return run


def _lists(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column, whatever its slice."""
    col = batch.column(column)
    offsets = col.offsets.to_numpy()
    return col.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]


def prefix_lengths(size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rarest n-grams a set is looked up by, and those it is listed under for sets of its size and more."""
    most = np.ceil(threshold * size - 1e-9)
    listed = np.ceil(2 * threshold / (1 + threshold) * size - 1e-9)
    return (size - most + 1).astype(np.int64), (size - listed + 1).astype(np.int64)


def _rarest(shared, threshold: float) -> callable:
    """``(gram, row_id, size, place, listed)`` of the prefix of each set, in one order for all: rarity, then hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch: Sketch = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            grams, offsets = _lists(batch, 1)
            size = np.diff(offsets)
            owner = np.repeat(np.arange(len(ids)), size)
            seen = sketch.of(tk.mix(grams))
            order = np.lexsort((grams, seen, owner))
            place = np.arange(len(grams)) - offsets[owner]
            probe, listed = prefix_lengths(size, threshold)
            keep = place < probe[owner]
            yield pa.RecordBatch.from_pydict(
                {
                    "gram": pa.array(grams[order][keep].view(np.int64)),
                    "n": pa.array(np.minimum(Sketch.count(seen[order][keep]), 2**30).astype(np.int32)),
                    "row_id": pa.array(ids[owner[keep]]),
                    "size": pa.array(size[owner[keep]].astype(np.int32)),
                    "place": pa.array(place[keep].astype(np.int32)),
                    "listed": pa.array((place < listed[owner])[keep]),
                }
            )

    return run


def _dealt(a: DataFrame, b: DataFrame, n: Column, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """Two sides of a join with a column ``part`` more to meet in: long lists are spread over several tasks."""
    parts = F.greatest(F.ceil(n / part), F.lit(1)).cast("int")
    return a.withColumn("part", F.pmod(F.xxhash64("row_id"), parts).cast("int")), b.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))


def _passes(rows: int, most: int) -> int:
    return max(1, min(most, math.ceil(rows / PASS_ROWS)))


def _pass(column: str, k: int, passes: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(passes)) == k


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def exact_candidates(sets: DataFrame, threshold: float, total: int | None = None, rated: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(class_a, class_b)``: every pair of sets (row_id, grams) that may reach the threshold, by prefix, length and place.

    Pairs may come several times, if there are several passes.  ``total``: the n-grams of all sets, about;
    ``rated`` leaves pairs out, pass by pass.
    """
    spark = sets.sparkSession
    if total is None:
        total = sets.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    if not total:
        return spark.createDataFrame([], "class_a bigint, class_b bigint")
    sketch = _counted(sets.select("grams"), lambda b: tk.mix(_lists(b, 0)[0]), sketch_bits(total))
    shared = spark.sparkContext.broadcast(sketch)
    posts = sets.mapInArrow(_rarest(shared, threshold), "gram bigint, n int, row_id bigint, size int, place int, listed boolean")
    posts = materialize(posts, "rarest")
    smaller = (F.col("b.size") < F.col("a.size")) | (F.col("b.size") == F.col("a.size")) & (F.col("b.row_id") < F.col("a.row_id"))
    long_enough = F.col("b.size") >= F.lit(threshold) * F.col("a.size") - 1e-9
    left = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
    enough = left >= F.lit(threshold / (1 + threshold)) * (F.col("a.size") + F.col("b.size")) - 1e-6
    lists = posts.groupBy("gram").agg(F.count("*").alias("n"), F.count_if("listed").alias("m"))
    n_posts, n_pairs = lists.agg(F.sum("n"), F.sum(F.col("n") * F.col("m").cast("double"))).first()
    passes, met = _passes(n_posts, GRAM_PASSES), []
    passes = max(passes, math.ceil(n_pairs / PASS_PAIRS / max(n_posts / GRAM_PASSES, PASS_ROWS)))
    for k in range(passes):
        own = posts.where(_pass("gram", k, passes))
        a, b = (df.alias(x) for x, df in zip("ab", _dealt(own, own.where("listed"), F.col("n"))))
        pairs = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.part") == F.col("b.part")) & smaller & long_enough & enough)
        pairs = pairs.select(F.least("a.row_id", "b.row_id").alias("class_a"), F.greatest("a.row_id", "b.row_id").alias("class_b")).distinct()
        pairs = materialize(pairs, "exact")
        met.append(rated(pairs) if rated else pairs)
        if rated:
            release(pairs)
    release(posts)
    return _union(met)


def _agreeing() -> Column:
    """How many bytes of the packed signatures are equal."""
    ones = F.lit(0x0101010101010101)
    total = F.lit(0)
    for k in range(COORDS // 8):
        x = F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}"))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.lit(8) - F.bit_count(x.bitwiseAND(ones))
    return total


def _most_shared() -> Column:
    """At most so many n-grams two sets have in common, by their marks: a bit only one of them has stands for one it doesn't share, or more."""
    only = lambda x, y: sum((F.bit_count(F.col(f"{x}.{m}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{m}")))) for m in _MARKS), F.lit(0))
    return F.least(F.col("a.size") - only("a", "b"), F.col("b.size") - only("b", "a"))


def _sets(n: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), n)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_pydict({"row_id": batch.column(0), "grams": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})

    return run


class NearDuplicates:
    """``members`` (row_id, class_id) and ``links`` (class_a, class_b, similarity).

    A class are the rows with equal token sets, named after its smallest row_id;
    links join different classes whose similarity is at least ``threshold``.
    Null ids, null texts and texts without a letter or digit belong to no class;
    a text with fewer than n tokens is alike only to one with the same tokens.  A
    row_id that occurs twice with the same text counts once.  Lists longer than
    ``hot`` are joined exactly (see the module).
    """

    def __init__(self, rows: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "row_id", text_col: str = "text", hot: int = HOT):
        agree = agreement(threshold)
        spark = rows.sparkSession
        texts = rows.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("text"))
        texts = texts.where(F.col("row_id").isNotNull() & F.col("text").isNotNull())
        signed = materialize(texts.mapInArrow(_sign(n), _SIGNED), "signed")
        classes = signed.groupBy("k1", "k2", "shingles").agg(F.min("row_id").alias("class_id"))
        self.members = materialize(
            signed.select("row_id", "k1", "k2").join(classes.select("k1", "k2", "class_id"), ["k1", "k2"]).select("row_id", "class_id").distinct(), "members"
        )
        heads = signed.where("shingles").join(classes.where("shingles").select(F.col("class_id"), "k1", "k2"), ["k1", "k2"]).where("row_id = class_id")
        heads = materialize(heads.select("row_id", "sig", "size", *_MARKS).dropDuplicates(["row_id"]), "heads")
        release(signed)

        n_heads, n_grams = heads.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        bits = sketch_bits(n_heads * COORDS)
        sketch = _counted(heads.select("sig"), lambda b: _slots(_signatures(b, 0)).ravel(), bits)
        shared = spark.sparkContext.broadcast(sketch)
        packs = [f"s{k}" for k in range(COORDS // 8)]
        posts = heads.select("row_id", "sig").mapInArrow(
            _post(shared, agree, hot + 2 * sketch.usual), "slot bigint, templated boolean, row_id bigint, " + ", ".join(f"{p} bigint" for p in packs)
        )
        posts = materialize(posts, "posts")
        passes, met = _passes(posts.count(), SLOT_PASSES), []
        for k in range(passes):
            on_lists = posts.where("slot is not null").where(_pass("slot", k, passes))
            a, b = on_lists.alias("a"), on_lists.alias("b")
            pairs = a.join(b, (F.col("a.slot") == F.col("b.slot")) & (F.col("a.row_id") < F.col("b.row_id")) & (_agreeing() >= agree))
            met.append(materialize(pairs.select(F.col("a.row_id").alias("class_a"), F.col("b.row_id").alias("class_b")).distinct(), "met"))
        templated = materialize(posts.where("templated").select("row_id").distinct(), "ids")
        release(posts)
        rated = functools.partial(self._marked, heads=heads, n_heads=n_heads, threshold=threshold)
        found = [rated(_union(met))]
        release(*met)
        if not templated.isEmpty():
            own = materialize(texts.join(templated, "row_id", "left_semi").dropDuplicates(["row_id"]), "templated")
            found.append(exact_candidates(own.mapInArrow(_sets(n), "row_id bigint, grams array<bigint>"), threshold, n_grams, rated))
            release(own)
        self.candidates = materialize(_union(found).distinct(), "candidates")
        release(heads)
        self.links = self._linked(texts, n, threshold)

    @staticmethod
    def _marked(pairs: DataFrame, heads: DataFrame, n_heads: int, threshold: float) -> DataFrame:
        """The pairs that may reach the threshold by their sizes and marks, in passes of about as many pairs as there are classes."""
        passes, out = max(1, math.ceil(pairs.count() / max(n_heads, PASS_ROWS))), []
        marks = heads.select("row_id", "size", *_MARKS)
        enough = _most_shared() >= F.lit(threshold / (1 + threshold)) * (F.col("a.size") + F.col("b.size")) - 1e-6
        for k in range(passes):
            own = pairs.where(F.pmod(F.xxhash64("class_a", "class_b"), F.lit(passes)) == k)
            rated = own.join(marks.alias("a"), F.col("class_a") == F.col("a.row_id")).join(marks.alias("b"), F.col("class_b") == F.col("b.row_id"))
            out.append(materialize(rated.where(enough).select("class_a", "class_b"), "rated"))
        return _union(out)

    def _linked(self, texts: DataFrame, n: int, threshold: float) -> DataFrame:
        """The candidates whose sets reach the threshold; the sets lie in parts, and each part meets each."""
        wanted = materialize(self.candidates.select(F.explode(F.array("class_a", "class_b")).alias("row_id")).distinct(), "wanted")
        parts = max(1, min(SET_PARTS, math.ceil(wanted.count() / PASS_SETS)))
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
        sets = texts.join(wanted, "row_id", "left_semi").dropDuplicates(["row_id"]).mapInArrow(_sets(n), "row_id bigint, grams array<bigint>")
        sets = materialize(sets.withColumn("part", part("row_id")), "sets", by="part")
        both = F.size(F.array_intersect("grams_a", "grams_b"))
        out = []
        for i, j in itertools.product(range(parts), repeat=2):
            a = sets.where(F.col("part") == i).select(F.col("row_id").alias("class_a"), F.col("grams").alias("grams_a"))
            b = sets.where(F.col("part") == j).select(F.col("row_id").alias("class_b"), F.col("grams").alias("grams_b"))
            checked = (
                self.candidates.where((part("class_a") == i) & (part("class_b") == j))
                .join(a, "class_a")
                .join(b, "class_b")
                .withColumn("both", both)
                .withColumn("similarity", F.col("both") / (F.size("grams_a") + F.size("grams_b") - F.col("both")))
            )
            out.append(materialize(checked.where(F.col("similarity") >= threshold).select("class_a", "class_b", "similarity"), "links"))
        release(sets, wanted)
        return _union(out)

    def row_pairs(self) -> DataFrame:
        """``(row_a, row_b)``: all rows of one class, and of linked classes, in pairs.

        As many rows as the answer has; classes of copies stay together until here.
        """
        a = self.members.select(F.col("row_id").alias("ra"), F.col("class_id").alias("class_a"))
        b = self.members.select(F.col("row_id").alias("rb"), F.col("class_id").alias("class_b"))
        # a class of many copies is spread: each row of a part meets all rows
        sized = self.members.join(self.members.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1"), "class_id")
        one, all_ = (df.alias(k) for k, df in zip("xy", _dealt(sized, sized, F.col("n"))))
        same = one.join(all_, (F.col("x.class_id") == F.col("y.class_id")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.row_id") < F.col("y.row_id")))
        same = same.select(F.col("x.row_id").alias("ra"), F.col("y.row_id").alias("rb"))
        other = self.links.join(a, "class_a").join(b, "class_b").select("ra", "rb").where("ra <> rb")
        return same.unionByName(other).select(F.least("ra", "rb").alias("row_a"), F.greatest("ra", "rb").alias("row_b")).distinct()

    def groups(self) -> DataFrame:
        """``(row_id, class_id, group_id, n_links)``: one row a text.

        Groups are the connected components of the links, named after their
        smallest row_id; ``n_links`` counts the classes a row's class is linked to.
        """
        label = components(self.links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
        degree = (
            self.links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
        )
        named = self.members.join(label.select(F.col("node").alias("class_id"), "group_id"), "class_id", "left").join(degree, "class_id", "left")
        return named.select("row_id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, group_id)`` of an edge list ``(a, b)``: the smallest node of each component.

    Alternates large-star and small-star rounds, each written to the shared
    folder, until nothing changes; stars halve the distances every round.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.where("u <> v"), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = materialize(small, "small")
        grown = small.exceptAll(e).limit(1).count() + e.exceptAll(small).limit(1).count()
        e = small
        if not grown:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("group_id")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("group_id"))).distinct()
