"""Filling containers of fixed capacity with texts measured in tokens.

Minimum bin slack: a container begins with the longest item left; over the
lengths still available a subset-sum dynamic program on a bitset finds the
fullest combination that fits beside it, and the combination is removed, as
often as the stock of its lengths allows.  The program needs only how many items
there are of each length, never more numbers than the capacity, so the plan is
made on the driver for any number of texts; which text takes which place is
decided where the texts are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.session import materialize

#: Setting that names the rank file of a tokenizer, and what it is where it is unset.
VOCABULARY_SETTING = "spark.lodestack.vocabulary"
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# fixed value: the split that belongs to the rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of one length are numbered by groups of about so many, at least in SALTS groups.
SALTS, GROUP_ITEMS = 64, 200_000
#: Places of one length are numbered below this.
_RANKS = 1 << 40

_encodings: dict[int, object] = {}


def _encoding(data: bytes, pattern: str):
    key = hash((data, pattern))
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def _measure(shared, pattern: str) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value, pattern).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array(sizes, pa.int64())})

    return run


def token_lengths(documents: DataFrame, vocabulary: str | None = None, pattern: str = PATTERN, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens)``: sizes of the whole texts; null ids and texts are left out.

    The vocabulary file (by default the one ``VOCABULARY_SETTING`` names) is read on
    the driver and sent to the tasks.  An id with
    several texts has the size of the largest.
    """
    vocabulary = vocabulary or documents.sparkSession.conf.get(VOCABULARY_SETTING, VOCABULARY)
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return rows.mapInArrow(_measure(shared, pattern), "doc_id bigint, n_tokens bigint").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def fullest(stock: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """The combination of available lengths whose sum comes closest to ``room``.

    ``order``: lengths, longest first.  Bit s of the set says that a sum s is
    reachable; a length joins in as many copies as stock and room allow.
    """
    reach, whole = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # reachable before, size of the step, copies
    for length in order:
        if length > room:
            continue
        left, block = min(stock[length], room // length), 1
        while left:
            copies = min(block, left)
            steps.append((reach, length, copies))
            reach |= (reach << (length * copies)) & whole
            left -= copies
            block *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for before, length, copies in reversed(steps):
        if not before >> at & 1:
            at -= length * copies
            taken[length] = taken.get(length, 0) + copies
    return taken


def plan(stock: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """``(length, first place, items a container, first container)`` rows, and the containers.

    ``stock``: items by length, none above the capacity.  The combination found
    for one container is used again while there are items for it.
    """
    stock = {k: v for k, v in stock.items() if k > 0 and v > 0}
    order = sorted(stock, reverse=True)
    used = dict.fromkeys(stock, 0)
    rows, container = [], 0
    while order:
        first = order[0]
        stock[first] -= 1
        taken = fullest(stock, order, capacity - first)
        stock[first] += 1
        taken[first] = taken.get(first, 0) + 1
        times = min(stock[k] // n for k, n in taken.items())
        for k, n in taken.items():
            rows.append((k, used[k], n, container))
            used[k] += n * times
            stock[k] -= n * times
        container += times
        order = [k for k in order if stock[k]]
    return rows, container


def _place(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = shared.value
        for batch in batches:
            cols = {n: batch.column(k).to_numpy() for k, n in enumerate(batch.schema.names)}
            container = np.empty(batch.num_rows, np.int64)
            for spec, (start, each, first) in plans.items():
                own = np.flatnonzero(cols["spec_id"] == spec)
                place = cols["n_tokens"][own] * _RANKS + cols["rank"][own]
                row = np.searchsorted(start, place, side="right") - 1
                container[own] = first[row] + (place - start[row]) // each[row]
            out = {n: batch.column(k) for k, n in enumerate(batch.schema.names) if n != "rank"}
            yield pa.RecordBatch.from_pydict(out | {"container": pa.array(container)})

    return run


def pack(lengths: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    """``(spec_id, container, doc_id, piece, start_token, n_tokens)``.

    ``lengths``: doc_id, n_tokens; ``specs``: (spec_id, capacity).  A document
    longer than the capacity is cut into pieces of exactly the capacity and a
    rest, numbered from 0; no other is split.  Documents without tokens take no
    room and lie in no container; null ids and lengths are left out.  Containers
    are numbered from 0 in each spec; specs with a capacity below 1 are refused.
    """
    spark = lengths.sparkSession
    if any(c is None or c < 1 for _, c in specs) or len({s for s, _ in specs}) < len(specs):
        raise ValueError("each spec needs its own id and a capacity of at least 1")
    ddl = "spec_id int, doc_id bigint, piece bigint, start_token bigint, n_tokens bigint, container bigint"
    shown = ["spec_id", "container", "doc_id", "piece", "start_token", "n_tokens"]
    if not specs:
        return spark.createDataFrame([], ddl).select(*shown)
    least = min(c for _, c in specs)
    pieces = lengths.where("n_tokens > 0").agg(F.sum(F.expr(f"(n_tokens - 1) div {least} + 1"))).first()[0] or 0
    salts = max(SALTS, -(-pieces // GROUP_ITEMS))
    each = F.explode(F.array(*(F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for s, c in specs)))
    items = lengths.where("doc_id is not null and n_tokens > 0").select("doc_id", F.col("n_tokens").alias("total"), each.alias("spec"))
    items = items.select("doc_id", "total", "spec.*", F.explode(F.expr("sequence(0L, (total - 1) div spec.capacity)")).alias("piece"))
    items = items.select(
        "spec_id",
        "doc_id",
        "piece",
        (F.col("piece") * F.col("capacity")).alias("start_token"),
        F.least(F.col("capacity"), F.col("total") - F.col("piece") * F.col("capacity")).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int").alias("salt"),
    )
    # how many items each length has, split by salt so that a length everyone has is spread
    counts = materialize(items.groupBy("spec_id", "n_tokens", "salt").agg(F.count("*").alias("n")), "counts")
    before = F.sum("n").over(Window.partitionBy("spec_id", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")

    plans = {}
    stock: dict[int, dict[int, int]] = {s: {} for s, _ in specs}
    for r in counts.groupBy("spec_id", "n_tokens").agg(F.sum("n").alias("n")).toLocalIterator():  # at most one row a length and spec
        stock[r.spec_id][r.n_tokens] = r.n
    for spec, capacity in specs:
        rows, _ = plan(stock[spec], capacity)
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 4)
        plans[spec] = (table[:, 0] * _RANKS + table[:, 1], table[:, 2], table[:, 3])
    shared = spark.sparkContext.broadcast(plans)  # bounded by the capacities

    within = F.row_number().over(Window.partitionBy("spec_id", "n_tokens", "salt").orderBy("doc_id", "piece")) - 1
    ranked = items.withColumn("within", within).join(offsets, ["spec_id", "n_tokens", "salt"])
    ranked = ranked.select("spec_id", "doc_id", "piece", "start_token", "n_tokens", (F.col("before") + F.col("within")).alias("rank"))
    return ranked.mapInArrow(_place(shared), ddl).select(*shown)


def packing_invariants(packed: DataFrame, lengths: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    """``(spec_id, documents, misplaced, above_capacity, split_needlessly)``: what must hold of a packing, counted.

    ``misplaced``: documents whose pieces don't add up to them exactly once;
    ``split_needlessly``: documents within the capacity that lie in pieces.
    """
    cap = F.lit(None).cast("bigint")
    for s, c in specs:
        cap = F.when(F.col("spec_id") == s, c).otherwise(cap)
    full = packed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > cap).groupBy("spec_id").agg(F.count("*").alias("above_capacity"))
    own = packed.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.min("start_token").alias("start"))
    checked = own.join(lengths.select("doc_id", F.col("n_tokens").alias("whole")), "doc_id", "left")
    good = (F.col("n") == F.col("whole")) & (F.col("end") == F.col("whole")) & (F.col("start") == 0)
    counted = checked.groupBy("spec_id").agg(
        F.count("*").alias("documents"), F.count_if(~F.coalesce(good, F.lit(False))).alias("misplaced"), F.count_if((F.col("pieces") > 1) & (F.col("whole") <= cap)).alias("split_needlessly")
    )
    return counted.join(full, "spec_id", "left").select("spec_id", "documents", "misplaced", F.coalesce("above_capacity", F.lit(0)).alias("above_capacity"), "split_needlessly")


def pack_documents(documents: DataFrame, specs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``pack`` over the texts of ``documents`` for every row of ``specs``.

    Specs (spec_id, capacity_tokens) are settings, a handful; rows without id or
    capacity are left out.
    """
    wanted = specs.where("spec_id is not null and capacity_tokens is not null").select("spec_id", "capacity_tokens").distinct().orderBy("spec_id")
    lengths = materialize(token_lengths(documents, vocabulary), "lengths")
    return pack(lengths, [(r.spec_id, r.capacity_tokens) for r in wanted.collect()])
