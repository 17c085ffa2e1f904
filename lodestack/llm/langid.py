"""Language of documents and of their segments, with confidence.

Documents are cut into sentences, sentences into fixed-length byte windows that
cover them whole, and a byte convolutional network rates every window.  The
ratings of a sentence are added up and weighed by what the rest of the document
speaks; neighbouring sentences of one language form a segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.bytenet import ByteNet, clean, windows
from lodestack.llm.forms import canonical_spans

#: Labelled rows the network is trained on at most, taken by a hash of their id.
TRAIN_ROWS = 4000
#: Whole sentences a language needs to count in a document.
SENTENCES = 2
#: Words of running text without full stops that stand for one sentence.
LOOSE_WORDS = 14
#: What a change of language from one sentence to the next costs, in nats.
SWITCH = 3.0

# fixed values: other spellings of the languages, lower case, region cut off
SPELLINGS = {
    "en": "en eng english", "zh": "zh zho chi chinese cmn", "de": "de deu ger german", "fr": "fr fra fre french",
    "es": "es spa spanish", "pt": "pt por portuguese", "ru": "ru rus russian", "ja": "ja jpn japanese",
}
NO_LANGUAGE = "und xx n/a na unknown none null mul zxx mis"

_CJK = "぀-ヿ㐀-鿿豈-﫿"
_WORD = re.compile(rf"[{_CJK}]|(?:(?![{_CJK}])[^\W\d_])+(?:['’-](?:(?![{_CJK}])[^\W\d_])+)*")
_ONE_CJK = re.compile(rf"[{_CJK}]")
_PLAIN_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")  # the same where there are none
_ITEM = re.compile(r"\s*(?:[-*•–—]|\d{1,3}[.)])\s+")
_STOP = re.compile(r"[。！？]+[”』」）)\"]*|[.!?]+[\"”»)\]]*(?=\s|$|[" + _CJK + "])")
_NEEDS_FORM = re.compile("[­͏​-‏ -  ⁠︀-️﻿Ａ-ｚ]|[A-Za-z][Ͱ-ԯ]|[Ͱ-ԯ][A-Za-z]")


def label_code(label: Column) -> Column:
    """The two-letter code a label names, or null if it names no language."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+|n/a)", 1)
    known = F.lit(None).cast("string")
    for code, names in SPELLINGS.items():
        known = F.when(base.isin(names.split()), F.lit(code)).otherwise(known)
    return F.when(base.isin(["", *NO_LANGUAGE.split()]), F.lit(None).cast("string")).otherwise(F.coalesce(known, base))


def _weight(piece: str) -> int:
    """Length in words; two Chinese characters or kana count as one."""
    if piece.isascii() or not _ONE_CJK.search(piece):
        return len(_PLAIN_WORD.findall(piece))
    words = len(_WORD.findall(piece))
    cjk = len(_ONE_CJK.findall(piece))
    return words - cjk + cjk // 2


def sentences(text: str) -> list[tuple[int, int, float]]:
    """``(start, end, share)`` of the pieces of prose.

    ``share`` is 1 for a whole sentence; running text without a full stop counts
    by its words; what is too short for prose (titles, names, list entries,
    tables) counts 0 and is left out.
    """
    out: list[tuple[int, int, float]] = []
    open_at = None  # running text that goes on in the next line

    def close(end: int) -> None:
        nonlocal open_at
        if open_at is not None:
            words = _weight(text[open_at:end])
            if words >= LOOSE_WORDS:
                out.append((open_at, end, words / LOOSE_WORDS))
            open_at = None

    at = 0
    for line in text.splitlines(keepends=True):
        start, at = at, at + len(line)
        body = line.rstrip()
        end = start + len(body)
        item = _ITEM.match(line)
        if not body or "\t" in body:
            close(start)
            continue
        if item:
            close(start)
            start += item.end()
        elif open_at is not None and _weight(text[open_at:start]) < 4:
            open_at = None  # a title before the text
        begin = start if open_at is None else open_at
        for m in _STOP.finditer(text, start, end):
            if _weight(text[begin : m.end()]) >= 3:
                out.append((begin, m.end(), 1.0))
            begin = m.end()
        open_at = begin if begin < end and text[begin:end].strip() else None
        if item and open_at is not None:
            if _weight(text[open_at:end]) >= 5:
                out.append((open_at, end, 0.5))  # a list entry that is a clause
            open_at = None
    close(len(text))
    return out


def judge(net: ByteNet, texts: list[str | None], short: bool = False) -> list[list[tuple[int, int, float, str, float]]]:
    """``(start, end, share, lang, confidence)`` of the sentences of each text, in places of the text as it is.

    ``short``: a text without a sentence is judged as a whole, with share 0.
    """
    pieces: list[bytes] = []
    where: list[list[tuple[int, int, float]]] = []
    spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # where the characters of a formed text come from
    for n, text in enumerate(texts):
        text = text or ""
        if _NEEDS_FORM.search(text):
            text, *spans[n] = canonical_spans(text)
        cuts = sentences(text) or ([(0, len(text), 0.0)] if short and _WORD.search(text) else [])
        where.append(cuts)
        pieces += [clean(text[a:b].strip()) for a, b, _ in cuts]
    if not pieces:
        return [[] for _ in texts]
    ends = np.cumsum([len(p) for p in pieces])
    x, owner, held = windows(b"".join(pieces), np.concatenate(([0], ends[:-1])), ends)
    rated = net.log_probs(x) * np.minimum(1, held / 48)[:, None]
    total = np.zeros((len(pieces), len(net.labels)))
    for c in range(total.shape[1]):
        total[:, c] = np.bincount(owner, rated[:, c], len(pieces))
    doc = np.repeat(np.arange(len(texts)), [len(w) for w in where])
    size = np.array([s for w in where for *_, s in w])
    prior = np.zeros((len(texts), len(net.labels)))
    post = _softmax(total)
    for _ in range(2):  # what the document speaks weighs on each of its sentences
        for c in range(prior.shape[1]):
            prior[:, c] = np.bincount(doc, post[:, c] * size, len(texts))
        prior = (prior + 0.02) / (prior + 0.02).sum(1, keepdims=True)
        post = _softmax(total + np.log(prior[doc]))
    best = post.argmax(1)
    rated = total + np.log(prior[doc])
    out, k = [], 0
    for w in where:
        if w and (best[k : k + len(w)] != best[k]).any():
            best[k : k + len(w)] = _path(rated[k : k + len(w)])
        k += len(w)
    k = 0
    for t, w in enumerate(where):
        if t in spans:
            begins, ends = spans[t]
            w = [(int(begins[a]), int(ends[b - 1]), s) for a, b, s in w]
        out.append([(a, b, s, net.labels[best[k + n]], float(post[k + n, best[k + n]])) for n, (a, b, s) in enumerate(w)])
        k += len(w)
    return out


def _path(rated: np.ndarray) -> np.ndarray:
    """The best sequence of languages if each switch costs ``SWITCH``."""
    back = np.empty(rated.shape, np.int64)
    score = rated[0]
    for t in range(1, len(rated)):
        stay, top = score, score.argmax()
        back[t] = np.where(stay >= score[top] - SWITCH, np.arange(len(score)), top)
        score = np.maximum(stay, score[top] - SWITCH) + rated[t]
    path = np.empty(len(rated), np.int64)
    path[-1] = score.argmax()
    for t in range(len(rated) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


_fitted: dict[bytes, ByteNet] = {}


def train(samples: DataFrame, rows: int = TRAIN_ROWS, path: str | None = None) -> ByteNet:
    """Train on labelled rows (``sample_id, lang, text``), at most ``rows`` of them.

    The same rows give the same network: it is fitted once a session, and with a
    ``path`` kept there (a file of the driver) for others.
    """
    kept = samples.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("sample_id", label_code(F.col("lang")).alias("lang"), "text")
    kept = kept.where("lang is not null").orderBy(F.xxhash64("sample_id"), "sample_id", "text").limit(rows)
    got = [(r.lang, r.text) for r in kept.collect()]  # bounded by ``rows``
    if not got:
        raise ValueError("there are no labelled samples to train on")
    digest = blake2b("\0".join(x for g in got for x in g).encode("utf-8", "surrogatepass"), digest_size=16).digest()
    if digest not in _fitted:
        net = ByteNet.load(path, digest) if path else None
        _fitted[digest] = net or ByteNet(sorted({g[0] for g in got})).fit([g[1] for g in got], [g[0] for g in got])
        if path and net is None:
            _fitted[digest].save(path, digest)
    return _fitted[digest]


def _slices(texts: list, most: int = 400_000) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most or i == len(texts) - 1:
            yield start, i + 1
            start, held = i + 1, 0


def _segments(shared, documents: bool) -> callable:
    schema = _DOC_SCHEMA if documents else _SEG_SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[] for _ in schema]
            for i, j in _slices(texts):
                for doc, found in zip(ids[i:j], judge(net, texts[i:j], documents)):
                    if documents:
                        sums: dict[str, list[float]] = {}
                        for a, b, s, lang, conf in found:
                            x = sums.setdefault(lang, [0.0, 0.0])
                            x[0] += s
                            x[1] += s * conf if s else conf
                        rows = [(doc, lang, n, c / n if n else c) for lang, (n, c) in sums.items()]
                    else:
                        rows, prev = [], None
                        for a, b, s, lang, conf in found:
                            if prev and prev[4] == lang:
                                n = prev[5] + s
                                prev[3], prev[6], prev[5] = b, (prev[6] * prev[5] + conf * s) / n, n
                            else:
                                prev = [doc, len(rows), a, b, lang, s, conf]
                                rows.append(prev)
                    for r in rows:
                        for col, v in zip(out, r):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


_DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("sentences", pa.float64()), ("confidence", pa.float64())])
_DOC_DDL = "doc_id bigint, lang string, sentences double, confidence double"
_SEG_SCHEMA = pa.schema([("doc_id", pa.int64()), ("segment", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("sentences", pa.float64()), ("confidence", pa.float64())])
_SEG_DDL = "doc_id bigint, segment int, start int, end int, lang string, sentences double, confidence double"


def _apply(documents: DataFrame, net: ByteNet, whole: bool) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(net)  # a few MB, whatever the data
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return rows.mapInArrow(_segments(shared, whole), _DOC_DDL if whole else _SEG_DDL)


def language_segments(documents: DataFrame, net: ByteNet) -> DataFrame:
    """``(doc_id, segment, start, end, lang, sentences, confidence)``.

    Offsets are characters of the text as it is.  Null ids and
    texts, and texts without prose, have no segment.
    """
    return _apply(documents, net, False)


def document_languages(documents: DataFrame, net: ByteNet) -> DataFrame:
    """``(doc_id, lang, sentences, confidence)``: every language a document speaks.

    A text without a whole sentence (a title, a list) has one row with what it
    looks like and 0 sentences; one without a letter has none.
    """
    return _apply(documents, net, True)


def wrong_labels(documents: DataFrame, net: ByteNet, least: float = SENTENCES) -> DataFrame:
    """``(doc_id, lang)`` of documents whose label is missing or wrong, or that mix languages.

    A language counts with ``least`` whole sentences.  Documents in which none
    counts are left out.  One row a language; ``documents``: doc_id, text, lang.
    """
    labels = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), label_code(F.col("lang")).alias("label"), "text")
    shared = documents.sparkSession.sparkContext.broadcast(net)
    rows = labels.where("doc_id is not null and text is not null")
    return rows.mapInArrow(_cases(shared, least), "doc_id bigint, lang string").distinct()


def _cases(shared, least: float) -> callable:
    """Label and languages of a document meet where its text is: nothing is joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            ids, labels, texts = (batch.column(k).to_pylist() for k in range(3))
            out_id, out_lang = [], []
            for i, j in _slices(texts):
                for doc, label, found in zip(ids[i:j], labels[i:j], judge(net, texts[i:j])):
                    sums: dict[str, float] = {}
                    for *_, s, lang, _ in found:
                        sums[lang] = sums.get(lang, 0) + s
                    speaks = [c for c, n in sums.items() if n >= least]
                    if len(speaks) > 1 or len(speaks) == 1 and speaks[0] != label:
                        out_id += [doc] * len(speaks)
                        out_lang += speaks
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out_id, pa.int64()), "lang": pa.array(out_lang, pa.string())})

    return run
