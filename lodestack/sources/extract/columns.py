"""Document text as a column: bytes and extension in, text out."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions import paths as P
from lodestack.sources.extract import office97, ooxml, pdf

MOST_FILE = P.MAX_FILE_BYTES
MOST_TEXT = 1_048_576
#: Seconds a parser may take for one document.
MOST_SECONDS = 45.0
#: Texts held before they are passed on.
TOGETHER = 32

#: Parsers by extension; an engine may add its own.
PARSERS: dict[str, Callable[[bytes], str | None]] = {
    ".docx": ooxml.docx, ".pptx": ooxml.pptx, ".xlsx": ooxml.xlsx, ".doc": office97.doc, ".wps": office97.doc, ".xls": office97.xls, ".ppt": office97.ppt,
    ".pdf": pdf.text,
}


class TookTooLong(Exception):
    """A parser went beyond its time."""


@contextmanager
def time_limit(seconds: float) -> Iterator[None]:
    """Ends the block after so many seconds; only a main thread, as a worker's is, can be ended so."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise TookTooLong

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def extract(ext: str | None, data: bytes | None, parsers: dict | None = None, seconds: float = MOST_SECONDS) -> str | None:
    """The text of a document, or None: no parser, too large, too slow, empty, damaged or blank."""
    parser = (parsers or PARSERS).get(ext or "")
    if parser is None or not data or len(data) > MOST_FILE:
        return None
    try:
        with time_limit(seconds):
            text = parser(bytes(data))
    except Exception:  # whatever a damaged file does to a parser
        return None
    if not text or not text.strip():
        return None
    raw = text.encode("utf-8", "replace")
    return text if len(raw) <= MOST_TEXT else raw[:MOST_TEXT].decode("utf-8", "ignore")


def text_column(data: Column, ext: Column) -> Column:
    """``extract`` in Arrow batches."""
    import pandas as pd

    parsers = dict(PARSERS)

    def run(d: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([extract(x, b, parsers) for b, x in zip(d, e)], dtype="object")

    run.__annotations__ = {"d": pd.Series, "e": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.StringType())(data, ext)


def documents_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, text)`` of the documents at the given places (``binaryFile``)."""
    files = spark.read.format("binaryFile").load(paths).where(F.col("length").between(1, MOST_FILE))
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.select(path.alias("path"), text_column(F.col("content"), P.ext_of(path)).alias("text")).where("text is not null")


def texts_at(queue: DataFrame, parsers: dict | None = None, seconds: float = MOST_SECONDS) -> DataFrame:
    """``(path, text)`` for a queue of paths that all workers can open.

    For queues too long to be named to one reader: each task opens its own files.
    Paths are dealt out by hash, as large documents lie together in folders.
    """
    import pandas as pd

    parsers = dict(parsers or PARSERS)

    def read(path: str) -> str | None:
        name = path.rpartition("/")[2]
        try:
            with open(path, "rb") as f:
                return extract("." + name.rpartition(".")[2].lower() if "." in name else "", f.read(MOST_FILE + 1), parsers, seconds)
        except OSError:
            return None

    def run(batches):
        for pdf_ in batches:
            paths = list(pdf_["path"])
            for i in range(0, len(paths), TOGETHER):
                part = paths[i : i + TOGETHER]
                yield pd.DataFrame({"path": part, "text": [read(p) for p in part]})

    return queue.select("path").repartition("path").mapInPandas(run, "path string, text string").where("text is not null")
