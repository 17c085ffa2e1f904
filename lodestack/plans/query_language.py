"""The query language: keywords, ``"phrases"``, ``type:`` and ``dir:`` filters.

A query is read from left to right with one regular expression of alternatives;
blanks are the eight characters of Latin-1 white space.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: names of the types, in English and Chinese
ALIASES = {
    "video": "video movie movies 视频 影片",
    "music": "audio music 音频 音乐",
    "image": "image photo photos pic 图片 照片",
    "doc": "doc docs document documents 文档",
    "apk": "apk 安装包",
    "file": "file files 文件",
}
_TYPE_OF = {alias: t for t, names in ALIASES.items() for alias in names.split()}
_BLANK = "\t\n\x0b\x0c\r \x85\xa0"
_VALUE = rf'(?:"([^"]*)"?|([^{_BLANK}"][^{_BLANK}]*)?)'
_PART = re.compile(rf'[{_BLANK}]*(?:(?:(?i:type):{_VALUE})|(?:(?i:dir):{_VALUE})|"([^"]*)"?|([^{_BLANK}]+))')

DEFAULT_LIMIT, MOST = 300, 1000


class QueryError(ValueError):
    """The query can't be run."""


@dataclass
class QueryFilter:
    terms: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    dirs: list[str] = field(default_factory=list)

    @property
    def joined(self) -> str:
        return " ".join(self.terms)


def lower_simple(text: str) -> str:
    """Lower case, one character for one."""
    return "".join(ch.lower()[0] for ch in text)


def parse_query(raw: str) -> QueryFilter:
    """Terms, types and folder texts of a query; unknown types are ignored."""
    out = QueryFilter()
    at = 0
    while m := _PART.match(raw, at):
        at = m.end()
        kind = raw[m.start() : m.end()].lstrip(_BLANK)[:5].lower()
        if kind.startswith("type:"):
            t = _TYPE_OF.get(lower_simple(m[1] if m[1] is not None else m[2] or ""))
            if t and t not in out.types:
                out.types.append(t)
        elif kind.startswith("dir:"):
            value = m[3] if m[3] is not None else m[4] or ""
            if value:
                out.dirs.append(value)
        else:
            out.terms.append(m[5] if m[5] is not None else m[6])
        if at >= len(raw):
            break
    return out


def checked(raw: str) -> QueryFilter:
    """Parse a query that is to be run."""
    if not raw.strip():
        raise QueryError("the query is blank")
    f = parse_query(raw)
    if not f.joined.strip():
        raise QueryError("filters need a keyword")
    return f


def limit_of(limit: int) -> int:
    return limit if 0 < limit <= MOST else DEFAULT_LIMIT


_PARSED = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("terms", "types", "dirs")])


def parsed(raw: Column) -> Column:
    """``parse_query`` over a column, in Arrow batches; null stays null."""
    import pandas as pd

    def run(s: pd.Series) -> pd.DataFrame:
        rows = [parse_query(x) if x is not None else None for x in s]
        return pd.DataFrame({n: [None if r is None else getattr(r, n) for r in rows] for n in ("terms", "types", "dirs")})

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, _PARSED)(raw)


def parse_log(log: DataFrame) -> DataFrame:
    """``(query_id, terms, types, dirs)`` of logged queries, the lists joined by a bar."""
    p = parsed(F.col("raw_query"))
    bar = lambda n: F.array_join(F.col(f"p.{n}"), "|")
    return log.select("query_id", p.alias("p")).select("query_id", bar("terms").alias("terms"), bar("types").alias("types"), bar("dirs").alias("dirs"))
