"""Column functions against plain Python models, on awkward texts."""

import random
import re

import pytest
from lodestack.functions import paths as P
from lodestack.functions import text as X
from pyspark.sql import functions as F

SPACE = "\t\n\x0b\x0c\r \x85\xa0      　"
ODD = ["", " ", "a", "ab", "aaa", "İΣς", "ＡＢＣ", "😀a😀", "报告.docx", "x\r\ny\rz\x0b ", "�\x00q\U0010ffff", None, "é" * 50, "日本" * 60, "　\xa0"]


def texts(n=120, seed=3):
    rng = random.Random(seed)
    alphabet = "abA é日本語😀\n.report"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 150))) for _ in range(n)]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def model_lower(t):
    return "".join(c.lower()[0] for c in t)


def test_lower(spark):
    assert column(spark, texts(), X.lower_simple) == [t if t is None else model_lower(t) for t in texts()]


def test_normalize(spark):
    def model(t):
        t = re.sub("\r\n?", "\n", t)
        t = re.sub("[\x0b\x0c  ]", "\n", t)
        return "".join(c for c in t if not (ord(c) < 9 or 13 < ord(c) < 32 or 127 <= ord(c) < 160 or c == "�" or 0xE000 <= ord(c) <= 0xF8FF or 0xFDD0 <= ord(c) <= 0xFDEF or ord(c) & 0xFFFE == 0xFFFE))

    assert column(spark, texts(), X.normalize_for_store) == [t if t is None else model(t) for t in texts()]
    assert column(spark, texts(), X.is_blank) == [t if t is None else not t.strip(SPACE) for t in texts()]


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4, 7, 64])
def test_truncate(spark, most):
    assert column(spark, texts(), lambda c: X.truncate_bytes(c, most)) == [t if t is None else t.encode()[:most].decode("utf-8", "ignore") for t in texts()]


def test_truncate_at_the_stores_limit(spark):
    """Texts around the limit, each of its bytes inside a character of another width."""
    most = X.MAX_TEXT_BYTES
    long = ["x" * (most - k) + ch * 3 for k in range(5) for ch in ("y", "é", "日", "😀")] + ["日" * most, "x" * most]
    assert column(spark, long, lambda c: X.truncate_bytes(c, most)) == [t.encode()[:most].decode("utf-8", "ignore") for t in long]


def test_grams(spark):
    def pairs(t):
        return [t] if len(t) == 1 else [t[i : i + 2] for i in range(len(t) - 1)]

    kept = [t for t in texts() if t is not None]
    assert column(spark, kept, X.bigrams) == [pairs(t) for t in kept]
    assert column(spark, kept, X.uni_bigrams) == [list(t) + (pairs(t) if len(t) > 1 else []) for t in kept]
    for g in ("aa", "ab", "a", "日本", "😀a", "."):
        assert column(spark, kept, lambda c, g=g: X.gram_count(c, g)) == [sum(t[i : i + len(g)] == g for i in range(len(t))) for t in kept]
    assert column(spark, ["报告2024final.docx réaution"], X.words) == [["报告", "2024final", "docx", "r", "é", "aution"]]


def model_snippet(text, term):
    low = model_lower(text)
    src = text if len(text) == len(low) else low
    b, i, q = src.encode(), len(src[: low.index(term)].encode()), len(term.encode())
    start, end = max(0, i - 40), min(len(b), i + q + 40)
    while 0 < start < i and b[start] & 0xC0 == 0x80:
        start += 1
    while end < len(b) and b[end] & 0xC0 == 0x80:
        end += 1
    s = b[start:end].decode().replace("\n", " ").strip(SPACE)
    return ("…" if start > 0 else "") + s + ("…" if end < len(b) else "")


def test_snippet(spark):
    kept = [t for t in texts(300, 9) if t and "a" in model_lower(t)]
    assert column(spark, kept, lambda c: X.snippet(c, X.lower_simple(c), "a")) == [model_snippet(t, "a") for t in kept]


def test_paths(spark):
    paths = ["/a/B.TXT", "/a.b/c", "noext", "archive.tar.gz", "/.bashrc", "/x.", "/", "a/", "", "/r"]
    assert column(spark, paths, P.ext_of) == [".txt", "", "", ".gz", ".bashrc", ".", "", "", "", ""]
    assert column(spark, paths, P.parent_of) == ["/a", "/a.b", ".", ".", "/", "/", "/", "a", ".", "/"]
    assert column(spark, paths, P.base_name) == [p.rpartition("/")[2] for p in paths]
    assert column(spark, ["/m.MKV", "/m", "/m.opus", "/m.xapk", "/m.docx"], P.file_type) == ["video", "file", "music", "apk", "doc"]


def test_pruning(spark):
    rows = [
        ("/r/.git", True, False), ("/r/.x", False, False), ("/r/a/proc", True, False), ("/r/a/proc/x", False, False), ("/r/proc.txt", False, True),
        ("/r/Android/data", True, False), ("/r/Android/obb/f", False, False), ("/r/Android/media", True, True), ("/r/data/f", False, True), ("/r", True, True),
        ("/r/lost+found/f", False, False), ("/r/LOST.DIR", True, False), ("/r/a/.b/c", False, False), ("/r/sys", False, True),
    ]
    df = spark.createDataFrame(rows, "p string, folder boolean, want boolean")
    got = df.select("p", "want", P.is_kept(F.col("p"), F.lit("/r/"), F.col("folder")).alias("got")).collect()
    assert [r.p for r in got if r.got != r.want] == []
    inside = spark.createDataFrame([("/x/Android/data/f",), ("/x/Android/other",)], "p string")
    assert [r[0] for r in inside.select(P.is_kept(F.col("p"), F.lit("/x/Android"), F.lit(False))).collect()] == [False, True]


def test_display(spark):
    sizes = spark.createDataFrame([(0,), (1,), (1023,), (1024,), (1536,), (1 << 20,), (5 << 30,)], "s bigint")
    assert [r[0] for r in sizes.select(P.size_text(F.col("s"))).collect()] == ["", "1 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 GB"]
    v = ["v1.0.0-alpha23", "1.0.0", "1.0-beta2", "V2", "1.0.0-rc1", "x", "1.2.3.4", None]
    assert column(spark, v, P.version_key) == [[1, 0, 0, 1, 23], [1, 0, 0, 4, 0], [1, 0, 0, 2, 2], [2, 0, 0, 4, 0], [1, 0, 0, 3, 1], None, None, None]
    assert column(spark, ["primary:Docs/x", "primary:", "1234-ABCD:x"], lambda c: P.uri_to_path(c, "/storage/emulated/0")) == ["/storage/emulated/0/Docs/x", "/storage/emulated/0", None]


def test_external_paths(spark):
    rows = [("/e/a", True), ("/e", True), ("/evil/a", False), ("/e/../x", False), ("/e/./x", False), ("/e/a..b", True), ("", False), ("/e/a\nb", False)]
    df = spark.createDataFrame(rows, "p string, want boolean")
    assert [r.p for r in df.select("p", "want", P.valid_external(F.col("p"), F.lit("/e/")).alias("got")).collect() if r.got != r.want] == []
    assert [r[0] for r in df.limit(3).select(P.valid_external(F.col("p"), F.lit(""))).collect()] == [True, True, True]
