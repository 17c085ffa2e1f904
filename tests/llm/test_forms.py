"""One form for text that reads the same."""

import random
import re
import unicodedata

import numpy as np
import pytest
from lodestack.llm import forms as fm
from lodestack.llm import reading, tokens

SAME = [
    ("vertrag", "ｖｅｒｔｒａｇ"), ("ロポケベ", "ﾛﾎﾟｹﾍﾞ"), ("docx", "ԁoϲх"), ("finally office", "ﬁnally oﬃce"), ("é", "é"), ("手册", "⼿册"),
    ("a b", "a b"), ("a b", "a　b"), ("a-b", "a‑b"), ("plan", "pl​an"), ("plan", "p­lan﻿"), ("рецепт", "peцe⁠пт"),
    ("Sitzordnung", "Ѕitzordnung"), ("cop", "сор"), ("BETA", "ΒΕТА"), ("ガイド", "ｶﾞｲﾄﾞ"), ("한", "한"), ("ç", "ç"), ("s︎um", "sum"),
]
OTHER = [("x²", "x2"), ("™", "tm"), ("①", "1"), ("Ab", "ab"), ("e", "é"), ("h₂o", "h2o"), ("ガス", "カス"), ("и", "й"), ("a b", "a\tb"), ("plana", "plan a"), ("a—b", "a-b"), ("½", "1/2"), ("", " ")]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert fm.reading_key(a) == fm.reading_key(b)


@pytest.mark.parametrize("a, b", OTHER)
def test_other(a, b):
    assert fm.reading_key(a) != fm.reading_key(b)


def test_form():
    assert fm.canonical_text("о‌ргaмo") == "оргамо" and fm.canonical_text("wеrk") == "werk"
    assert fm.canonical_text("сор и он") == "сор и он"  # a Russian word stays Russian
    assert fm.canonical_text(None) is None and fm.canonical_text("") == ""
    rng = random.Random(2)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x370), *range(0x391, 0x460), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0x3041, 0x3100), *range(0xFF01, 0xFFA0), *range(0xAC00, 0xAC20), *range(0x1100, 0x1200)]]
    for _ in range(3000):
        s = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))
        once = fm.canonical_text(s)
        assert unicodedata.is_normalized("NFC", once)
        assert fm.canonical_text(once) == once
        assert fm.canonical_text(unicodedata.normalize("NFD", s)) == once


def test_stable_ranges():
    f = fm.forms()
    stable = re.compile(f"[{fm._STABLE}]")
    assert [c for c in range(0x80, 0xFFFF) if not 0xD800 <= c < 0xE000 and stable.match(chr(c)) and f.unstable.match(chr(c))] == []


def test_pairs(spark):
    rows = [(1, "plan"), (2, "pl​an"), (3, "ｐｌａｎ"), (4, "plan"), (5, "PLAN"), (6, None), (None, "plan"), (7, ""), (8, "​"), (2, "pl​an"), (9, "x" * 200_000), (10, "x" * 200_000 + "­")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "id bigint, t string, key int")
    got = reading.same_reading_pairs(reading.readings(df, "f", "id", "t"))
    want = {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (7, 8), (9, 10)}
    assert {(r.id_a, r.id_b) for r in got.collect()} == want and {r.src_field for r in got.collect()} == {"f"}
    lists = [(1, ["a b", "c"]), (2, ["a b", "c"]), (3, ["a", "b c"]), (4, ["a b", "c", None]), (5, ["a b", None, "c"]), (6, []), (7, None), (8, ["a b c"]), (9, ["a b␞|vc"]), (10, ["c", "a b"]), (11, ["ａ b", "c", None])]
    df = spark.createDataFrame(lists, "id bigint, l array<string>")
    got = reading.same_reading_pairs(reading.list_readings(df, "l", "id", "l"))
    assert {(r.id_a, r.id_b) for r in got.collect()} == {(1, 2), (4, 11)}


def test_hot_value(spark):
    """A third of all rows share a value; every pair still comes out, once."""
    df = spark.createDataFrame([(i, "report" if i % 3 else f"n{i}") for i in range(900)] + [(1000, "rеport"), (1001, "report‍")], "id bigint, t string")
    got = reading.same_reading_pairs(reading.readings(df, "f", "id", "t"))
    assert got.count() == 600 * 2 + 1


def plain_tokens(text):
    low = fm.canonical_text(fm.canonical_text(text).lower()).translate(fm.forms().skeleton_map)
    cjk = "ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿ々-〇㐀-䶿一-鿿豈-﫿"
    return re.findall(rf"[{cjk}]|(?:(?![{cjk}])[^\W_])+", low)


def test_tokens():
    texts = ["The plan, 2024-b!", "报告2024final.docx ガイド", "", None, "о‌ргaмo ПЛАН", "ｐｌａｎ b", "été", "a" * 5000, "。，", "İstanbul ŒUVRE ß", "一 二金了"]
    t = tokens.tokenize(texts)
    seen: dict = {}
    for k, text in enumerate(texts):
        got = t.hashes[t.starts[k] : t.starts[k + 1]]
        want = plain_tokens(text or "")
        assert len(got) == len(want), text
        for h, w in zip(got.tolist(), want):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    a, b = tokens.tokenize(["x the plan of y"]), tokens.tokenize(["THE plаn OF"])
    assert np.isin(b.hashes, a.hashes).all()
    g, pos, owner = tokens.ngrams(tokens.tokenize(["a b c", "c d", "a b c d"]), 3)
    assert owner.tolist() == [0, 2, 2] and g[0] == g[1] != g[2]
    assert tokens.ngrams(tokens.tokenize([]), 3)[0].size == 0


def test_no_rows(spark):
    assert reading.same_reading_pairs(reading.readings(spark.createDataFrame([], "id bigint, t string"), "f", "id", "t")).count() == 0
