"""Queries of the text operators against their SQL, and outputs SQL can't give."""

import random
import unicodedata

import compare
import duckdb
import numpy as np
import pytest
from lodestack.llm import forms, langid, leaks, queries, reading

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    assert compare.differences(spark, compare.connection(SF), name, queries.QUERIES[name], queries.SQL[name], SF) == ""


@pytest.mark.parametrize("lent, plain", [("repօrt", "report"), ("Ꭱeport", "Report"), ("repⲟrt", "report"), ("ꓣeport", "Report"), ("ᏞᎠFile", "LDFile"), ("отчⲥт", "отчст")])
def test_letters_lent_by_other_scripts(lent, plain):
    assert forms.canonical_text(lent) == forms.canonical_text(plain) == plain
    assert forms.reading_key(lent) == forms.reading_key(plain)


def test_words_of_those_scripts_stay():
    for word in ("ողջույն", "ⲛⲟⲩⲧⲉ", "ᏣᎳᎩ", "ꓡꓲꓢꓴ"):
        assert forms.canonical_text(word) == word


def test_spans_point_into_the_text():
    rng = random.Random(2)
    parts = ["plain ", "ｆｕｌｌ", "été ", "zero​width ", "ﬁle", "рaper ", " x", "日本", "が", "­", "🎉"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))
        formed, begins, ends = forms.canonical_spans(text)
        assert len(formed) == len(begins) == len(ends)
        assert (ends > begins).all() and (np.diff(begins) >= 0).all() and (not len(ends) or ends[-1] <= len(text))
        for k in range(len(formed)):
            assert formed[k] in forms.canonical_text(text[begins[k] : ends[k]]) or unicodedata.category(formed[k])[0] == "L"


def test_forms_and_groups(spark):
    rows = [(1, "ｒｅｐｏｒｔ"), (2, "report"), (3, "rep​ort"), (4, "other"), (5, None), (None, "report"), (6, "Report"), (7, "report"), (8, "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id bigint, t string, key int")
    out = {r.id: r.form for r in reading.canonical_rows(df, "t", "id", "t").collect()}
    assert out == {1: "report", 2: "report", 3: "report", 4: "other", 5: None, 6: "Report", 7: "report", 8: ""}
    groups = {r.id: (r.group_id, r.n_rows, r.n_spellings) for r in reading.reading_groups(reading.readings(df, "t", "id", "t")).collect()}
    assert groups == {k: (1, 4, 3) for k in (1, 2, 3, 7)}
    lists = spark.createDataFrame([(1, ["ａ", "б"]), (2, ["a", "б"]), (3, ["a|б"]), (4, ["a", None]), (5, None), (6, [])], "id bigint, t array<string>")
    assert {r.id: r.form for r in reading.canonical_rows(lists, "t", "id", "t").collect()} == {1: "a|б", 2: "a|б", 3: "a|б", 4: "a", 5: None, 6: ""}
    assert {(r.id_a, r.id_b) for r in reading.same_reading_pairs(reading.list_readings(lists, "t", "id", "t")).collect()} == {(1, 2)}


def test_one_reading_with_many_spellings(spark, monkeypatch):
    monkeypatch.setattr(reading, "SPELLINGS", 7)
    rows = [(k, "ab" + "​" * k + "cd") for k in range(60)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    pairs = {(r.id_a, r.id_b) for r in reading.same_reading_pairs(reading.readings(df, "t", "id", "t")).collect()}
    assert pairs == {(a, b) for a in range(60) for b in range(a + 1, 60)}


def test_lists_spare_the_slow_path():
    import re

    for plain in ("1report\x1e|1plan", "1отчёт\x1e|1план", "1会议"):
        assert not re.search(forms.NEEDS_WORK, plain)


def test_segments_cut_the_text_as_it_is(spark):
    samples = duckdb.sql(f"select sample_id, lang, text from '{SF}/lang_sample.parquet' order by sample_id").fetchall()
    net = langid.train(spark.createDataFrame(samples, "sample_id int, lang string, text string"))
    german = "Die Prüfung​ der Unterlagen dauert noch bis zum Ende der Woche. Danach wird der ge­samte Bericht an alle Abteilungen verschickt. "
    russian = "Отчёт о хранилище нужно проверить до конца месяца. Новая строка поиска больше не использует старые таблицы."
    docs = [(1, german + russian, "de"), (2, "Budget", "en"), (3, "12 345", None), (4, None, "en"), (None, german, "de"), (5, "", "en")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    segments = langid.language_segments(df, net).where("doc_id = 1").orderBy("segment").collect()
    assert [r.lang for r in segments] == ["de", "ru"]
    text = german + russian
    assert text[segments[0].start : segments[0].end].strip() == german.strip() and text[segments[1].start : segments[1].end].strip() == russian
    spoken = {(r.doc_id, r.lang): (r.sentences, r.confidence) for r in langid.document_languages(df, net).collect()}
    assert {k for k in spoken if k[0] == 1} == {(1, "de"), (1, "ru")} and spoken[1, "de"][0] == 2
    short = [(k, v) for k, v in spoken.items() if k[0] == 2]
    assert len(short) == 1 and short[0][1][0] == 0 and 0 < short[0][1][1] <= 1
    assert not {k for k in spoken if k[0] in (3, 4, 5)}


def test_network_is_kept(spark, tmp_path):
    samples = duckdb.sql(f"select sample_id, lang, text from '{SF}/lang_sample.parquet' order by sample_id limit 60").fetchall()
    df = spark.createDataFrame(samples, "sample_id int, lang string, text string")
    at = str(tmp_path / "net.npz")
    langid._fitted.clear()
    first = langid.train(df, path=at)
    langid._fitted.clear()
    again = langid.train(df, path=at)
    assert again is not first and again.labels == first.labels and all((a == b).all() for a, b in zip(first._params(), again._params()))
    x = np.frombuffer(b"ein kleiner Satz zum Vergleichen".ljust(64, b"\0"), np.uint8)[None]
    assert np.array_equal(first.log_probs(x), again.log_probs(x))
    assert langid.ByteNet.load(at, b"other") is None and langid.ByteNet.load(str(tmp_path / "none"), b"") is None


def test_edited_copies_are_scored(spark):
    """Copies of passages with every eighth to fifteenth token changed: found by a seed, and scored by how much is left."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    items, docs = [], []
    for i in range(40):
        passage = [rng.choice(words) for _ in range(80)]
        items.append((i, "en", " ".join(passage)))
        copy = list(passage)
        at = rng.randrange(3)
        while at < len(copy):
            copy[at] = "changed"
            at += rng.randrange(8, 16)
        docs.append((i, " ".join([rng.choice(words) for _ in range(200)] + copy + [rng.choice(words) for _ in range(200)])))
    docs += [(100 + i, " ".join(rng.choice(words) for _ in range(500))) for i in range(60)]
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id int, lang string, passage string")).collect()
    pairs = {(r.doc_id, r.item_id): r for r in got}
    assert set(pairs) <= {(i, i) for i in range(40)}
    print("edited copies met by a seed:", len(pairs), "of 40")
    assert len(pairs) >= 34 and all(0.6 < r.share <= 1 for r in pairs.values())
    assert not leaks.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id int, lang string, passage string")).count()
