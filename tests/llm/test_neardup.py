"""Near-duplicates against brute force."""

import random

import numpy as np
import pytest
from lodestack.llm import neardup as nd

DDL = "row_id bigint, text string, class_id int, sig string"


def corpus(n=240, seed=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        rows.append(base)
        for _ in range(rng.choice([0, 0, 1, 2])):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(copy)
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def brute(rows, n, least):
    sets = {i: set(s.tolist()) for (i, _), s in zip(rows, nd.shingle_sets([t for _, t in rows], n))}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DDL)


def test_against_brute_force(spark):
    rows = corpus()
    got = nd.NearDuplicates(frame(spark, rows), n=4, threshold=0.6)
    pairs = {(r.row_a, r.row_b) for r in got.row_pairs().collect()}
    want = brute(rows, 4, 0.6)
    sets = dict(zip([i for i, _ in rows], nd.shingle_sets([t for _, t in rows], 4)))
    sim = lambda p: len(np.intersect1d(sets[p[0]], sets[p[1]])) / len(np.union1d(sets[p[0]], sets[p[1]]))
    assert pairs <= want and all(sim(p) < 0.63 for p in want - pairs) and len(want - pairs) <= 1
    groups = {r.row_id: r for r in got.groups().collect()}
    assert set(groups) == {i for i, _ in rows}
    parent = {i: i for i in groups}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert all(groups[i].group_id == root(i) for i in groups)


def test_default_is_five_words_and_four_fifths(spark):
    rows = corpus(60, 7)
    assert {(r.row_a, r.row_b) for r in nd.NearDuplicates(frame(spark, rows)).row_pairs().collect()} == brute(rows, 5, 0.8)


def test_low_thresholds(spark):
    assert [nd.agreement(t) for t in (0.8, 0.6, 0.5, 0.4)] == [14, 14, 10, 7]
    rows = []
    for i in range(150):  # pairs of similarity 0.4
        head, tails = [f"h{i}x{k}" for k in range(43)], [[f"t{i}x{j}x{k}" for k in range(30)] for j in (0, 1)]
        rows += [(2 * i + j, " ".join(head + tails[j])) for j in (0, 1)]
    want = brute(rows, 4, 0.4)
    assert len(want) == 150
    assert {(r.row_a, r.row_b) for r in nd.NearDuplicates(frame(spark, rows), n=4, threshold=0.4).row_pairs().collect()} == want
    with pytest.raises(ValueError):
        nd.NearDuplicates(frame(spark, rows), threshold=0.1)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, "a b"), (2, "A  b!"), (3, "b a"), (4, None), (None, "a b"), (5, ""), (6, " \n"), (7, "…"), (8, long), (9, long + " end"), (1, "a b"), (10, "a b c d e f g h"), (11, "a b c d e f g h")]
    got = nd.NearDuplicates(frame(spark, rows), n=4, threshold=0.6)
    assert {(r.row_a, r.row_b) for r in got.row_pairs().collect()} == {(1, 2), (8, 9), (10, 11)}
    empty = nd.NearDuplicates(frame(spark, []), n=4, threshold=0.6)
    assert empty.row_pairs().count() == 0 and empty.groups().count() == 0


@pytest.mark.parametrize("hot", [8, 100_000])
def test_hot_group(spark, monkeypatch, hot):
    """A third of all rows are copies of one text, some with an edit; no link is lost, with or without long lists."""
    monkeypatch.setattr(nd, "PART", 8)
    base = [f"h{k}" for k in range(60)]
    rows = [(i, " ".join(base)) for i in range(40)] + [(100 + i, " ".join(base[:10] + [f"e{i}"] + base[11:])) for i in range(30)]
    rows += [(1000 + i, f"other text number {i} of no interest at all {i * 7}") for i in range(100)]
    assert {(r.row_a, r.row_b) for r in nd.NearDuplicates(frame(spark, rows), n=4, threshold=0.6, hot=hot).row_pairs().collect()} == brute(rows, 4, 0.6)


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8, 0.95])
def test_exact_join(spark, threshold):
    """Every pair at or above the threshold is a candidate, sets of all sizes among them."""
    rng = random.Random(9)
    common = list(range(40))
    sets = [sorted({*rng.sample(common, rng.randrange(0, 40)), *(rng.randrange(100, 400) for _ in range(rng.randrange(1, 30)))}) for _ in range(150)]
    for k in range(150):
        near = set(sets[k])
        for _ in range(rng.randrange(0, 6)):
            near.discard(rng.choice(sorted(near or {0})))
            near.add(rng.randrange(100, 400))
        sets.append(sorted(near))
    df = spark.createDataFrame(list(enumerate(sets)), "row_id bigint, grams array<bigint>")
    got = {tuple(r) for r in nd.exact_candidates(df, threshold).collect()}
    own = [set(s) for s in sets]
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if len(own[a] & own[b]) >= threshold * len(own[a] | own[b])}
    assert want and want <= got
    assert nd.exact_candidates(df.limit(0), threshold).count() == 0


def template(n, seed=3):
    """Texts that are half one form, half their own; every tenth has a copy with one word changed."""
    rng = random.Random(seed)
    form = [f"form{k}" for k in range(30)]
    rows = []
    for i in range(n):
        own = [f"v{rng.randrange(10**6)}" for _ in range(30)]
        rows.append((2 * i, " ".join(form[:15] + own + form[15:])))
        if i % 10 == 0:
            own[rng.randrange(30)] = "changed"
            rows.append((2 * i + 1, " ".join(form[:15] + own + form[15:])))
    return rows


def test_template(spark):
    """Candidates of a template grow with the texts, not with their square, and no link is lost."""
    rows = template(6000)
    got = nd.NearDuplicates(frame(spark, rows), n=4, threshold=0.6, hot=256)
    links = {(r.class_a, r.class_b) for r in got.links.collect()}
    want = {(i - 1, i) for i, _ in rows if i % 2}
    assert len(want) == 600 and want <= links
    assert got.candidates.count() < 4 * len(rows)  # all pairs are 3 300 a row


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(200, 100), (100, 300), (300, 200), (7, 7), (400, 401), (400, 401)]
    got = {r.node: r.group_id for r in nd.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 100, 400: 400, 401: 400}
    assert nd.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_disk(spark, monkeypatch):
    """Passes change no link, few candidates are left to check, and neither shuffles nor tables of earlier steps lie about."""
    from pathlib import Path

    from lodestack import session

    rows = template(3000)
    whole = {(r.class_a, r.class_b) for r in nd.NearDuplicates(frame(spark, rows), n=4, threshold=0.6, hot=256).links.collect()}
    monkeypatch.setattr(nd, "PASS_ROWS", 20_000)
    monkeypatch.setattr(nd, "PASS_SETS", 100)
    monkeypatch.setattr(nd, "PASS_PAIRS", 2)
    blocks, labels = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), []
    write = nd.materialize
    monkeypatch.setattr(nd, "materialize", lambda df, label, **k: labels.append(label) or write(df, label, **k))
    before, files = set(session._path_of.values()), blocks.getAllFiles().size()
    got = nd.NearDuplicates(frame(spark, rows), n=4, threshold=0.6, hot=256)
    assert {(r.class_a, r.class_b) for r in got.links.collect()} == whole and len(whole) >= 300
    assert labels.count("met") > 1 and labels.count("exact") > 1 and labels.count("links") > 1
    assert got.candidates.count() < 2 * len(whole)
    left = {p.rpartition("/")[2].partition("-")[0] for p in set(session._path_of.values()) - before if Path(p.removeprefix("file://")).exists()}
    assert not left & {"signed", "heads", "posts", "met", "sketch", "templated", "rarest", "exact", "sets"}
    assert blocks.getAllFiles().size() < files + 100
