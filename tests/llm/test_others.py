"""Garbled text, packing, leaks and languages."""

import random

import duckdb
import numpy as np
import pytest
from lodestack.llm import bytenet, codepages, langid, leaks, mojibake, packing
from lodestack.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def samples():
    return duckdb.sql(f"select sample_id, lang, text from '{SF}/lang_sample.parquet' order by sample_id").fetchall()


# --- garbled text -------------------------------------------------------------


def test_pages_round_trip():
    for read, written, text in (("cp1252", "utf-8", "résumé"), ("cp437", "utf-8", "übung"), ("cp1252", "cp1251", "сводка"), ("koi8-r", "cp1251", "отчёт"), ("mac-roman", "cp1252", "réunion"), ("cp1252", "gbk", "合同课程"), ("cp932", "euc-jp", "ノート")):
        raw = text.encode(written)
        shown = raw.decode(read, "strict") if read in codepages.WIDE else "".join({b: c for c, b in reversed(codepages.to_byte(read).items())}[b] for b in raw)
        assert shown != text and codepages.reread(shown, read, written) == text
    assert codepages.reread("plain", "cp1252", "utf-8") is None and codepages.reread("日本", "cp1252", "utf-8") is None


def test_garbled(spark, samples):
    clean = [(100 + i, t) for i, _, t in samples[:200]]
    odd = ["Đường phố", "Łódź żółw", "Σχέδιο", "m² plan", "™ list", "µm ° ‰", "Þórðarhús", "Âge", "REUNIÃO Nº", "ﾛﾎﾟｹﾍﾞ ｶﾞｲﾄﾞ", "budget plan", "├── plan\n└── copy", "", None, "été", "π±½", "ÀÉÎÕÜ test", "x" * 100_000]
    bad = {1: "rÃ©sumÃ©.pdf", 2: "РѕС‚РїСѓСЃРє", 3: "ñâîäêà Îðæàêà", 4: "┬½├╝bung┬╗ ├╝bungen", 5: "ºÏÍ¬¿Î³Ì", 6: "jard�n", 7: "pÃƒÂ©riode posÃƒÂ©es", 8: "╨╝╤Г╨╖╤Л╨║╨░"}
    rows = [("t", i, t) for i, t in clean] + [("t", 1000 + i, t) for i, t in enumerate(odd)] + [("t", i, t) for i, t in bad.items()] + [("t", 1, bad[1]), ("t", None, bad[1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "src_field string, rec_id bigint, text string, restored int")
    lang = spark.createDataFrame([(i, t) for i, _, t in samples], "sample_id int, text string")
    out = {r.rec_id: r for r in mojibake.restored(df, mojibake.learn(df, lang)).collect()}
    assert set(out) == set(bad)
    assert [out[k].restored for k in (1, 2, 3, 5, 7, 8)] == ["résumé.pdf", "отпуск", "сводка Оржака", "合同课程", "période posées", "музыка"]
    assert (out[6].restored, out[6].n_lost) == ("jard�n", 1)
    empty = df.limit(0)
    assert mojibake.restored(empty, mojibake.learn(empty, lang)).count() == 0


def test_accents_read_in_wide_pages(spark, samples):
    """Common Han and kana inside Latin words, and Han that stand for Cyrillic letters."""
    bad = ["f茅rias_carta44.docx", "lecci贸n_borrador.pdf", "reuni贸nlecci贸n82.zip", "r茅unionfacture 176e.pdf", "w盲hrend des Fr眉hjahrsputzes", "ser谩 a pr贸pria", "斜械蟹 写芯屑邪"]
    good = ["férias_carta44.docx", "lección_borrador.pdf", "reuniónlección82.zip", "réunionfacture 176e.pdf", "während des Frühjahrsputzes", "será a própria", "без дома"]
    clean = ["PDF文件", "A4纸", "报告final版.docx", "documentation_final版.pdf", "笔记 瑾泉.apk", "T恤 和 K歌", "謝謝 第 3 章", "Excelの表", "カードk12"]
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(bad + clean)], "src_field string, rec_id bigint, text string")
    lang = spark.createDataFrame([(i, t) for i, _, t in samples], "sample_id int, text string")
    out = {r.rec_id: r.restored for r in mojibake.restored(df, mojibake.learn(df, lang)).collect()}
    assert out == dict(enumerate(good))
    reader = mojibake.Reader(mojibake.Language([t for *_, t in samples]))
    for page in ("gbk", "cp932", "big5", "euc-jp"):
        for word in ("während", "reunião"):
            shown = codepages.decode(word.encode(), page)
            if shown is not None:
                assert reader.suspects([shown]) and reader.read([shown])[0][0].text == word
    assert reader.read(["B黵o"])[0][0].text == "Büro"  # no sequence of UTF-8 is whole in it


# --- packing ---------------------------------------------------------------------


def test_fullest_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        stock = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(6)}
        room = rng.randrange(0, 90)
        best = {0}
        for k, n in stock.items():
            best |= {b + k * j for b in best for j in range(1, n + 1)}
        taken = packing.fullest(stock, sorted(stock, reverse=True), room)
        assert sum(k * n for k, n in taken.items()) == max(b for b in best if b <= room)
        assert all(n <= stock[k] for k, n in taken.items())


def first_fit(sizes, cap):
    """Containers that first fit in decreasing order takes."""
    room: list[int] = []
    for n in sorted(sizes, reverse=True):
        k = next((k for k, r in enumerate(room) if r >= n), len(room))
        if k == len(room):
            room.append(cap)
        room[k] -= n
    return len(room)


def test_pack(spark):
    rng = random.Random(6)
    lengths = [(i, rng.choice([rng.randrange(1, 60), 7, 7, 250, 100])) for i in range(900)] + [(2000, 0), (None, 5), (2001, None)]
    df = spark.createDataFrame([(i, n, 1) for i, n in lengths], "doc_id bigint, n_tokens bigint, container int")
    out = packing.pack(df, [(1, 100), (2, 64)]).toPandas()
    for spec, cap in ((1, 100), (2, 64)):
        own = out[out.spec_id == spec]
        fill = own.groupby("container").n_tokens.sum()
        assert fill.max() <= cap and sorted(fill.index) == list(range(len(fill)))
        total = sum(n for i, n in lengths if i is not None and n)
        assert own.n_tokens.sum() == total and len(fill) <= first_fit(own.n_tokens.tolist(), cap)
        by = own.groupby("doc_id")
        want = {i: n for i, n in lengths if i is not None and n}
        assert by.n_tokens.sum().to_dict() == want
        assert all(len(g) == -(-want[i] // cap) for i, g in by)  # split only where it must be
        cut = own.sort_values(["doc_id", "piece"])
        assert (cut.start_token == cut.piece * cap).all()
    assert packing.pack(df.limit(0), [(1, 100)]).count() == 0 and packing.pack(df, []).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, [(1, 0)])
    with pytest.raises(ValueError):
        packing.pack(df, [(1, 5), (1, 6)])


def test_measured(spark):
    docs = spark.createDataFrame([(1, "the plan", 0), (2, "", 0), (3, None, 0), (None, "x", 0), (4, "报告 <|endoftext|>" * 3000, 0), (1, "the plan", 0)], "doc_id bigint, text string, n_tokens int")
    out = {r.doc_id: r.n_tokens for r in packing.token_lengths(docs).collect()}
    assert set(out) == {1, 2, 4} and out[2] == 0 and out[1] == 2 and out[4] > 9000


# --- leaks ------------------------------------------------------------------------


def naive_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    run = max((n for i in range(len(a)) for j in range(len(b)) for n in [next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))]), default=0)
    return int(h.max()), run


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 18)), rng.integers(0, 4, rng.integers(1, 25))
        assert leaks.align(a, b) == naive_align(a.tolist(), b.tolist())


def test_leaks(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"v{k}" for k in range(300)]
    passage = [[rng.choice(words) for _ in range(60)] for _ in range(6)]
    zh = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(90))
    items = [(k, "en", " ".join(p)) for k, p in enumerate(passage)] + [(10, "zh", zh), (11, "en", " ".join(passage[0])), (12, "en", "too short"), (13, "en", None), (None, "en", "x"), (14, None, " ".join(passage[1])), (0, "en", " ".join(passage[0]))]
    noise = lambda n: [f"q{rng.randrange(300)}" for _ in range(n)]
    docs = [
        (1, " ".join(noise(50) + passage[0][5:25] + noise(50))), (2, " ".join(noise(50) + passage[0][5:24] + noise(50))), (3, " ".join(w.upper() for w in passage[1])),
        (4, "前" + zh[10:50] + "后"), (5, "前" + zh[10:49] + "后"), (6, " ".join(noise(400))), (7, ""), (8, None), (None, " ".join(passage[2])),
        (9, " ".join(passage[2][:30] + ["edit"] + passage[2][31:])), (20, " ".join(noise(30_000) + passage[3] + noise(3000))), (21, " ".join("z" if k % 19 == 18 else w for k, w in enumerate(passage[4]))),
        (3, " ".join(w.upper() for w in passage[1])),
    ]
    D = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, item_id int")
    E = spark.createDataFrame([(*r, 0) for r in items], "item_id int, lang string, passage string, doc_id int")
    want = {(1, 0), (1, 11), (3, 1), (3, 14), (4, 10), (9, 2), (20, 3)}
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(D, E).collect()} == want
    edited = leaks.leaks(D, E).where("doc_id = 21 and item_id = 4").collect()
    assert edited and edited[0].run == 18 and edited[0].share > 0.8  # an edited copy is scored, not counted
    monkeypatch.setattr(leaks, "BLOCK_TOKENS", 900)
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(D, E).collect()} == want
    assert leaks.leaked(D.limit(0), E).count() == 0 and leaks.leaked(D, E.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leaks.leaks(D, E, default_need=5)


# --- languages -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def net(samples):
    train = [s for k, s in enumerate(samples) if k % 4]
    return bytenet.ByteNet(sorted({c for _, c, _ in train})).fit([t for *_, t in train], [c for _, c, _ in train])


def test_held_out(net, samples):
    held = [s for k, s in enumerate(samples) if k % 4 == 0]
    right = sum(max(f, key=lambda x: x[2])[3] == c for (_, c, _), f in zip(held, langid.judge(net, [t for *_, t in held])) if f)
    assert right / len(held) > 0.95


def test_tables_agree_with_the_filters(net):
    rng = np.random.default_rng(1)
    x = rng.integers(1, 256, (50, bytenet.WINDOW)).astype(np.uint8)
    e = net.emb[x]
    feats = []
    for w in bytenet.WIDTHS:
        cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * bytenet.DIM)
        feats.append((cols @ net.filters[w]).max(1) + net.bias[w])
    z = np.maximum(np.concatenate(feats, 1), 0) @ net.out + net.out_bias
    exact = z - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) - z.max(1, keepdims=True)
    assert np.abs(np.exp(exact) - np.exp(net.log_probs(x))).max() < 0.2


def test_gradient():
    net = bytenet.ByteNet(["a", "b"])
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 255, (6, bytenet.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    keep = np.ones((6, len(bytenet.WIDTHS) * bytenet.FILTERS), np.float32)
    _, grads = net._step(x, y, keep)
    for p, g in zip(net._params(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, step = p[at], 1e-3
        p[at] = before + step
        up = net._step(x, y, keep)[0]
        p[at] = before - step
        down = net._step(x, y, keep)[0]
        p[at] = before
        assert abs((up - down) / (2 * step) - g[at]) < 0.02 + 0.1 * abs(g[at])


def test_windows_cover_everything():
    data = bytes(range(1, 251)) * 3
    starts, ends = np.array([0, 10, 10, 74]), np.array([10, 10, 74, 700])
    x, piece, held = bytenet.windows(data, starts, ends)
    for k in range(4):
        covered = set()
        at = starts[k]
        for w, h in zip(x[piece == k], held[piece == k]):
            assert bytes(w[: max(h, 0)]) == data[at : at + max(h, 0)] and not w[max(h, 0) :].any()
            covered |= set(range(at, at + h))
            at += bytenet.STEP
        assert covered == set(range(starts[k], ends[k]))


def test_labels_and_segments(spark, net, samples):
    by = {c: [t for _, k, t in samples if k == c] for c in net.labels}
    whole = lambda c, n: " ".join(t for t in by[c] if t.rstrip().endswith((".", "。")))[: 10**6] if n is None else " ".join([t for t in by[c] if t.rstrip().endswith((".", "。"))][:n])
    docs = [
        (1, whole("en", 6), "en"), (2, whole("en", 6), "EN-gb"), (3, whole("de", 6), "und"), (4, whole("de", 6), None), (5, whole("fr", 6), "es"),
        (6, whole("en", 5) + "\n\n" + whole("ru", 5), "en"), (7, whole("ja", 6), "Japanese"), (8, "Annual Budget\n" + whole("zh", 6), "zho"), (9, "AB-12\t3\nCD-34\t5", None),
        (10, "", "en"), (11, None, "en"), (None, whole("pt", 6), None), (12, whole("pt", 6), "it"), (3, whole("de", 6), "und"), (13, whole("es", None), " "),
    ]
    df = spark.createDataFrame([(i, t, c, 0.5) for i, t, c in docs], "doc_id bigint, text string, lang string, confidence double")
    got = {(r.doc_id, r.lang) for r in langid.wrong_labels(df, net).collect()}
    assert got == {(3, "de"), (4, "de"), (5, "fr"), (6, "en"), (6, "ru"), (12, "pt"), (13, "es")}
    seg = [r for r in langid.language_segments(df, net).where("doc_id = 6").orderBy("segment").collect()]
    assert [s.lang for s in seg] == ["en", "ru"] and all(0.9 < s.confidence <= 1 for s in seg) and seg[0].end <= seg[1].start
    assert langid.wrong_labels(df.limit(0), net).count() == 0 and langid.document_languages(df.limit(0), net).count() == 0
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame([], "sample_id int, lang string, text string"))


# --- whole queries -------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).limit(5).count() > 0
