"""Ciphers, and garbled text whose original is known because the test garbled it."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from lodestack.llm import ciphers, codepages, mojibake

SF = "/root/testdata/sf0.01"
ROWS = "src_field string, rec_id bigint, text string, source string"


@pytest.fixture(scope="module")
def samples():
    return duckdb.sql(f"select sample_id, lang, text from '{SF}/lang_sample.parquet' order by sample_id").fetchall()


@pytest.fixture(scope="module")
def documents():
    """Texts the operator's settings were not chosen on."""
    return duckdb.sql(f"select doc_id, lang, text from '{SF}/documents.parquet' where length(text) between 200 and 4000 order by doc_id").fetchall()


@pytest.fixture(scope="module")
def lang(spark, samples):
    return spark.createDataFrame([(i, t) for i, _, t in samples], "sample_id int, text string")


def permuted(letters, seed):
    """A page nobody has listed: each letter shown as some other sign of the same set."""
    signs = list(letters)
    random.Random(seed).shuffle(signs)
    return str.maketrans("".join(letters), "".join(signs))


def test_cipher_from_nothing(samples):
    """Random starts find most of an alphabet from bigrams alone; a start that is half wrong is put right."""
    language = mojibake.Language([t for *_, t in samples])
    words = re.findall(r"[а-яё]+", " ".join(t for _, c, t in samples if c == "ru").lower())
    letters = sorted(set("".join(words)))
    signs = {c: chr(0x2500 + k) for k, c in enumerate(letters)}
    halves: tuple = ({}, {})
    seen = Counter("".join(words))
    for k, w in enumerate(words):
        for a, b in mojibake._bound([signs[c] for c in w]):
            halves[k & 1][a, b] = halves[k & 1].get((a, b), 0) + 1
    found = ciphers.break_open(halves, {" "}, mojibake.alphabets(language), language)
    right = sum(n for c, n in seen.items() if found.table[signs[c]].lower() == c)
    assert right >= 0.95 * sum(seen.values())
    init = {s: c for c, s in signs.items()}
    wrong = dict(init)
    for a, b in zip("онре", "нроё"):
        wrong[signs[a]] = b
    again = ciphers.learn(halves, wrong, {" "}, letters, language)
    assert all(again.table[signs[c]] == c for c in "онре") and len(again.changed) >= 4
    kept = ciphers.learn(halves, init, {" "}, letters, language)
    assert all(kept.table[signs[c]] == c for c in letters if seen[c] > 20)
    assert ciphers.break_open(({}, {}), {" "}, [letters], language) is None


def test_unlisted_page_is_restored(spark, lang, documents):
    """A source in which every text went through a page nobody knows; its neighbour is clean."""
    russian = [(d, t) for d, c, t in documents if len(re.findall("[а-яё]", t)) > 0.5 * len(t)][:60]
    lower = [chr(c) for c in range(0x430, 0x450)]
    swap = permuted(lower, 4) | permuted([c.upper() for c in lower], 4)
    rows = [("t", d, t.translate(swap), "/old/disk") for d, t in russian] + [("t", 10**6 + d, t, "/new/disk") for d, _, t in documents]
    df = spark.createDataFrame(rows, ROWS)
    reader = mojibake.learn(df, lang)
    assert set(reader.broken) == {"/old/disk"}
    out = {r.rec_id: r.restored for r in mojibake.restored(df, reader).collect()}
    assert {k for k in out if k < 10**6} == {d for d, _ in russian}
    pairs = [(a.lower(), b.lower()) for d, t in russian for a, b in zip(out[d], t) if "а" <= b.lower() <= "я"]
    assert sum(a == b for a, b in pairs) >= 0.97 * len(pairs)


SWAPS = [("cp1252", "utf-8"), ("cp437", "utf-8"), ("cp1251", "utf-8"), ("mac-roman", "utf-8"), ("mac-roman", "cp1252"), ("cp437", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1252", "cp1251"), ("cp1252", "gbk"), ("cp1252", "cp932"), ("gbk", "utf-8"), ("cp932", "utf-8")]


def garble(word, read, written):
    try:
        raw = word.encode(written)
        if read in codepages.WIDE:
            shown = raw.decode(read)
        else:
            back = {b: c for c, b in reversed(codepages.to_byte(read).items())}
            shown = "".join(back[b] for b in raw)
    except (UnicodeError, KeyError):
        return None
    return shown if shown != word else None


def test_held_out_words(spark, lang, documents):
    """One or several words of documents garbled by known swaps: found, and nothing else."""
    rng = random.Random(12)
    rows, truth = [], {}
    for k, (d, _, text) in enumerate(documents):
        if k % 3 == 0:
            read, written = SWAPS[(k // 3) % len(SWAPS)]
            words = [m for m in re.finditer(r"[^\W\d_]{4,}", text) if not m[0].isascii()]
            rng.shuffle(words)
            for m in sorted(words[: 1 + k % 4], key=lambda m: -m.start()):
                shown = garble(m[0], read, written)
                if shown:
                    truth.setdefault(d, text)
                    text = text[: m.start()] + shown + text[m.end() :]
        rows.append(("t", d, text, ""))
    df = spark.createDataFrame(rows, ROWS)
    out = {r.rec_id: r.restored for r in mojibake.restored(df, mojibake.learn(df, lang)).collect()}
    found = len(out.keys() & truth.keys())
    print("held out:", len(truth), "garbled,", len(out), "named,", found, "both,", sum(out[d] == truth[d] for d in out.keys() & truth.keys()), "restored whole")
    given = {r[1]: r[2] for r in rows}

    def around(d, one, other):
        i = next(i for i, (a, b) in enumerate(zip(one, other)) if a != b)
        return given[d][max(0, i - 12) : i + 25]

    print("missed:", [around(d, truth[d], given[d]) for d in truth.keys() - out.keys()])
    print("false:", [around(d, given[d], out[d]) for d in out.keys() - truth.keys()])
    assert found >= 0.95 * len(truth) and found >= 0.97 * len(out)


def test_lists_of_letters_stay(spark, lang, samples):
    """Short runs of capitals read as words of other pages, all the more where those pages occur."""
    bad = ["ñâîäêà", "îò÷¸ò", "НРВ╦Р", "ЯЮД АЧДФЕР"]
    good = ["Größenübersicht ÄÖÜ ß µ ° ± ½.", "Âge, Île, Œuvre, À ÉÊË.", "AÇÃO E REAÇÃO: SÃO NÃO Ã.", "├── plan │ └── copy ██ ok.", "ÀÉÎÕÜ test 1781.txt", "ЪЕМ 1790.docx"]
    rows = [("t", i, t, "") for i, t in enumerate(bad)] + [("t", 100 + i, t, "") for i, t in enumerate(good * 40)] + [("t", 1000 + i, t, "") for i, _, t in samples]
    df = spark.createDataFrame(rows, ROWS)
    out = {r.rec_id: r.restored for r in mojibake.restored(df, mojibake.learn(df, lang)).collect()}
    assert out == dict(enumerate(["сводка", "отчёт", "отчёт", "сад бюджет"]))


def test_what_is_lost_is_marked(spark, lang):
    rows = [("t", 1, "the summary âforâ Kabema", ""), ("t", 2, "濂戠磩銉嗐儶銉 175x", ""), ("t", 3, "an âge of crânes", ""), ("t", None, "cafÃ©", None), ("t", 4, None, None), ("t", 5, "cafÃ©", None), ("t", 5, "cafÃ©", None)]
    df = spark.createDataFrame(rows, ROWS)
    out = {r.rec_id: r for r in mojibake.restored(df, mojibake.learn(df, lang)).collect()}
    assert set(out) == {1, 2, 5}
    assert out[1].restored == "the summary �for� Kabema" and out[1].n_lost == 2
    assert out[2].restored.startswith("契約テリ�") and out[2].n_lost == 1 and out[5].restored == "café"


def test_all_samples_count(spark, samples):
    """The bigrams come from every row of the samples, however many there are, and are those of the texts in one piece."""
    texts = [t for *_, t in samples] + [f"line {k} of many" for k in range(4500)] + [f"{'ж' * (k % 5)}ук ŵ 한글 İ 㐀" for k in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "sample_id int, text string").repartition(7)
    got = mojibake.learn(spark.createDataFrame([], ROWS), df).language
    want = mojibake.Language(texts)
    assert got.letters == want.letters and {"ж", "ŵ"} <= set(got.letters)
    assert (got.table == want.table).all() and (got.share == want.share).all()
    pair = [got.letters["l"], got.letters["i"]]
    counted = sum((" " + t + " ").count("l") for t in texts), sum(t.count("li") for t in texts)
    few = mojibake.Language(texts[:400])
    assert counted[0] > 4500 and abs(got.table[pair[0], pair[1]] - np.log(counted[1] / counted[0])) < 0.05 < abs(few.table[few.letters["l"], few.letters["i"]] - got.table[pair[0], pair[1]])
