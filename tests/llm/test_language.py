import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiokpi.llm import language as la

PARTS = {"en": ["th", "er", "on", "ing", "ed"], "fr": ["eau", "ou", "é", "oi", "tion"], "de": ["sch", "ung", "ich", "ü", "keit"]}


def sentence(rng, lang, words):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def plain(word, number, p):
    """Probability of a word: the sum over all segmentations, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for end in range(1, len(word) + 1):
        piece = number.get(word[:end], 0)
        if piece or end == 1:
            total = total + p[piece] * plain(word[end:], number, p)
    return total


@pytest.fixture(scope="module")
def table():
    return la.pieces(la.vocabulary_path())


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(lang, sentence(rng, lang, rng.randint(3, 60))) for lang in ("en", "en", "fr", "de") for _ in range(60)]
    return la.fit(spark.createDataFrame([*rows, (None, "nothing"), ("en", None)], "lang string, text string"))


@pytest.mark.parametrize("few", [0, 1000])
def test_every_piece_is_found(table, few, monkeypatch):
    monkeypatch.setattr(la, "FEW", few)
    words = ["▁thereof", "▁schulung", "▁éàü中文e", "▁zzzzqqqq", "▁therefor"]
    for size in {len(w) for w in words}:
        some = [w for w in words if len(w) == size]
        got = set()
        for start, end, rows, found in table.steps(some):
            got |= {(start, end, some[r], int(f)) for r, f in zip(np.arange(len(some))[rows], found)}
        assert got == {(s, e, w, table.number.get(w[s:e], 0)) for w in some for s in range(size) for e in range(s + 1, size + 1)
                       if w[s:e] in table.number or e == s + 1}


def test_forward_sums_all_segmentations(table):
    rng = np.random.default_rng(0)
    p = rng.random((table.size, 2))
    p /= p.sum(axis=0)
    words = ["the", "thinghere", "ö", "中文ab", "schlich", "zz"]
    want = [[np.log(plain(la.START + w, table.number, p[:, k])) for k in (0, 1)] for w in words]
    assert np.allclose(la.word_scores(words, table, p), want, rtol=1e-12)


def test_expected_counts_are_the_gradient(table):
    rng = np.random.default_rng(1)
    p = rng.random(table.size)
    p /= p.sum()
    words, n = ["thing", "other", "x" * 40], np.array([3, 1, 2])
    counts = la.expected(words, n, table, p)
    # Every letter and the mark of the start is in one piece: lengths of pieces add up to the lengths of the words.
    sizes = np.ones(table.size)
    for piece, k in table.number.items():
        sizes[k] = len(piece)
    assert np.isclose(counts @ sizes, sum((len(w) + 1) * k for w, k in zip(words, n)))
    for piece in ("th", "▁th", "x", "xx"):
        more = p.copy()
        more[table.number[piece]] *= 1 + 1e-5
        slope = (n * (la.word_scores(words, table, more[:, None]) - la.word_scores(words, table, p[:, None]))[:, 0]).sum() / 1e-5
        assert np.isclose(counts[table.number[piece]], slope, rtol=1e-3)


def test_likelihood_rises_with_every_round(spark, table):
    rng = random.Random(2)
    texts = [sentence(rng, "en", 40) for _ in range(20)]
    frame = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    words = [w for t in texts for w in la.letters(t)]
    scores = [la.word_scores(words, table, la.fit(frame, rounds=k).p).sum() for k in range(4)]
    assert scores == sorted(scores) and scores[1] > scores[0] + 1


def test_held_out_accuracy(docs, model):
    rng = random.Random(3)
    truth = [rng.choice(list(PARTS)) for _ in range(150)]
    got = la.identified(docs([sentence(rng, lang, rng.randint(2, 30)).upper() for lang in truth]), model).orderBy("doc_id").collect()
    assert sum(r.lang_pred == lang for r, lang in zip(got, truth)) >= 147
    assert all(0 <= r.score <= 1 for r in got)


def test_awkward_rows(docs, awkward, model):
    frame = docs([*awkward, (300, "123 ½ ² _ !", "s"), (301, "a" * 20_000, "s"), (302, "中文", "s")])
    rows = la.identified(frame, model).collect()
    assert len(rows) == frame.count() and set(frame.columns) < set(rows[0].asDict())
    by_id = {}
    for r in rows:
        assert by_id.setdefault((r.doc_id, r.text), (r.lang_pred, r.score)) == (r.lang_pred, r.score)
        silent = not la.LETTERS.search(r.text or "")
        assert (r.lang_pred == "und") == silent and r.score == (0 if silent else r.score)
        assert 0 <= r.score <= 1 and r.lang_pred in ("und", "en", "fr", "de")
    assert la.identified(docs([]), model).count() == 0


def test_nothing_to_learn_from(spark, docs):
    empty = la.fit(spark.createDataFrame([(None, "text")], "lang string, text string"))
    assert {tuple(r) for r in la.identified(docs(["some text", None]), empty).select("lang_pred", "score").collect()} == {("und", 0.0)}


def test_held_out_rows(spark):
    import zlib
    rows = [(k,) for k in [*range(50), None]]
    got = {r.doc_id: r.h for r in spark.createDataFrame(rows, "doc_id long").select("doc_id", la.held_out().alias("h")).collect()}
    assert got == {k: k is not None and zlib.crc32(str(k).encode()) % 4 == 2 for (k,) in rows}
