import re
from collections import Counter, defaultdict

import pytest

from radiokpi.llm import collocations as co


def brute(texts, least, top):
    """{(lang, phrase): (a, l, r, n, score)} by rank, from (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, count in f.items():
        rows = []
        for phrase, a in count.items():
            if len(phrase) < 2 or a < least:
                continue
            longer = [p for p in ([*count] if len(phrase) == 2 else []) if len(p) == 3 and (p[:2] == phrase or p[1:] == phrase)]
            if any(100 * count[p] >= 50 * a for p in longer if count[p] >= least):
                continue
            cuts = [(1000000 * a * a // (count[phrase[:k]] * count[phrase[k:]]), k, count[phrase[:k]], count[phrase[k:]]) for k in range(1, len(phrase))]
            score, _, l, r = min(cuts)
            rows.append((-score, -a, " ".join(phrase).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def run(frame, **options):
    return sorted(map(tuple, co.collocations(frame, **options).collect()))


# Budgets that keep everything in one group, extend some prefixes and extend most to the full depth.
@pytest.mark.parametrize("budget", [10**6, 2000, 300])
def test_equals_counting_all_phrases(docs, awkward, budget):
    texts = [*awkward, "A b\tc. a B c! a b c;a b\nc a b c \x0ba\x85b z", "x  y" * 30, "one.two three, four " * 15, "Én ÉN é\x00 \x1f ß"]
    frame = docs([t if isinstance(t, tuple) else (200 + k, t, "s") for k, t in enumerate(texts)])
    expected = brute([("en", t[1] if isinstance(t, tuple) else t) for t in texts], 3, 50)
    assert len(expected) == 50
    assert run(frame, least=3, top=50, budget=budget) == expected


def test_languages_apart_null_is_und(spark):
    rows = [(k, ["p q", "P q r", None, "q p q p"][k % 4], [None, "und", "en", "de"][k % 4]) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    expected = brute([(lang, text) for _, text, lang in rows], 5, 2000)
    assert {r[0] for r in expected} == {"und", "de"}
    assert run(frame, least=5) == expected


def test_empty_tables(docs, spark):
    assert run(docs([])) == [] and run(docs([None, "", " . ", "one"])) == []


def test_long_texts_are_cut_between_words_only(docs, monkeypatch):
    monkeypatch.setattr(co, "SLICE", 37)
    monkeypatch.setattr(co, "STRETCH", 100)
    text = "alpha beta gamma, delta epsilon. " * 60 + "w" * 500
    assert run(docs([text, text]), least=5) == brute([("en", text)] * 2, 5, 2000)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10**12 + 1
    rows = [("en", "a", "", "", big + 7), ("en", "b", "", "", big), ("en", "a", "b", "", big - 3)]
    nodes = spark.createDataFrame(rows, "lang string, w1 string, w2 string, w3 string, f long")
    got = co.scored(nodes).collect()
    assert [(r.a, r.l, r.r, r.score) for r in got] == [(big - 3, big + 7, big, 1000000 * (big - 3) ** 2 // ((big + 7) * big))]


def test_a_group_holds_its_suffixes_in_little_memory():
    import tracemalloc

    import numpy as np

    from radiokpi.llm.collocations import Subtree

    random = np.random.default_rng(0)
    words = [b"w%d" % k for k in range(1000)]
    tree = Subtree()
    tree.numbers.update({w: k + 1 for k, w in enumerate(words)})
    tracemalloc.start()
    for _ in range(30):
        tree.add(words, [random.integers(1, 1001, 50_000).astype(np.int32) for _ in range(3)], np.ones(50_000, np.int64))
    tree.settle()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
    total = sum(b["f"][i].as_py() for b in tree.nodes("x", [], 1) for i in range(b.num_rows) if b["w2"][i].as_py() == "")
    assert total == 30 * 50_000
