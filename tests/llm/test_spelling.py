import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from radiokpi.llm import spelling as sp


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute(texts):
    """{word: (n, n_near, form, form_n, root)} from (doc_id, text)."""
    n = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    out = {}
    for w in n:
        close = [x for x in n if near(w, x)]
        form = min(close, key=lambda x: (-n[x], x), default=None)
        if form is not None and n[form] < 10 * n[w]:
            form = None
        out[w] = (n[w], len(close), form, n.get(form))

    def root(w):
        return root(out[w][2]) if out[w][2] else w
    return {w: (*v, root(w)) for w, v in out.items()}


def run(frame, **options):
    got = sp.variants(frame, **options).collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got}


@pytest.mark.parametrize("letters, size", [("ab", 250), ("abcdé", 500), ("aÿ×", 200)])
def test_search_finds_all_pairs_once(letters, size, monkeypatch):
    monkeypatch.setattr(sp, "LISTED", 3)
    rng = random.Random(size)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(size)})
    # Queries that the index does not hold, with letters it does not know.
    strange = [w[:3] + "ß" + w[4:] for w in words[:40]] + ["ß" * 8]
    got = defaultdict(list)
    for mirrored in (True, False):
        for word, found in sp.neighbours(words, [*words, *strange], mirrored):
            got[word] += found
    want = {q: sorted(w for w in words if near(q, w)) for q in [*words, *strange]}
    assert sum(map(len, want.values())) > 10
    assert {q: sorted(w) for q, w in got.items()} == {q: w for q, w in want.items() if w}


def test_exact_search_gives_the_place_of_every_word():
    words = ["ab", "abc", "b", "ba", "bab"]
    index = sp.Index(words)
    for place, word in enumerate(words):
        low, high = 0, index.delimiters
        for letter in word[::-1]:
            code = list(index.letters).index(ord(letter))
            low, high = index.step(code, low), index.step(code, high)
        assert (index.step(0, low) - 1, index.step(0, high) - 1) == (place, place + 1)


# Budgets that keep all words in one index, make many indexes and cut single bins.
@pytest.mark.parametrize("budget", [10**6, 2000, 300])
def test_variants_equal_brute_force(docs, awkward, budget):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 12))) for _ in range(60)]
    texts = list(awkward)
    for k in range(150):
        chosen = [words[min(int(rng.expovariate(0.15)), 59)] for _ in range(25)]
        for at in rng.sample(range(25), 3):  # typing errors
            w = chosen[at]
            chosen[at] = rng.choice([w[:3] + "x" + w[4:], w[:2] + w[3:], w[:4] + "y" + w[4:], w[1:], w + "s"])
        texts.append((1000 + k, " ".join(chosen).title() + " ÀÖ×÷abcdefg " + "a" * 300, "s"))
    frame = docs(texts)
    want = brute([(t[0], t[1]) if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)])
    assert sum(v[2] is not None for v in want.values()) > 5
    assert run(frame, budget=budget) == want


def test_forms_are_followed_to_the_last(docs):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    texts = [" ".join([w] * n) for w, n in zip(chain, (2, 40, 900, 20_000))]
    want = brute(list(enumerate(texts)))
    assert want["abcdefg"][4] == "abcdefghij"
    assert run(docs(texts)) == want


def test_empty_tables(docs):
    assert run(docs([])) == {} and run(docs([None, "", "short words only", "onceonly"])) == {}
