import re

import pytest
from hypothesis import given, settings, strategies as st

from radiokpi.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GOOD, OTHER = "4539578763621486", "4485275742308327"


def digits(text):
    return re.sub("[^0-9]", "", text)


def passes(number):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def by_pattern(text):
    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and passes(digits(m.group()))],
        [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "x@y.z", ".", "-", "+1", " ", "(", ")", "12", "255", "300", "1.2.3.4", GOOD, "é", "\U0001f600", "\n", "0" * 5]), max_size=14))
def test_base_spans_against_the_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == by_pattern(text)


def test_very_long_runs_take_linear_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000 + ".", "1." * 100_000, "@" * 100_000, "+" * 100_000, "9" * 5000 + ".1.1.1"):
        pii.base_spans(text)
        pii.tokens_of(text)


@pytest.fixture(scope="module")
def texts():
    out = []
    for k in range(200):
        number = GOOD if k % 3 else "4539578763621487"
        out.append(f"word more {number} than a.{k}@mail.example.com and +1 (555) 555-0{100 + k} from 10.{k}.3.4 then {k} or {k}.{k} end")
    return out


def test_the_field_finds_what_the_patterns_break(texts):
    field = pii.fit(texts)
    odd = [f"here {GOOD} {OTHER} there {GOOD} again", "plain 12 words 3.4", f"number 1234567812345678 stays {GOOD}"]
    base = [pii.base_spans(t) for t in odd]
    assert base[0][2] == [(odd[0].rindex(GOOD), odd[0].rindex(GOOD) + 16)]
    more = pii.added_spans(odd, field, base)
    assert more[0][2] == [(5, 21), (22, 38)]
    assert more[1] == [[], [], [], []] and more[2] == [[], [], [], []]


def test_messages_on_a_tree_are_exact():
    import itertools
    import numpy as np

    rng = np.random.default_rng(0)
    field = pii.Field(rng.normal(size=(len(pii.NAMES), pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)), np.eye(pii.LABELS))
    x = (rng.random((3, len(pii.NAMES))) < 0.3).astype(float)
    graph = pii.Graph(x, np.array([[0, 1]]), np.array([[1, 2]]), [])
    score, total = x @ field.unary, np.zeros((3, pii.LABELS))
    for labels in itertools.product(range(pii.LABELS), repeat=3):
        p = np.exp(sum(score[k, label] for k, label in enumerate(labels)) + field.chain[labels[0], labels[1]] + field.skip[labels[1], labels[2]])
        for k, label in enumerate(labels):
            total[k, label] += p
    assert np.allclose(field.marginals(graph, 40), total / total.sum(1, keepdims=True), atol=1e-6)


def test_masking_awkward_rows_and_no_rows(docs, awkward, texts):
    frame = docs([*[t if isinstance(t, tuple) else (k, t, "s") for k, t in enumerate(awkward)], (500, texts[1], "s"), (500, texts[1], "s")])
    got = pii.masked(frame)
    assert got.columns == frame.columns and got.count() == frame.count()
    rows = got.where("doc_id = 500").collect()
    assert len(rows) == 2 and all("@" not in r["text"] and "[EMAIL]" in r["text"] and r["n_chars"] == len(r["text"]) for r in rows)
    assert got.where("text is null").count() == 1
    assert pii.masked(docs([])).count() == 0
    assert pii.mask("ab cd", [[(0, 2)], [(1, 4)], [], []]) == "[EMAIL]d"
