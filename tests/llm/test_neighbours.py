import numpy as np
import pytest

from radiokpi.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def frame(spark, vectors):
    return spark.createDataFrame([(int(i), v, 0, 0.0, 1) for i, v in vectors], SCHEMA)


def brute(vectors, k, every):
    out = {}
    known = {}
    for i, v in vectors:
        known.setdefault(i, []).append(np.array(v, np.float32).astype(np.float64))
    for i in known:
        if i % every == 0:
            best = [(-max(float(u @ w) for u in known[i] for w in known[j]), j) for j in known if j != i]
            out[i] = [(round(-s, 9), j) for s, j in sorted(best)[:k]]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=32).astype(np.float32).tolist()) for i in range(4500)]
    old, neighbours.ENOUGH = neighbours.ENOUGH, 600
    try:
        got = neighbours.nearest(frame(spark, vectors)).collect()
    finally:
        neighbours.ENOUGH = old
    truth = brute(vectors, 20, 20)
    rows = {}
    for r in got:
        rows.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(rows) == set(truth)
    hits = sum(len({v for _, v, _ in rows[q]} & {v for _, v in truth[q]}) for q in truth)
    assert hits / (20 * len(truth)) >= 0.9
    table = {i: np.array(v) for i, v in vectors}
    for q, found in rows.items():
        found.sort()
        assert [n for n, *_ in found] == list(range(1, 21))
        assert all(abs(table[q] @ table[v] - s) < 1e-9 for _, v, s in found)
        assert [s for *_, s in found] == sorted((s for *_, s in found), reverse=True)


def test_copies_ties_and_rows_that_take_no_part(spark):
    one, two = [1.0, 2.0, 0.5], [0.5, 1.0, 3.0]
    vectors = [(i, one) for i in range(60)] + [(i, two) for i in range(60, 70)] + [(60, two)]
    bad = [(80, None), (100, []), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 2.0]), (160, [float("nan"), 1.0, 1.0]), (180, [float("inf"), 1.0, 1.0]), (200, [1.0, 1.0])]
    got = neighbours.nearest(frame(spark, vectors + bad), k=20).collect()
    rows = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        rows.setdefault(r["query_id"], []).append((round(r["score"], 9), r["vec_id"]))
    assert rows == brute(vectors, 20, 20)


@pytest.mark.parametrize("vectors, rows", [([], 0), ([(0, [1.0, 2.0])], 0), ([(0, [1.0, 2.0]), (1, [2.0, 1.0])], 1), ([(5, None)], 0)])
def test_few_or_no_rows(spark, vectors, rows):
    assert neighbours.nearest(frame(spark, vectors)).count() == rows


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    bits = rng.random((3000, 128)) < 0.5
    bits[:1500] ^= False
    codes = np.packbits(bits, axis=1, bitorder="little").view("<u2")
    index = neighbours.Index(codes)
    for k in range(5):
        near = index.within(codes[k], 40)
        distance = (bits ^ bits[k]).sum(1)
        assert len(near) >= 40 and set(np.flatnonzero(distance <= distance[near].max())) == set(near.tolist())
