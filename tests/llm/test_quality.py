import random
import zlib

import numpy as np

from radiokpi.llm import quality
from radiokpi.llm.fitting import labelled_sample
from tests.llm.conftest import sentence


def table(n=400):
    rng = random.Random(9)
    texts, labels = [], []
    for k in range(n):
        text = sentence(rng, rng.randint(3, 80))
        good = k % 4 != 0
        if not good:
            text = (text.upper().replace(" ", "!! "), " | ".join(text.split()), " ".join(w + " " + w for w in text.split()))[k % 3]
        texts.append(text)
        labels.append((k, int(good), 0))
    return texts, labels


def test_features_are_the_ngrams_of_the_whole_text():
    marks = np.zeros(1 << quality.BITS, bool)
    text = ("abc de " * 30).encode()
    short = quality.features(text, marks)
    assert not marks.any() and set(short) == set(quality.features(text * 3, marks))
    old, quality.SLICE = quality.SLICE, 16
    try:
        cut = quality.features(text, marks)
    finally:
        quality.SLICE = old
    # A slice ends with a line break of its own, so only indicators with that break may be added.
    assert set(short) <= set(cut)
    assert len(quality.features(b"", marks)) >= 1


def test_held_out_accuracy_and_empty_texts(spark, docs):
    texts, labels = table()
    frame = docs([*texts, None, ""])
    known = spark.createDataFrame([*labels, (5, 1, 0), (9999, 0, 0), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.trained(frame, known)
    scores = {r[0]: r[1] for r in frame.select("doc_id", quality.score_column(spark, model)).collect()}
    assert len(scores) == len(texts) + 2 and all(0 <= s <= 1 for s in scores.values())
    held = [(scores[d], q) for d, q, _ in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.93
    kept = quality.kept(frame, known)
    assert kept.columns == frame.columns
    assert kept.count() == sum(s >= quality.THRESHOLD for s in scores.values())


def test_no_held_out_label_is_read(spark, docs):
    texts, labels = table()
    sample = labelled_sample(docs(texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "quality", 100).collect()
    assert len(sample) == 100 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in sample)


def test_one_class_or_no_labels(spark, docs):
    schema = "doc_id long, quality int, toxic int"
    frame = docs(["a b", None])
    for rows, score in (([], 0.5), ([(0, 1, 0)], 1.0)):
        model = quality.trained(frame, spark.createDataFrame(rows, schema))
        got = [r[0] for r in frame.select(quality.score_column(spark, model)).collect()]
        assert all(abs(s - score) < 1e-3 for s in got)
    assert quality.kept(docs([]), spark.createDataFrame([], schema)).count() == 0


def test_coordinate_descent_reaches_the_hinge_optimum(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 400)  # until it has converged
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(20, 6, replace=False)) for _ in range(60)]
    labels = np.array([int(r[0] < 2) for r in rows])
    scale = np.ones(1 << quality.BITS)
    weight, bias = quality.coordinate_descent(rows, labels, scale)
    sign = np.where(labels == 1, 1.0, -1.0)
    cost = quality.COST * 0.5 / np.where(labels == 1, labels.mean(), 1 - labels.mean())

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(c * max(0, 1 - s * (w[r].sum() / np.sqrt(6) + b)) for c, s, r in zip(cost, sign, rows))

    best = loss(weight, bias)
    for _ in range(200):
        step = np.zeros_like(weight)
        step[:20] = rng.normal(size=20) * 0.05
        assert loss(weight + step, bias + rng.normal() * 0.05) > best * 0.999
