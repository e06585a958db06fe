"""Quality classifier: naive Bayes support vectors.

N-gram indicators (one to four bytes, and how often a word follows itself) are scaled by class log-count ratios; a
linear hinge-loss model over them is fitted by dual coordinate descent, and its margins are turned into
probabilities on folds it did not see. The fit uses at most ``FIT_ROWS`` labelled rows outside the held-out fifth;
the model that goes to the executors has 2^18 weights whatever the table holds. Scores read the text alone.

Defined results: null text counts as empty and is scored like any text; without labels of both classes every score
is the share of label 1 (0.5 without labels); repeated rows get equal scores; no rows give no rows; extra columns
pass through ``scored`` untouched.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from radiokpi.llm.common import documents, text_of
from radiokpi.llm.fitting import held_out, labelled_sample

FIT_ROWS = 6000
BITS = 18
ORDERS = (1, 2, 3, 4)
EPOCHS = 10
COST = 10.0
FOLDS = 3
THRESHOLD = 0.3
# Repeats of a word are told apart up to this many.
REPEATS = 4
SLICE = 1 << 20


def features(text: bytes, marks: np.ndarray) -> np.ndarray:
    """Numbers of the indicators that are set, ascending. ``marks``: 2^BITS false flags, left so."""
    for at in range(0, max(1, len(text)), SLICE):
        # Slices overlap by the longest n-gram, so that cutting loses none.
        codes = np.frombuffer(text[max(0, at - ORDERS[-1] + 1):at + SLICE] + b"\n", np.uint8).astype(np.uint32)
        for n in ORDERS:
            if len(codes) < n:
                break
            h = np.full(len(codes) - n + 1, n * 7919, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) ^ codes[k:len(codes) - n + 1 + k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            marks[h >> np.uint32(32 - BITS)] = True
    words = text.split()
    repeats = sum(map(operator.eq, words, words[1:]))
    for k in range(min(repeats, REPEATS)):
        marks[k] = True
    found = np.flatnonzero(marks)
    marks[found] = False
    return found


@dataclass(frozen=True)
class Model:
    """margin = weight . scaled indicators / their norm + bias; score = 1 / (1 + exp(-(slope margin + shift)))."""

    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        value = self.scale[found].astype(np.float64)
        return float(self.weight[found] @ value / np.sqrt(value @ value + 1e-12) + self.bias)

    def score(self, found: np.ndarray) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.ones((2, 1 << BITS))
    for found, label in zip(rows, labels):
        counts[int(label)][found] += 1
    return np.log(counts[1] / ((labels == 1).sum() + 2)) - np.log(counts[0] / ((labels == 0).sum() + 2))


def coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; the classes weigh the same."""
    weight, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    sign = np.where(labels == 1, 1.0, -1.0)
    cost = COST * 0.5 / np.where(labels == 1, max(labels.mean(), 1e-9), max(1 - labels.mean(), 1e-9))
    values = [scale[f] / np.sqrt(scale[f] @ scale[f] + 1e-12) for f in rows]
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            slope = sign[k] * (weight[rows[k]] @ values[k] + bias) - 1.0
            new = min(max(alpha[k] - slope / 2.0, 0.0), cost[k])  # a row and the bias have norm 1 each
            if new != alpha[k]:
                weight[rows[k]] += (new - alpha[k]) * sign[k] * values[k]
                bias += (new - alpha[k]) * sign[k]
                alpha[k] = new
    return weight, bias


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over margins, by Newton steps on smoothed targets."""
    target = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    beta = np.array([1.0, np.log((labels.sum() + 1) / ((1 - labels).sum() + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * beta)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-6), float(beta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    share = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        shift = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 1.0, shift)
    fold = np.arange(len(rows)) % FOLDS
    margins = np.zeros(len(rows))
    for k in range(FOLDS):
        seen = np.flatnonzero(fold != k)
        if len(set(labels[seen].tolist())) < 2:
            continue
        scale = log_ratios([rows[i] for i in seen], labels[seen])
        weight, bias = coordinate_descent([rows[i] for i in seen], labels[seen], scale)
        part = Model(scale, weight, bias, 1.0, 0.0)
        margins[fold == k] = [part.margin(rows[i]) for i in np.flatnonzero(fold == k)]
    scale = log_ratios(rows, labels)
    weight, bias = coordinate_descent(rows, labels, scale)
    slope, shift = sigmoid_fit(margins, labels)
    return Model(scale.astype(np.float32), weight.astype(np.float32), bias, slope, shift)


def trained(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model of at most ``rows`` labelled documents; their indicators are found on the executors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << BITS, bool)
        for batch in batches:
            found = [features(t, marks).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], names=["doc_id", "found", "label"])

    sample = labelled_sample(docs, labels, "quality", rows)
    got = sample.select("doc_id", F.encode("text", "UTF-8").alias("text"), "label").mapInArrow(run, "doc_id long, found binary, label int").collect()
    got.sort(key=lambda r: r[0])
    return fit([np.frombuffer(r[1], "<i4") for r in got], np.array([r[2] for r in got], np.int64))


def score_column(spark: SparkSession, model: Model, text: str = "text") -> Column:
    shared = spark.sparkContext.broadcast(model)  # two arrays of 2^BITS floats

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        marks = np.zeros(1 << BITS, bool)
        for some in texts:
            yield pd.Series([shared.value.score(features(t, marks)) for t in some], dtype="float64")

    return score(F.encode(text_of(text), "UTF-8"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with the columns they came with."""
    return docs.where(score_column(docs.sparkSession, trained(docs, labels)) >= threshold)


def op2_quality(spark: SparkSession, directory: str) -> DataFrame:
    docs = documents(spark, directory)
    model = trained(docs, spark.read.parquet(f"{directory}/labels.parquet"))
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(spark, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op2_quality": op2_quality}
