"""Toxicity by a classifier chain.

Categories are predicted one after another; each linear (logistic) model sees word indicators and the log-odds that
earlier models gave, out of fold while training. The first categories are kinds of abuse: a labelled toxic document
belongs to a kind if it uses a word of that kind's family (``FAMILIES``, a parameter); the last category is the label
``toxic`` itself. The fit uses at most ``FIT_ROWS`` labelled rows and ``VOCABULARY`` words, the words that tell toxic
from other documents best; scoring looks at every word of every whole text.

Defined results: null text counts as empty; without labels of both classes probabilities are the share of the
category (0.5 without labels); repeated rows get equal results; no rows give no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from radiokpi.llm.common import documents, text_of
from radiokpi.llm.fitting import labelled_sample

FIT_ROWS = 6000
VOCABULARY = 300
LEAST = 5
FOLDS = 5
RIDGE = 1.0
THRESHOLD = 0.5
LAST = "toxic"
FAMILIES = {
    "insult": ("idiot", "moron", "stupid", "clown", "loser"),
    "contempt": ("trash", "scum", "worthless", "pathetic", "disgusting"),
}
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights (last: intercept, not shrunk) of a ridge logistic model by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    if len(y):
        beta[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if not len(y) or y.min() == y.max():
        return beta
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * beta)
        beta = beta - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass(frozen=True)
class Chain:
    """``weights[k]``: vocabulary, the log-odds of the categories before ``k``, intercept."""

    vocabulary: dict[str, int]
    categories: tuple[str, ...]
    weights: tuple[np.ndarray, ...]

    def probabilities(self, text: str) -> list[float]:
        found = [self.vocabulary[w] for w in words_of(text) & self.vocabulary.keys()]
        size, odds = len(self.vocabulary), []
        for weight in self.weights:
            odds.append(float(np.clip(weight[found].sum() + weight[size:-1] @ np.array(odds) + weight[-1], -30, 30)))
        return [1 / (1 + float(np.exp(-z))) for z in odds]


def fit_chain(texts: list[str], toxic: np.ndarray, families: dict = FAMILIES) -> Chain:
    rows = [words_of(t) for t in texts]
    count = {c: Counter(w for r, y in zip(rows, toxic) if y == c for w in r) for c in (0, 1)}
    size = {c: max(1, int((toxic == c).sum())) for c in (0, 1)}

    def strength(word: str) -> float:
        a, b = count[1][word], count[0][word]
        return abs(np.log((a + 0.5) / (size[1] + 1)) - np.log((b + 0.5) / (size[0] + 1))) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))

    often = [w for w in set(count[0]) | set(count[1]) if count[0][w] + count[1][w] >= LEAST]
    vocabulary = {w: k for k, w in enumerate(sorted(often, key=lambda w: (-strength(w), w))[:VOCABULARY])}
    x = np.zeros((len(rows), len(vocabulary)))
    for k, row in enumerate(rows):
        x[k, [vocabulary[w] for w in row & vocabulary.keys()]] = 1.0
    targets = [np.array([float(y == 1 and not row.isdisjoint(family)) for row, y in zip(rows, toxic)]) for family in families.values()]
    targets.append((toxic == 1).astype(float))
    weights, fold = [], np.arange(len(rows)) % FOLDS
    for target in targets:
        odds = np.zeros(len(rows))
        for k in range(FOLDS):
            if (fold == k).any():
                part = logistic(x[fold != k], target[fold != k])
                odds[fold == k] = np.clip(x[fold == k] @ part[:-1] + part[-1], -30, 30)
        weights.append(logistic(x, target))
        x = np.hstack([x, odds[:, None]])
    return Chain(vocabulary, (*families, LAST), tuple(weights))


def trained(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Chain:
    got = labelled_sample(docs, labels, "toxic", rows).collect()  # at most ``rows`` rows
    got.sort(key=lambda r: r[0])
    return fit_chain([r[1] for r in got], np.array([r[2] for r in got], np.int64))


def probabilities(spark: SparkSession, chain: Chain, text: str = "text") -> Column:
    """An array of probabilities, one for each category in order."""
    shared = spark.sparkContext.broadcast(chain)  # at most VOCABULARY words

    @F.pandas_udf("array<double>")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([shared.value.probabilities(t) for t in some], dtype=object)

    return score(text_of(text))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, one probability ``p_<category>`` each and ``toxic`` (1 if the last is at least THRESHOLD)."""
    chain = trained(docs, labels)
    found = docs.select("doc_id", probabilities(docs.sparkSession, chain).alias("p"))
    each = [F.col("p")[k].alias(f"p_{name}") for k, name in enumerate(chain.categories)]
    return found.select("doc_id", *each, (F.col("p")[len(each) - 1] >= THRESHOLD).cast("int").alias(LAST))


def op4_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    return scored(documents(spark, directory), spark.read.parquet(f"{directory}/labels.parquet"))


QUERIES = {"op4_toxicity": op4_toxicity}
