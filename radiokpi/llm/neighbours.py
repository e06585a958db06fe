"""Approximate nearest neighbours (largest inner product) by multi-index hashing.

Codes come from learned rotations (iterative quantization from several starts, so that codes may be longer than
vectors), fitted on a bounded sample. A code is cut into 16-bit substrings, each indexed by its value. To find every
code within Hamming radius ``r = m s + a`` of a query it is enough to probe the first ``a + 1`` substrings within
``s`` bits and the others within ``s - 1`` (pigeonhole); the radius grows until a block has given ``ENOUGH`` codes
inside it, and those are reranked on the original vectors in double precision.

The index is dealt to blocks of rows and the queries to blocks of queries; each pair of blocks is one bounded task.
Equal vectors are one entry with the smallest ids it needs, so that copies can't crowd an answer.

Defined results: vectors that are null, empty, zero, or hold null or non-finite numbers take no part, nor do rows
without vec_id or vectors of another length than the most frequent one; fewer candidates than asked for give shorter
answers; ties go to the smaller vec_id; a repeated vec_id is one candidate with its best vector; no rows give no
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from radiokpi.llm.common import staged

K = 20
EVERY = 20
BITS = 128
PART = 16
FIT_ROWS = 4096
FIT_ROUNDS = 30
ENOUGH = 3000
INDEX_BLOCK = 65536
QUERY_BLOCK = 512
SALTS = 64


def _flips() -> list[np.ndarray]:
    """Masks of PART bits by number of set bits."""
    return [np.array([sum(1 << b for b in bits) for bits in combinations(range(PART), n)], np.uint16) for n in range(PART + 1)]


FLIPS = _flips()


@dataclass(frozen=True)
class Coder:
    """Bit ``b`` of a vector's code is set where ``(vector - mean) . turn[:, b] > 0``."""

    mean: np.ndarray
    turn: np.ndarray

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """[row, part] of 16-bit substrings."""
        bits = (vectors - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u2")


def fit(vectors: np.ndarray, bits: int = BITS, seed: int = 8) -> Coder:
    """Principal axes, then rotations learned by iterative quantization, as many as ``bits`` ask for."""
    mean = vectors.mean(0)
    centred = vectors - mean
    size = vectors.shape[1]
    _, axes = np.linalg.eigh(centred.T @ centred)
    rng, turns = np.random.default_rng(seed), []
    while sum(t.shape[1] for t in turns) < bits:
        width = min(size, bits - sum(t.shape[1] for t in turns))
        low = centred @ axes[:, ::-1][:, :width]
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(FIT_ROUNDS):
            left, _, right = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (left @ right).T
        turns.append(axes[:, ::-1][:, :width] @ turn)
    return Coder(mean, np.hstack(turns))


class Index:
    """Substring tables over the codes of one block: rows by value, in order, with the first row of each value."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = np.ascontiguousarray(codes).view("<u8")
        self.parts = codes.shape[1]
        self.rows, self.first = [], []
        for part in range(self.parts):
            order = np.argsort(codes[:, part], kind="stable")
            self.rows.append(order)
            self.first.append(np.searchsorted(codes[order, part], np.arange((1 << PART) + 1)))

    def within(self, code: np.ndarray, enough: int) -> np.ndarray:
        """All rows within the smallest radius that holds ``enough`` of them (all rows, if there are fewer)."""
        size = len(self.codes)
        if size <= enough:
            return np.arange(size)
        query = np.ascontiguousarray(code).view("<u8")
        seen = np.zeros(size, bool)
        distances = np.full(size, 255, np.int64)
        for flips in range(PART + 1):
            for part in range(self.parts):
                keys = code[part] ^ FLIPS[flips]
                starts, ends = self.first[part][keys], self.first[part][keys.astype(np.int64) + 1]
                held = ends > starts
                starts, counts = starts[held], (ends - starts)[held]
                at = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
                new = self.rows[part][at]
                new = new[~seen[new]]
                seen[new] = True
                distances[new] = np.bitwise_count(self.codes[new] ^ query).sum(1)
                radius = self.parts * flips + part
                if (distances <= radius).sum() >= enough:
                    return np.flatnonzero(distances <= radius)
        return np.flatnonzero(seen)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector): the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id is not null and size(vector) > 0")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda v: v != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (sizes[0] if sizes else 0))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(vector, ids): one row per distinct vector with its ``k + 1`` smallest ids, which is all an answer can need.

    Ids are cut first inside salted parts of a class, so that a vector shared by many rows is no single task's load.
    """
    keyed = rows.withColumns({"h": F.xxhash64("vector"), "salt": F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))}).drop("vector")
    keyed = keyed.groupBy("h", "salt", "vec_id").count()
    some = keyed.withColumn("n", F.row_number().over(Window.partitionBy("h", "salt").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    least = some.withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    ids = least.groupBy("h").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    named = ids.withColumn("vec_id", F.col("ids")[0])
    vectors = rows.withColumn("h", F.xxhash64("vector"))
    return named.join(vectors, ["h", "vec_id"]).dropDuplicates(["h", "vec_id"]).select("vector", "ids")


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, a row whose id ``every`` divides."""
    rows = staged(usable(embeddings), "usable")
    index = staged(classes(rows, k), "classes")
    sample = index.orderBy(F.xxhash64("vector"), "vector").limit(FIT_ROWS).select("vector").collect()
    if not sample:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coder = rows.sparkSession.sparkContext.broadcast(fit(np.array([r[0] for r in sample])))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id", "vector").count()
    entries = index.count()
    n_index, n_query = -(-entries // INDEX_BLOCK), -(-max(1, entries // every) // QUERY_BLOCK)
    deal = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.col("vec_id").alias("id"), "vector", deal("vec_id", n_query).alias("qb"), every_block(n_index).alias("ib"))
    held = index.select("ids", "vector", deal(F.col("ids")[0], n_index).alias("ib"), every_block(n_query).alias("qb"))

    def search(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(index):
            vectors = np.stack(index["vector"].to_numpy())
            ids = index["ids"].to_numpy()
            asked = np.stack(queries["vector"].to_numpy())
            table = Index(coder.value.codes(vectors))
            for query_id, vector, code in zip(queries["id"].to_numpy(), asked, coder.value.codes(asked)):
                near = table.within(code, ENOUGH)
                # Row by row in one order of summation: equal vectors get equal scores wherever they are.
                scores = np.einsum("ij,j->i", vectors[near], vector)
                top = np.argpartition(-scores, min(k + 1, len(near) - 1))[:k + 1] if len(near) > k + 1 else np.arange(len(near))
                top = np.flatnonzero(scores >= scores[top].min())
                one = [(-s, int(i)) for s, t in zip(scores[top], near[top]) for i in ids[t] if i != query_id]
                found += [(query_id, i, -s) for s, i in sorted(one)[:k]]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    pairs = asked.groupBy("qb", "ib").cogroup(held.groupBy("qb", "ib")).applyInPandas(search, "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{directory}/embeddings.parquet"))


QUERIES = {"op8_neighbours": op8_neighbours}
