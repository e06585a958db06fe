"""Bounded samples of labelled documents, for the models that learn from ``labels``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from radiokpi.llm.common import text_of


def held_out(doc_id: str = "doc_id") -> Column:
    """The fifth of the documents that no model may learn from; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, label): at most ``rows`` labelled documents that are not held out, in a fixed pseudo-random choice.

    Labels of one doc_id are averaged; null labels and labels without a document are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(11), F.col("doc_id")), "doc_id").limit(rows)
    # The hint is safe: the sample has at most ``rows`` rows of two numbers.
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.dropDuplicates(["doc_id"]).select("doc_id", "text", F.col("__label").alias("label"))
