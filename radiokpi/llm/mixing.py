"""Mixing sources to target weights by systematic sampling (only DataFrame functions).

Every document expects ``target / source size`` copies. Expected copies are prefix-summed within the source, one
offset per source is added, and a document is taken once for each integer its interval crosses.

Defined results: null text counts no words; null source is a source of its own and comes last; a source without
words has target 0 and gives nothing; empty tables give no rows; repeated rows are documents of their own; ties in
the sampling order fall to doc_id and size. Extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from radiokpi.llm.common import WORD, block_ranks, documents, staged, text_of

WEIGHTS = (5, 2, 1)
CAP = 3
SPLITS = 64
OFFSETS = 1024


def size_of(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds ``target`` to one row per source (__source, source, source_size).

    A source is capped when the level that the sources before it leave, in order of cap per weight, is above its
    own cap per weight; the level of the others follows in one step, so no iteration is needed.
    """
    every = Window.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    rows = sources.withColumn("__weight", F.element_at(F.lit(list(weights)), F.pmod(place - 1, F.lit(len(weights))) + 1).cast("double"))
    rows = rows.withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    earlier = every.orderBy(F.col("__cap") / F.col("__weight"), "__source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0))
    weight = F.sum("__weight").over(every) - F.coalesce(F.sum("__weight").over(earlier), F.lit(0.0))
    rows = rows.withColumn("__capped", left * F.col("__weight") > F.col("__cap") * weight)
    capped = F.coalesce(F.sum(F.when(F.col("__capped"), F.col("__cap"))).over(every), F.lit(0.0))
    level = (F.sum("source_size").over(every) - capped) / F.sum(F.when(~F.col("__capped"), F.col("__weight"))).over(every)
    target = F.when(F.col("__capped"), F.col("__cap")).otherwise(level * F.col("__weight"))
    return rows.withColumn("target", target).drop("__weight", "__cap", "__capped")


def mix(docs: DataFrame, size: Column | None = None, seed: int = 3) -> DataFrame:
    """``docs`` with ``__size``, ``__source_size``, ``__target`` and ``__copies``; needs doc_id and source.

    Inside a source documents are ordered by size class and then by a seeded hash, so that the words taken follow
    the copies taken. (Size class, hash bucket) blocks spread a hot source over many tasks. Reruns agree.
    """
    rows = docs.withColumns({
        "__size": size_of() if size is None else size,
        "__source": F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source"))),
        "__order": F.xxhash64(F.lit(seed), F.col("doc_id"))})
    classes = F.when(F.col("__size") > 0, F.floor(F.log2(F.col("__size")) * 8) + 1).otherwise(F.lit(0))
    rows = rows.withColumn("__block", (classes * SPLITS + F.pmod(F.col("__order"), F.lit(SPLITS))).cast("long"))
    sources = rows.groupBy("__source").agg(F.sum("__size").alias("source_size"), F.first("source").alias("source"))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("__source")), F.lit(OFFSETS)) / F.lit(float(OFFSETS))
    shares = source_targets(sources).select(
        "__source", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), offset.alias("__offset"))
    ranked = block_ranks(rows, ["__source"], "__block", [F.col("__order"), F.col("doc_id"), F.col("__size")], "__rank")
    expected = F.when(F.col("__source_size") > 0, F.least(F.col("__target") / F.col("__source_size"), F.lit(float(CAP)))).otherwise(0.0)
    upto = F.floor(expected * F.col("__rank") + F.col("__offset"))
    below = F.floor(expected * (F.col("__rank") - 1) + F.col("__offset"))
    return ranked.join(shares, "__source").withColumn("__copies", (upto - below).cast("int")).drop(
        "__source", "__order", "__block", "__rank", "__offset")


def mixed_documents(docs: DataFrame, seed: int = 3) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns it came with."""
    return mix(docs, seed=seed).where("__copies > 0").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_source_mix(spark: SparkSession, directory: str) -> DataFrame:
    sized = staged(documents(spark, directory).select("doc_id", "source", size_of().alias("size")), "sized")
    return mix(sized, F.col("size")).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).cast("long").alias("taken"), "source")


QUERIES = {"op3_source_mix": op3_source_mix}
