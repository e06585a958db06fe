"""Helpers several operators share: staged tables, ranks over hot groups, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from radiokpi.tables import shared_folder

# What the contracts call white space: U+0020 and U+0009 to U+000D, nothing else.
WORD = r"[^\x20\x09-\x0D]+"


def staged(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once below the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/llm/{uuid.uuid4().hex}/{name}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def block_ranks(frame: DataFrame, group: list[str], block: str, order: list[Column], rank: str) -> DataFrame:
    """``rank`` (from 1) of every row in its ``group``, by ``block`` and then ``order``, without one task per group.

    Only blocks are numbered by a window over the group; rows are numbered inside their block.
    The caller chooses blocks so that a hot group has many. Group columns must not be null.
    """
    sizes = frame.groupBy(*group, block).agg(F.count("*").alias("__rows"))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, block, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*group, block).orderBy(*order))
    ranked = frame.withColumn("__inside", inside).join(starts, [*group, block])
    return ranked.withColumn(rank, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b long): one row (node, root) per linked node, root the smallest node.

    Alternates large-star and small-star steps, so that the number of rounds grows with the logarithm of the
    longest path. Each round is one table in the shared folder. No edges: no rows.
    """
    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (now := mark(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = staged(small.where("a <> b").distinct(), "edges")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/documents.parquet")
