"""Two narrow aggregates the coverage reports read instead of the fact table.

A fact table holds hundreds of counters per entity and interval. ``entity_activity``
drops the counter dimension and ``counter_activity`` the entity dimension, each in
one aggregation with map-side combining. Reports with several distinct counts then
run on these, so Spark expands rows for the distinct counts after the reduction,
not before it. A caller may store either one as a table and pass it in ``Tables``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from radiokpi.operators.entities import keyed_facts
from radiokpi.operators.records import counted, counter_stats
from radiokpi.tables import Tables


def entity_activity(tables: Tables) -> DataFrame:
    """Rows per family, entity, interval, collect time, source file and revision."""
    if "entity_activity" in tables:
        return tables["entity_activity"]
    frame, rows, values = counted(tables, keyed_facts(tables))
    return frame.groupBy(
        "dataset_family", "logical_entity_key", "interval_start", "collect_time", "source_file", "revision",
    ).agg(rows.alias("row_count"), values.alias("value_count"))


def counter_activity(tables: Tables) -> DataFrame:
    """Rows per family, interval, collect time, source file and counter."""
    if "counter_activity" in tables:
        return tables["counter_activity"]
    keys = ["dataset_family", "interval_start", "collect_time", "source_file"]
    return counter_stats(tables, tables.pm_sample, keys).select(
        *keys, "counter_id", "row_count", F.col("non_null_counter_value_count").alias("value_count"))


def rows_by_file_time(tables: Tables, files: DataFrame | None = None) -> DataFrame:
    """Fact rows (row_count) per source file and collect time, for all files or those of ``files``.

    A stored activity table has these counts and is restricted before it is read on. Facts
    are counted first: the counts, not the facts, then meet the list of files.
    """
    stored = "counter_activity" in tables
    rows = tables["counter_activity"] if stored else tables.pm_sample.select("source_file", "collect_time", F.lit(1).alias("row_count"))

    def listed(frame: DataFrame) -> DataFrame:
        return frame if files is None else frame.join(files.select("source_file"), "source_file", "left_semi")

    counted = (listed(rows) if stored else rows).groupBy("source_file", "collect_time").agg(F.sum("row_count").alias("row_count"))
    return counted if stored else listed(counted)
