"""Upserts without MERGE: Parquet tables are rewritten from the old table and the incoming rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from radiokpi.functions import first_per
from radiokpi.tables import Tables

LINE = "line_no"


def last_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows with the later line winning where a key occurs twice."""
    return first_per(rows, keys, largest=[F.col(LINE)]) if LINE in rows.columns else rows


def last_distinct(rows: DataFrame, keys: list[str]) -> DataFrame:
    """As ``last_per_key`` but whole rows that repeat count at their first line only."""
    columns = [c for c in rows.columns if c != LINE]
    return last_per_key(rows.groupBy(*columns).agg(F.min(LINE).alias(LINE)), keys)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not incoming, then every incoming row."""
    incoming = last_per_key(incoming, keys).drop(LINE)
    kept = existing.join(incoming.select(*keys), keys, "left_anti")
    return kept.select(*incoming.columns).unionByName(incoming)


def replace_children(existing: DataFrame, incoming: DataFrame, parent: DataFrame, parent_key: str) -> DataFrame:
    """Drop every old child of the touched parents, then add the incoming children."""
    kept = existing.join(parent.select(parent_key).distinct(), parent_key, "left_anti")
    return kept.select(*incoming.columns).unionByName(incoming)


def upsert_reference(tables: Tables, *, name: str, rows: DataFrame) -> Tables:
    """Upsert accepted seed rows into one of the keyed reference tables."""
    key = {"topo_region": "region_code", "topo_site": "site_code", "topo_reporting": "reporting_key",
           "topo_entity_map": "logical_entity_key", "counter_reference": "counter_id"}[name]
    return tables.updated(**{name: upsert(tables[name], rows, [key])})


def upsert_dictionary(tables: Tables, rows: DataFrame) -> Tables:
    """Dictionary and groups are upserted; members of the touched groups are replaced."""
    dictionary = rows.select("dataset_family", "counter_id", "counter_alias", "counter_name", "unit",
                             "aggregation_behavior", "verification_status", "source_note", LINE)
    grouped = rows.where("group_code is not null")
    groups = last_distinct(grouped.select(
        "group_code", F.coalesce("group_name", "group_code").alias("group_name"),
        F.col("group_notes").alias("notes"), LINE), ["group_code"])
    member_key = ["group_code", "dataset_family", "counter_alias"]
    members = last_distinct(grouped.select(*member_key, F.col("group_notes").alias("notes"), LINE), member_key).drop(LINE)
    return tables.updated(
        counter_dictionary=upsert(tables.counter_dictionary, dictionary, ["dataset_family", "counter_id"]),
        counter_group=upsert(tables.counter_group, groups, ["group_code"]),
        counter_group_member=replace_children(tables.counter_group_member, members, groups, "group_code"))


def upsert_kpi_definitions(tables: Tables, rows: DataFrame) -> Tables:
    """Definitions are upserted; formula inputs of the touched KPIs are replaced."""
    definitions = last_distinct(rows.select(
        "kpi_code", "kpi_name", "formula_expression", "grain", "unit", "verification_status",
        "topology_rollup_allowed", "notes", LINE), ["kpi_code"])
    input_key = ["kpi_code", "input_alias", "dataset_family", "counter_alias"]
    inputs = last_per_key(rows.where("input_alias is not null").select(
        *input_key, "required", F.col("input_notes").alias("notes"), LINE), input_key).drop(LINE)
    return tables.updated(
        kpi_formula=upsert(tables.kpi_formula, definitions, ["kpi_code"]),
        kpi_formula_input=replace_children(tables.kpi_formula_input, inputs, definitions, "kpi_code"))


def upsert_vendor_indicators(tables: Tables, rows: DataFrame) -> Tables:
    """Dictionary and lineage, both by indicator code."""
    dictionary = rows.select("indicator_code", "indicator_name", "semantic_alias", "aggregation_method", "unit",
                             "verification_status", "source", LINE)
    lineage = rows.select("indicator_code", "lineage_expression", "lineage_type", "raw_counter_dependencies", LINE)
    return tables.updated(
        vendor_indicator=upsert(tables.vendor_indicator, dictionary, ["indicator_code"]),
        vendor_lineage=upsert(tables.vendor_lineage, lineage, ["indicator_code"]))
