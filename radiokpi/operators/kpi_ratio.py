"""Weighted counter-ratio KPIs from the counter mapping table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from radiokpi.functions import page, safe_ratio
from radiokpi.tables import Tables

DEFINITION = ["kpi_name", "technology", "description", "unit", "aggregation_grain_notes", "formula_notes"]


def _active(tables: Tables) -> DataFrame:
    return tables.kpi_definition.where("status = 'ACTIVE' and formula_type = 'ratio'")


def _ratio_parts(tables: Tables, grain: list[str]) -> DataFrame:
    """Both sides of each ratio in one pass over the facts of mapped, verified counters.

    A group is kept when it saw rows of both sides, as joining two separate
    aggregates would; NULL is a group of its own, so no NULL-safe join is needed.
    """
    verified = tables.counter_reference.where("verification_status = 'VERIFIED'").select("counter_id")
    mapping = (
        tables.kpi_counter_mapping.select("kpi_name", "counter_role", "counter_id", "weight")
        .join(_active(tables).select("kpi_name"), "kpi_name", "left_semi").join(verified, "counter_id", "left_semi"))
    weighted = tables.pm_sample.select(*grain, "counter_id", "counter_value").join(mapping, "counter_id")
    term = F.col("counter_value") * F.col("weight")
    top, bottom = F.col("counter_role") == "numerator", F.col("counter_role") == "denominator"
    parts = weighted.groupBy("kpi_name", *grain).agg(
        F.sum(F.when(top, term)).alias("numerator_value"), F.sum(F.when(bottom, term)).alias("denominator_value"),
        F.bool_or(top).alias("_top"), F.bool_or(bottom).alias("_bottom"))
    return parts.where("_top and _bottom").drop("_top", "_bottom")


def _finish(parts: DataFrame, tables: Tables, columns: list[str]) -> DataFrame:
    named = parts.join(_active(tables).select(*DEFINITION, "scale_factor"), "kpi_name")
    value = safe_ratio("numerator_value", "denominator_value", F.coalesce("scale_factor", F.lit(1.0)))
    return named.select(*DEFINITION, *columns, "numerator_value", "denominator_value", value.alias("kpi_value"))


def kpi_ratio_values_by_time(tables: Tables) -> DataFrame:
    """J8."""
    return _finish(_ratio_parts(tables, ["collect_time"]), tables, ["collect_time"])


def kpi_ratio_values_by_time_ani(tables: Tables) -> DataFrame:
    """The ani is named after aggregation; a NULL ani is a group like any other."""
    named = tables.ani_entity.select("ani", "logical_entity_key", "site_code", "region_name")
    parts = _ratio_parts(tables, ["collect_time", "ani"]).join(named, "ani", "left")
    return _finish(parts, tables, ["collect_time", "ani", "logical_entity_key", "site_code", "region_name"])


def summarize_kpi(tables: Tables, *, kpi_name: str, limit: int | None = None) -> DataFrame:
    only = tables.updated(kpi_definition=tables.kpi_definition.where(F.col("kpi_name") == kpi_name))
    return page(kpi_ratio_values_by_time_ani(only), "-collect_time", "ani", limit=limit)
