"""Counter reference, KPI definitions and vendor indicators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from radiokpi.functions import page
from radiokpi.tables import Tables

COUNTER_REFERENCE = ["counter_id", "vendor", "technology", "object_type", "description", "unit", "source_type",
                     "source_reference", "verification_status", "verified_at", "notes"]
INDICATOR = ["indicator_code", "indicator_name", "semantic_alias", "aggregation_method", "unit",
             "verification_status", "source"]
LINEAGE = ["lineage_expression", "lineage_type", "raw_counter_dependencies"]


def _sorted_where(condition: Column, value: str) -> Column:
    return F.array_sort(F.collect_list(F.when(condition, F.col(value))))


def _sorted_set(value: Column) -> Column:
    return F.array_sort(F.collect_set(value))


def counter_list(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """F17."""
    return page(tables.counter_reference.select(*COUNTER_REFERENCE), "counter_id", limit=limit)


def counter_by_id(tables: Tables, *, counter_id: str) -> DataFrame:
    """F17."""
    return counter_list(tables).where(F.col("counter_id") == counter_id)


def kpi_definition_details(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """Counters are gathered per KPI before the definition is joined on."""
    status = tables.counter_reference.select("counter_id", "verification_status")
    verified = F.col("verification_status").eqNullSafe("VERIFIED")
    mapped = tables.kpi_counter_mapping.select("kpi_name", "counter_role", "counter_id").join(
        status, "counter_id", "left")
    counters = mapped.groupBy("kpi_name").agg(
        _sorted_where(F.col("counter_role") == "numerator", "counter_id").alias("numerator_counter_ids"),
        _sorted_where(F.col("counter_role") == "denominator", "counter_id").alias("denominator_counter_ids"),
        _sorted_where(~verified, "counter_id").alias("unverified_counter_ids"),
        F.bool_and(F.col("verification_status") == "VERIFIED").alias("all_mapped_counters_verified"))
    none = F.array().cast("array<string>")
    details = tables.kpi_definition.join(counters, "kpi_name", "left").select(
        "kpi_name", "technology", "description", "formula_type", "scale_factor", "formula_notes", "unit",
        "aggregation_grain_notes", "status", "pending_reason",
        *[F.coalesce(c, none).alias(c)
          for c in ("numerator_counter_ids", "denominator_counter_ids", "unverified_counter_ids")],
        F.coalesce("all_mapped_counters_verified", F.lit(False)).alias("all_mapped_counters_verified"))
    return page(details, "kpi_name", limit=limit)


def kpi_definition(tables: Tables, *, kpi_name: str) -> DataFrame:
    """F20."""
    return kpi_definition_details(tables).where(F.col("kpi_name") == kpi_name)


def _semantic_details(tables: Tables) -> DataFrame:
    status = tables.counter_dictionary.select(
        "dataset_family", "counter_alias", F.col("verification_status").alias("_counter_status"))
    inputs = tables.kpi_formula_input.select("kpi_code", "input_alias", "dataset_family", "counter_alias").join(
        status, ["dataset_family", "counter_alias"], "left")
    unverified = ~F.col("_counter_status").eqNullSafe("VERIFIED")
    gathered = inputs.groupBy("kpi_code").agg(
        F.count("input_alias").alias("input_count"),
        _sorted_set(F.col("input_alias")).alias("input_aliases"),
        _sorted_set(F.col("counter_alias")).alias("counter_aliases"),
        _sorted_set(F.when(unverified, F.col("counter_alias"))).alias("unverified_counter_aliases"),
        F.bool_or(unverified).alias("_has_unverified"))
    none = F.array().cast("array<string>")
    return tables.kpi_formula.join(gathered, "kpi_code", "left").select(
        "kpi_code", "kpi_name", "formula_expression", "grain", "unit", "verification_status",
        "topology_rollup_allowed", "notes",
        F.coalesce("input_count", F.lit(0)).alias("input_count"),
        *[F.coalesce(c, none).alias(c) for c in ("input_aliases", "counter_aliases", "unverified_counter_aliases")],
        # A definition without inputs has nothing verified behind it and counts as provisional.
        F.coalesce("_has_unverified", F.lit(True)).alias("_has_unverified"))


def semantic_kpi_definition_details(tables: Tables) -> DataFrame:
    """A24. The array of unverified aliases never holds a NULL entry."""
    return _semantic_details(tables).drop("_has_unverified")


def provisional_kpis(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """F11."""
    provisional = _semantic_details(tables).where((F.col("verification_status") != "VERIFIED") | F.col("_has_unverified"))
    return page(provisional.drop("_has_unverified"), "kpi_code", limit=limit)


def verified_counter_specs(tables: Tables, *, dataset_family: str, aliases: Sequence[str]) -> DataFrame:
    """F8."""
    return tables.counter_dictionary.where(
        (F.col("dataset_family") == dataset_family) & F.col("counter_alias").isin(*aliases)
        & (F.col("verification_status") == "VERIFIED")).select("counter_id", "counter_alias")


def vendor_indicator_details(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """J16, F19."""
    lineage = tables.vendor_lineage.select("indicator_code", *LINEAGE)
    details = tables.vendor_indicator.select(*INDICATOR).join(lineage, "indicator_code", "left")
    return page(details, "indicator_code", limit=limit)


def vendor_indicators_by_alias(tables: Tables, *, aliases: Sequence[str]) -> DataFrame:
    """F19."""
    return vendor_indicator_details(tables).where(F.col("semantic_alias").isin(*aliases))


# KPI inputs that are resolved before facts are read; more of them are joined as a table instead.
RESOLVED = 1000


def resolved(specs: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """``specs`` with its rows at hand, and its counter ids for a filter the fact scan can use.

    A definition names a handful of counters. Spark takes the estimated size of a join of
    dimension tables for the product of their sizes and would shuffle all facts to meet it;
    rows that are at hand are counted and broadcast. At most ``RESOLVED`` + 1 small rows are
    read; if there are more, ``specs`` comes back as it is, without ids.
    """
    rows = specs.limit(RESOLVED + 1).collect()
    if len(rows) > RESOLVED:
        return specs, None
    return F.broadcast(specs.sparkSession.createDataFrame(rows, specs.schema)), sorted({r["counter_id"] for r in rows})


def facts_of(facts: DataFrame, counter_ids: list[str] | None) -> DataFrame:
    return facts if counter_ids is None else facts.where(F.col("counter_id").isin(counter_ids))
