"""Seed files: cleaning and checking of the curated CSV tables.

Every loader takes a DataFrame of text columns (``read_seed`` for a CSV file) and
returns all of its rows cleaned, with ``reject_reason`` NULL where a row is valid
(the reject texts are fixed values).
``accepted`` and ``rejected`` split them, so one bad row does not stop a load.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from radiokpi.functions import blank_to_null, strip_space
from radiokpi.schemas import COUNTER_STATUSES, SEMANTIC_STATUSES


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV as text columns with ``line_no`` growing along the file."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    return rows.withColumnRenamed(rows.columns[0], rows.columns[0].lstrip("\ufeff")).withColumn(
        "line_no", F.monotonically_increasing_id())


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason is null").drop("reject_reason")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason is not null")


def _field(raw: DataFrame, *names: str) -> Column:
    """Cleaned text of the first named column that is there and not blank."""
    there = [blank_to_null(n) for n in names if n in raw.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def _finish(raw: DataFrame, columns: dict[str, Column], checks: Sequence[Column], required: dict[str, str]) -> DataFrame:
    missing = [F.when(columns[name].isNull(), f"Missing required field: {label}") for name, label in required.items()]
    order = [F.col("line_no")] if "line_no" in raw.columns else []
    return raw.select(*[c.alias(n) for n, c in columns.items()], *order,
                      F.coalesce(*checks, *missing, F.lit(None).cast("string")).alias("reject_reason"))


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def _status(raw: DataFrame, allowed: Sequence[str], default: str = "UNKNOWN") -> tuple[Column, Column]:
    status = F.coalesce(_field(raw, "verification_status"), F.lit(default))
    return status, F.when(~status.isin(*allowed), F.concat(F.lit("Invalid verification_status: "), status))


def load_counter_reference(raw: DataFrame, *, now: datetime) -> DataFrame:
    """VERIFIED without a date is verified ``now``."""
    status, bad_status = _status(raw, COUNTER_STATUSES)
    text = _field(raw, "verified_at")
    given = text.try_cast("timestamp_ntz")
    columns = {c: _field(raw, c) for c in ("counter_id", "vendor", "technology", "object_type", "description", "unit",
                                           "source_type", "source_reference")}
    columns["verification_status"] = status
    columns["verified_at"] = F.when(text.isNull() & (status == "VERIFIED"), F.lit(now).cast("timestamp_ntz")).otherwise(given)
    columns["notes"] = _field(raw, "notes")
    bad_date = F.when(text.isNotNull() & given.isNull(), F.concat(F.lit("Invalid isoformat string: '"), text, F.lit("'")))
    return _finish(raw, columns, [bad_status, bad_date], _same("counter_id", "vendor", "technology"))


def load_counter_dictionary(raw: DataFrame) -> DataFrame:
    """S12."""
    status, bad_status = _status(raw, SEMANTIC_STATUSES)
    required = ("dataset_family", "counter_id", "counter_alias", "counter_name", "aggregation_behavior")
    names = ("dataset_family", "counter_id", "counter_alias", "counter_name", "unit", "aggregation_behavior")
    columns = {c: _field(raw, c) for c in names} | {"verification_status": status}
    columns |= {c: _field(raw, c) for c in ("source_note", "group_code", "group_name", "group_notes")}
    return _finish(raw, columns, [bad_status], _same(*required))


def _flag(raw: DataFrame, name: str, default: bool) -> tuple[Column, Column]:
    text = _field(raw, name)
    word = F.lower(text)
    value = F.when(text.isNull(), F.lit(default)).when(word.isin("1", "true", "yes", "y"), True).when(
        word.isin("0", "false", "no", "n"), False)
    return value, F.when(value.isNull(), F.concat(F.lit("Invalid boolean value: "), text))


def load_kpi_definitions(raw: DataFrame) -> DataFrame:
    """One row per KPI input; alias, family and counter alias come together or not at all."""
    status, bad_status = _status(raw, SEMANTIC_STATUSES)
    rollup, bad_rollup = _flag(raw, "topology_rollup_allowed", False)
    required, bad_required = _flag(raw, "required", True)
    alias, family, counter = (_field(raw, c) for c in ("input_alias", "dataset_family", "counter_alias"))
    columns = {c: _field(raw, c) for c in ("kpi_code", "kpi_name", "formula_expression", "grain", "unit")}
    columns |= {"verification_status": status, "topology_rollup_allowed": rollup, "notes": _field(raw, "notes"),
                "input_alias": alias, "dataset_family": family, "counter_alias": counter, "required": required,
                "input_notes": _field(raw, "input_notes")}
    # Reject texts.
    checks = [
        bad_status,
        F.when(alias.isNotNull() & family.isNull(), "dataset_family is required when input_alias is provided"),
        F.when(alias.isNotNull() & counter.isNull(), "counter_alias is required when input_alias is provided"),
        F.when(alias.isNull() & (family.isNotNull() | counter.isNotNull()),
               "input_alias is required when dataset_family or counter_alias is provided"),
    ]
    missing = [F.when(columns[c].isNull(), f"Missing required field: {c}")
               for c in ("kpi_code", "kpi_name", "formula_expression", "grain")]
    return _finish(raw, columns, [*checks, *missing, bad_rollup, bad_required], {})


def load_vendor_indicators(raw: DataFrame, *, file_name: str) -> DataFrame:
    """Dependencies default to the parts of the lineage expression, the type to their number."""
    status, bad_status = _status(raw, SEMANTIC_STATUSES, default="VERIFIED")
    lineage = _field(raw, "counter_lineage_expression", "lineage_expression")
    tokens = F.filter(F.transform(F.split(lineage, r"\|"), strip_space), lambda t: t != "")
    dependencies = F.coalesce(_field(raw, "raw_counter_dependencies"), F.array_join(tokens, "|"))
    parts = F.size(F.filter(F.split(dependencies, r"\|"), lambda t: t != ""))
    columns = {
        "indicator_code": _field(raw, "vendor_indicator_code", "indicator_code"),
        "indicator_name": _field(raw, "vendor_indicator_name", "indicator_name"),
        "semantic_alias": _field(raw, "proposed_counter_alias", "semantic_alias"),
        "aggregation_method": _field(raw, "aggregation_method"),
        "unit": _field(raw, "unit"),
        "verification_status": status,
        "source": F.coalesce(_field(raw, "source"), F.lit(file_name)),
        "lineage_expression": lineage,
        "lineage_type": F.coalesce(_field(raw, "lineage_type"), F.when(parts <= 1, "direct").when(parts > 1, "composed")),
        "raw_counter_dependencies": dependencies,
    }
    return _finish(raw, columns, [bad_status], {
        "lineage_expression": "counter_lineage_expression", "indicator_code": "vendor_indicator_code",
        "indicator_name": "vendor_indicator_name", "semantic_alias": "proposed_counter_alias",
        "aggregation_method": "aggregation_method"})


# Columns of the four topology seeds, required ones first in the second part.
TOPOLOGY_SEEDS = {
    "regions": (("region_code", "region_name", "notes"), ("region_code", "region_name")),
    "sites": (("site_code", "site_name", "region_code", "notes"), ("site_code",)),
    "reporting": (("reporting_key", "reporting_name", "reporting_level", "parent_reporting_key", "notes"),
                  ("reporting_key", "reporting_name")),
    "entity_map": (("logical_entity_key", "site_code", "reporting_key", "mapping_source", "notes"),
                   ("logical_entity_key",)),
}


def load_topology(raw: DataFrame, *, kind: str) -> DataFrame:
    """Regions, sites, reporting or entity_map."""
    names, required = TOPOLOGY_SEEDS[kind]
    return _finish(raw, {c: _field(raw, c) for c in names}, [], _same(*required))
