"""Parameterised KPI results and validation for one data-set family.

These differ from the verified tables on purpose: neither behaviour nor unit of a
counter is checked, intervals of one collect time are merged, and a row stays when
only a denominator is present.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from radiokpi.functions import page
from radiokpi.functions.columns import percent_ratio
from radiokpi.operators.entities import keyed_facts, with_level
from radiokpi.operators.kpi_definitions import facts_of, resolved, verified_counter_specs
from radiokpi.operators.kpi_semantic import (
    KPI_CODES, RRC_ALIASES, output_validation, verified_rrc_place_time,
)
from radiokpi.operators.topology import with_places
from radiokpi.schemas import ALL_IDENTITY_FIELDS, CELL_FAMILIES, IDENTITY_FIELDS
from radiokpi.tables import Tables

# Numerator and denominator alias per KPI.
RATIO_ALIASES = {
    "dl_prb_utilization": ("dl_prb_used", "dl_prb_available"),
    "ul_prb_utilization": ("ul_prb_used", "ul_prb_available"),
    "dl_bler": ("dl_tb_error_blocks", "dl_tb_total_blocks"),
    "ul_bler": ("ul_tb_error_blocks", "ul_tb_total_blocks"),
}
# KPI families and grains.
FAMILIES = ("prb", "bler", "rrc")
GRAINS = ("entity-time", "site-time", "region-time")


def _check(family: str, grain: str) -> None:
    if family not in FAMILIES:
        raise ValueError(f"unsupported KPI family: {family}")
    if grain not in GRAINS:
        raise ValueError(f"unsupported KPI grain: {grain}")


def collect_time_window(frame: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """closed range on collect_time, either bound optional.

    A ``collect_date`` partition column is bounded as well, so whole directories are skipped.
    """
    dated = "collect_date" in frame.columns
    if start is not None:
        frame = frame.where(F.col("collect_time") >= F.lit(start).cast("timestamp_ntz"))
        if dated:
            frame = frame.where(F.col("collect_date") >= F.lit(start.date()))
    if end is not None:
        frame = frame.where(F.col("collect_time") <= F.lit(end).cast("timestamp_ntz"))
        if dated:
            frame = frame.where(F.col("collect_date") <= F.lit(end.date()))
    return frame


def latest_window(facts: DataFrame, dataset_family: str, activity: DataFrame | None = None) -> DataFrame:
    """facts of one family at its newest collect time.

    The newest time is a scalar subquery, evaluated before the scan. It is read from the counter ``activity`` where that
    is stored, which is far smaller than the facts and no fact file is opened for it; the day of that time is a partition
    filter where the table has collect_date. Without stored activity the newest day comes first, so times are read from
    one day only.
    """
    chosen = facts.where(F.col("dataset_family") == dataset_family)
    dated = "collect_date" in facts.columns
    if activity is not None:
        newest = activity.where(F.col("dataset_family") == dataset_family).agg(F.max("collect_time").alias("newest"))
        if dated:
            chosen = chosen.where(F.col("collect_date") == newest.select(F.to_date("newest")).scalar())
        return chosen.where(F.col("collect_time") == newest.scalar())
    if dated:
        chosen = chosen.where(F.col("collect_date") == chosen.agg(F.max("collect_date")).scalar())
    return chosen.where(F.col("collect_time") == chosen.agg(F.max("collect_time")).scalar())


def _window(tables: Tables, dataset_family: str, start, end) -> DataFrame:
    if start is None and end is None:
        return latest_window(tables.pm_sample, dataset_family, tables.get("counter_activity"))
    return collect_time_window(tables.pm_sample.where(F.col("dataset_family") == dataset_family), start, end)


def _aliases(family: str) -> dict[str, tuple]:
    """Counter alias to the statistic read from it."""
    if family == "rrc":
        return dict(zip(RRC_ALIASES.values(), (F.max, F.avg, F.sum)))
    return {alias: F.sum for code in KPI_CODES[family] for alias in RATIO_ALIASES[code]}


def _entity_values(tables: Tables, family: str, dataset_family: str, start, end) -> DataFrame:
    """One row per entity and time with one column per counter alias; a single shuffle."""
    aliases = _aliases(family)
    specs = verified_counter_specs(tables, dataset_family=dataset_family, aliases=list(aliases))
    facts = keyed_facts(tables.updated(pm_sample=_window(tables, dataset_family, start, end)))
    return facts.join(specs, "counter_id").groupBy("dataset_family", "logical_entity_key", "collect_time").agg(
        *[stat(F.when(F.col("counter_alias") == alias, F.col("counter_value"))).alias(alias)
          for alias, stat in aliases.items()])


def _present(family: str) -> Column:
    names = list(_aliases(family)) if family == "rrc" else [RATIO_ALIASES[c][1] for c in KPI_CODES[family]]
    return F.coalesce(*names).isNotNull()


def _metrics(family: str) -> list[Column]:
    if family == "rrc":
        return [F.col(alias).alias(name) for name, alias in RRC_ALIASES.items()]
    return [percent_ratio(*RATIO_ALIASES[code]).alias(code) for code in KPI_CODES[family]]


def kpi_results_entity(tables: Tables, *, family: str, dataset_family: str, collect_time_from: datetime | None = None,
                       collect_time_to: datetime | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """K12."""
    _check(family, "entity-time")
    values = _entity_values(tables, family, dataset_family, collect_time_from, collect_time_to).where(_present(family))
    placed = with_level(with_places(values, tables), tables)
    rows = placed.select("dataset_family", "logical_entity_key", "collect_time", "entity_level", "site_code",
                         "region_code", *_metrics(family))
    return page(rows, "-collect_time", "dataset_family", "logical_entity_key", limit=limit, offset=offset)


def kpi_results_rollup(tables: Tables, *, family: str, grain: str, dataset_family: str, site_code: str | None = None,
                       region_code: str | None = None, collect_time_from: datetime | None = None,
                       collect_time_to: datetime | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Entity ratios first, then their unweighted mean per site or region."""
    _check(family, grain)
    place = grain.removesuffix("-time")
    code, name, wanted = f"{place}_code", f"{place}_name", site_code if place == "site" else region_code
    places = tables.topo_enrichment.where(F.col(code).isNotNull())
    if wanted is not None:
        places = places.where(F.col(code) == wanted)
    values = _entity_values(tables, family, dataset_family, collect_time_from, collect_time_to).where(_present(family))
    entities = values.join(places.select("logical_entity_key", code, name), "logical_entity_key").select(
        "dataset_family", code, name, "collect_time", *_metrics(family))
    rolled = entities.groupBy("dataset_family", code, name, "collect_time").agg(
        *[F.avg(c).alias(c) for c in KPI_CODES[family]])
    return page(rolled, "-collect_time", "dataset_family", code, name, limit=limit, offset=offset)


def kpi_results_rrc_rollup(tables: Tables, *, grain: str, dataset_family: str | None = None,
                           site_code: str | None = None, region_code: str | None = None,
                           collect_time_from: datetime | None = None, collect_time_to: datetime | None = None,
                           limit: int | None = None, offset: int = 0) -> DataFrame:
    """Every filter optional and applied to the facts or the place before grouping."""
    _check("rrc", grain)
    place = grain.removesuffix("-time")
    facts = collect_time_window(tables.pm_sample, collect_time_from, collect_time_to)
    if dataset_family is not None:
        facts = facts.where(F.col("dataset_family") == dataset_family)
    rows = verified_rrc_place_time(tables.updated(pm_sample=facts), place=place).withColumnRenamed(place, f"{place}_code")
    wanted = site_code if place == "site" else region_code
    if wanted is not None:
        rows = rows.where(F.col(f"{place}_code") == wanted)
    return page(rows, "-collect_time", "dataset_family", f"{place}_code", limit=limit, offset=offset)


def kpi_results(tables: Tables, *, family: str, grain: str, dataset_family: str | None = None, **options) -> DataFrame:
    """Result rows of any family and grain."""
    _check(family, grain)
    if grain == "entity-time" or family != "rrc":
        if not dataset_family:
            raise ValueError(f"dataset_family is required for {grain} KPI results")
    if grain == "entity-time":
        return kpi_results_entity(tables, family=family, dataset_family=dataset_family, **options)
    if family == "rrc":
        return kpi_results_rrc_rollup(tables, grain=grain, dataset_family=dataset_family, **options)
    return kpi_results_rollup(tables, family=family, grain=grain, dataset_family=dataset_family, **options)


# --- validation -----------------------------------------------------------------------------

def _identity_tuple() -> Column:
    """Raw dimensions that identify an entity here: cell families by three, all others by six."""
    used = {f: IDENTITY_FIELDS[f] for f in CELL_FAMILIES}
    fields = []
    for name in ALL_IDENTITY_FIELDS:
        unused_by = [f for f, dims in used.items() if name not in dims]
        fields.append(F.when(~F.coalesce(F.col("dataset_family").isin(*unused_by), F.lit(False)), F.col(name)).alias(name)
                      if unused_by else F.col(name))
    return F.struct(*fields)


def kpi_validation_entity(tables: Tables, *, family: str, dataset_family: str | None = None) -> DataFrame:
    """Per KPI the inputs seen in facts and the entity-times where every required input is present.

    The dictionary's own verification status is reported, not required. One aggregate reduces
    the facts to one row per KPI, time and entity with the inputs present as bits of a number;
    both halves read that reduction. An input's times and entities are counted after it, on
    a row for each bit.
    """
    _check(family, "entity-time")
    codes = KPI_CODES.get(family) or tuple(RRC_ALIASES)
    kpis = tables.kpi_formula.where(
        F.col("kpi_code").isin(*codes) & (F.col("verification_status") == "VERIFIED")).select("kpi_code")
    inputs = tables.kpi_formula_input.where("required").select(
        "kpi_code", "input_alias", "dataset_family", "counter_alias")
    status = tables.counter_dictionary.select(
        "dataset_family", "counter_alias", "counter_id", F.col("verification_status").alias("counter_status"))
    specs = kpis.join(inputs, "kpi_code").join(status, ["dataset_family", "counter_alias"])
    if dataset_family is not None:
        specs = specs.where(F.col("dataset_family") == dataset_family)

    keys, key = ["kpi_code", "dataset_family"], ["dataset_family", "counter_id"]
    by_input = Window.partitionBy(*keys).orderBy("input_alias")
    specs, counter_ids = resolved(specs.withColumn("_place", F.dense_rank().over(by_input) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_place"))
    reduced = facts_of(tables.pm_sample, counter_ids).select(*key, "collect_time", _identity_tuple().alias("entity")).join(
        specs.select(*key, "kpi_code", bit.alias("_bit")), key).groupBy(*keys, "collect_time", "entity").agg(F.bit_or("_bit").alias("_bits"))

    places = specs.select(*keys, "input_alias", bit.alias("_bit")).distinct()
    per_input = reduced.join(places, keys).where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).groupBy(*keys, "input_alias").agg(
        F.count_distinct("collect_time").alias("times"), F.count_distinct("entity").alias("entities"))
    covered = specs.join(per_input, [*keys, "input_alias"], "left").groupBy(*keys).agg(
        F.count("times").alias("covered_input_aliases"),
        F.min("counter_status").alias("min_counter_verification_status"),
        F.min("times").alias("min_input_collect_times"), F.min("entities").alias("min_input_entities"))
    required = specs.groupBy(*keys).agg(F.bit_or(bit).alias("_all"))
    executed = reduced.join(required, keys).where("_bits = _all").groupBy(*keys).agg(
        F.count("*").alias("executed_rows"), F.count_distinct("collect_time").alias("executed_collect_times"),
        F.count_distinct("entity").alias("executed_entities"))
    return covered.join(executed, keys, "left").select(
        *covered.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in executed.columns[2:]])


def kpi_validation(tables: Tables, *, family: str, grain: str, dataset_family: str | None = None) -> DataFrame:
    """Validation rows of any family and grain. Site and region grain need a data-set family."""
    _check(family, grain)
    if grain != "entity-time" and not dataset_family:
        raise ValueError("dataset_family is required for site-time and region-time KPI validation")
    if grain == "entity-time" and family in KPI_CODES:
        return kpi_validation_entity(tables, family=family, dataset_family=dataset_family)
    facts = tables.pm_sample
    if dataset_family is not None:
        facts = facts.where(F.col("dataset_family") == dataset_family)
    return output_validation(tables.updated(pm_sample=facts), family=family, grain=grain.removesuffix("-time"))
