"""Verified KPIs from the semantic counter dictionary.

Facts are narrowed to the counters a KPI needs before anything is grouped, and
places are joined on after the entity aggregate, when one row per entity and
time is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from radiokpi.functions import page
from radiokpi.functions.columns import percent_ratio
from radiokpi.operators.entities import keyed_facts, with_level
from radiokpi.operators.kpi_definitions import facts_of, resolved
from radiokpi.operators.records import STATS, counter_stats, meanings, records
from radiokpi.operators.topology import PLACES, entity_topology_projection, raw_with_entity_topology, with_places
from radiokpi.schemas import CELL_FAMILIES
from radiokpi.tables import Tables

# KPI codes and counter aliases per KPI family.
KPI_CODES = {"prb": ("dl_prb_utilization", "ul_prb_utilization"), "bler": ("dl_bler", "ul_bler")}
RRC_ALIASES = {
    "rrc_connected_users_max": "max_rrc_connected_users",
    "rrc_connected_users_mean": "mean_rrc_connected_users",
    "rrc_connected_users_online": "online_rrc_connected_users",
}
ENTITY_TIME = ["dataset_family", "collect_time", "interval_start", "logical_entity_key"]


def raw_with_counter_semantics(tables: Tables) -> DataFrame:
    """Facts with places and, where the dictionary knows the counter, its alias."""
    meaning = meanings(tables, "counter_dictionary").select(
        "dataset_family", "counter_id", "counter_alias", "counter_name", "unit", "aggregation_behavior",
        F.col("verification_status").alias("counter_verification_status"), "source_note")
    joined = raw_with_entity_topology(tables).join(meaning, ["dataset_family", "counter_id"], "left")
    return joined.select(
        "source_file", "dataset_family", "interval_start", "collect_time", "logical_entity_key", "entity_level",
        *PLACES, "counter_id", "counter_value", "counter_alias", "counter_name", "unit", "aggregation_behavior",
        "counter_verification_status", "source_note")


def base_inputs(tables: Tables) -> DataFrame:
    """Statistics per entity, time and counter alias, with places added after grouping."""
    if records(tables) is not None:
        return _base_inputs_of_records(tables)
    meaning = tables.counter_dictionary.select(
        "dataset_family", "counter_id", "counter_alias", "aggregation_behavior", "unit")
    facts = keyed_facts(tables).join(meaning, ["dataset_family", "counter_id"])
    keys = [*ENTITY_TIME, "counter_alias", "aggregation_behavior", "unit"]
    stats = facts.groupBy(*keys).agg(
        F.sum("counter_value").alias("sum_counter_value"), F.avg("counter_value").alias("avg_counter_value"),
        F.min("counter_value").alias("min_counter_value"), F.max("counter_value").alias("max_counter_value"),
        F.count("*").alias("row_count"))
    return with_level(with_places(stats, tables), tables).select(
        *ENTITY_TIME, "entity_level", *PLACES, *keys[len(ENTITY_TIME):], *stats.columns[len(keys):])


def _base_inputs_of_records(tables: Tables) -> DataFrame:
    """A25 of records: statistics per counter take their alias; those of several counters of one alias are brought together."""
    meaning = meanings(tables, "counter_dictionary").select("dataset_family", "counter_id", "counter_alias", "aggregation_behavior", "unit")
    stats = counter_stats(tables, keyed_facts(tables), ENTITY_TIME, moved=True, named=lambda groups: with_level(with_places(groups, tables), tables))
    found = stats.join(meaning, ["dataset_family", "counter_id"])
    keys = [*ENTITY_TIME, "entity_level", *PLACES, "counter_alias", "aggregation_behavior", "unit"]
    if meaning.groupBy(*[c for c in meaning.columns if c != "counter_id"]).count().where("count > 1").isEmpty():
        return found.select(*keys, *STATS[2:], "row_count")
    total, values = F.sum("sum_counter_value"), F.sum("non_null_counter_value_count")
    return found.groupBy(*keys).agg(
        total.alias(STATS[2]), F.when(values > 0, total / values).alias(STATS[3]), F.min(STATS[4]).alias(STATS[4]), F.max(STATS[5]).alias(STATS[5]),
        F.sum("row_count").alias("row_count"))


def kpi_input_coverage(tables: Tables, *, kpi_codes: tuple[str, ...] | None = None, limit: int | None = None) -> DataFrame:
    """Entities, times and rows behind every KPI input, zero where no fact matches.

    ``kpi_codes`` restricts the report, and the facts it reads, to the inputs of these KPIs.
    """
    wanted_inputs = tables.kpi_formula_input if kpi_codes is None else tables.kpi_formula_input.where(F.col("kpi_code").isin(*kpi_codes))
    meaning = tables.counter_dictionary.select(
        "dataset_family", "counter_alias", "counter_id", F.col("verification_status").alias("counter_verification_status"))
    wanted, counter_ids = resolved(meaning.join(
        wanted_inputs.select("dataset_family", "counter_alias"), ["dataset_family", "counter_alias"], "left_semi"))
    per_entity = facts_of(keyed_facts(tables), counter_ids).join(
        wanted.select("dataset_family", "counter_id", "counter_alias"), ["dataset_family", "counter_id"],
    ).groupBy("dataset_family", "counter_alias", "logical_entity_key", "collect_time").agg(F.count("*").alias("row_count"))
    seen = per_entity.groupBy("dataset_family", "counter_alias").agg(
        F.count_distinct("logical_entity_key").alias("distinct_logical_entities"),
        F.count_distinct("collect_time").alias("distinct_collect_times"), F.sum("row_count").alias("row_count"))
    inputs = wanted_inputs.select("kpi_code", "input_alias", "dataset_family", "counter_alias", "required")
    names = tables.kpi_formula.select("kpi_code", "kpi_name")
    joined = (
        inputs.join(names, "kpi_code").join(meaning.drop("counter_id"), ["dataset_family", "counter_alias"], "left")
        .join(seen, ["dataset_family", "counter_alias"], "left"))
    coverage = joined.select(
        "kpi_code", "kpi_name", "input_alias", "dataset_family", "counter_alias", "required",
        "counter_verification_status",
        *[F.coalesce(c, F.lit(0)).alias(c)
          for c in ("distinct_logical_entities", "distinct_collect_times", "row_count")])
    return page(coverage, "-row_count", "kpi_code", "input_alias", "dataset_family", "counter_alias", limit=limit)


# --- PRB utilisation and block error rate ---------------------------------------------------

def _verified_inputs(tables: Tables, family: str) -> DataFrame:
    """Counters feeding the required inputs of the verified KPIs of one family.

    ``alias_rank`` orders the counter aliases of a KPI. The fact aggregate takes the
    largest rank, a number, in place of the largest alias: a text maximum would turn
    the hash aggregate over facts into a sort. ``input_bit`` stands for the input, so that
    inputs are counted as bits of one number in the same aggregate.
    """
    kpis = _verified_kpis(tables, family).select("kpi_code")
    inputs = tables.kpi_formula_input.where("required").select(
        "kpi_code", "input_alias", "dataset_family", "counter_alias")
    counters = tables.counter_dictionary.where(
        "verification_status = 'VERIFIED' and aggregation_behavior = 'SUM' and unit = 'Number'",
    ).select("dataset_family", "counter_alias", "counter_id")
    specs = kpis.join(inputs, "kpi_code").join(counters, ["dataset_family", "counter_alias"])
    by_alias = Window.partitionBy("kpi_code", "dataset_family").orderBy("counter_alias")
    by_input = Window.partitionBy("kpi_code", "dataset_family").orderBy("input_alias")
    return specs.withColumn("alias_rank", F.dense_rank().over(by_alias)).withColumn(
        "input_bit", F.call_function("shiftleft", F.lit(1).cast("long"), F.dense_rank().over(by_input) - 1))


def _verified_kpis(tables: Tables, family: str) -> DataFrame:
    return tables.kpi_formula.where(
        F.col("kpi_code").isin(*KPI_CODES[family]) & (F.col("verification_status") == "VERIFIED"))


def verified_entity_time(tables: Tables, *, family: str, limit: int | None = None) -> DataFrame:
    """K1 (prb), K2 (bler): 100·numerator/denominator per entity and time where exactly two inputs are present.

    ``topology_rollup_allowed`` is carried along and enforced nowhere.
    """
    specs, counter_ids = resolved(_verified_inputs(tables, family))
    facts = facts_of(keyed_facts(tables), counter_ids).join(
        specs.select("dataset_family", "counter_id", "kpi_code", "input_alias", "alias_rank", "input_bit"), ["dataset_family", "counter_id"])
    top, bottom = F.col("input_alias") == "numerator", F.col("input_alias") == "denominator"
    pivoted = facts.groupBy("kpi_code", *ENTITY_TIME).agg(
        F.max(F.when(top, F.col("alias_rank"))).alias("_top"), F.max(F.when(bottom, F.col("alias_rank"))).alias("_bottom"),
        F.sum(F.when(top, F.col("counter_value"))).alias("numerator_value"),
        F.sum(F.when(bottom, F.col("counter_value"))).alias("denominator_value"),
        F.bit_or("input_bit").alias("_inputs")).where("bit_count(_inputs) = 2")

    def alias_of(rank: str, name: str) -> DataFrame:
        return specs.select("kpi_code", "dataset_family", F.col("alias_rank").alias(rank),
                            F.col("counter_alias").alias(name)).distinct()

    key = ["kpi_code", "dataset_family"]
    named = (
        pivoted.join(_verified_kpis(tables, family).select(
            "kpi_code", "kpi_name", "unit", "topology_rollup_allowed"), "kpi_code")
        .join(alias_of("_top", "numerator_counter_alias"), [*key, "_top"], "left")
        .join(alias_of("_bottom", "denominator_counter_alias"), [*key, "_bottom"], "left"))
    placed = with_level(with_places(named, tables), tables)
    result = placed.select(
        "kpi_code", "kpi_name", *ENTITY_TIME, "entity_level", *PLACES,
        "numerator_counter_alias", "denominator_counter_alias", "numerator_value", "denominator_value",
        percent_ratio("numerator_value", "denominator_value").alias("kpi_value"), "unit", "topology_rollup_allowed")
    return page(result, "-collect_time", "kpi_code", "dataset_family", "logical_entity_key", "interval_start",
                limit=limit)


def verified_place_time(tables: Tables, *, family: str, place: str, limit: int | None = None) -> DataFrame:
    """K4 (prb), K5 (bler) per ``place`` 'site' or 'region': the unweighted mean of entity values."""
    entity = verified_entity_time(tables, family=family)
    rolled = entity.where(
        F.col("dataset_family").isin(*CELL_FAMILIES) & F.col(f"{place}_code").isNotNull(),
    ).groupBy("dataset_family", F.col(f"{place}_code").alias(place), "collect_time").agg(
        *[F.avg(F.when(F.col("kpi_code") == code, F.col("kpi_value"))).alias(code) for code in KPI_CODES[family]])
    return page(rolled, "-collect_time", "dataset_family", place, limit=limit)


def execution_validation(tables: Tables, *, family: str, limit: int | None = None) -> DataFrame:
    """K7 (prb), K8 (bler): input coverage beside the rows actually produced, from one reduction of the facts.

    The facts become one row per entity and time with the counters seen as bits of a number. What is covered and what
    is executed are then questions to that number: an input is seen where one of its counters is, a KPI has a row where
    exactly two of its inputs are. Both are put at once, so facts are read and reduced once.
    """
    keys = ["kpi_code", "dataset_family"]
    inputs = tables.kpi_formula_input.where(F.col("kpi_code").isin(*KPI_CODES[family])).join(
        tables.kpi_formula.select("kpi_code", (F.col("verification_status") == "VERIFIED").alias("_kpi")), "kpi_code").select(
        *keys, "input_alias", "counter_alias", (F.col("required") & F.col("_kpi")).alias("_used"))
    usable = (F.col("verification_status") == "VERIFIED") & (F.col("aggregation_behavior") == "SUM") & (F.col("unit") == "Number")
    counters = tables.counter_dictionary.select(
        "dataset_family", "counter_alias", "counter_id", usable.alias("_usable"), F.col("verification_status").alias("counter_status"))
    by_counter = Window.partitionBy("dataset_family").orderBy("counter_id")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.dense_rank().over(by_counter) - 1)
    specs, counter_ids = resolved(inputs.join(counters, ["dataset_family", "counter_alias"]).select(
        *keys, "input_alias", "counter_alias", "counter_id", (F.col("_used") & F.col("_usable")).alias("_used"), bit.alias("_bit")))

    def small(frame: DataFrame) -> DataFrame:
        # The hint is safe: rows that were resolved are counted.
        return frame if counter_ids is None else F.broadcast(frame)

    seen = facts_of(keyed_facts(tables), counter_ids).join(
        small(specs.select("dataset_family", "counter_id", "_bit").distinct()), ["dataset_family", "counter_id"])
    reduced = seen.groupBy(*ENTITY_TIME).agg(F.bit_or("_bit").alias("_bits"))
    # What is asked of a row: of ``masks`` exactly ``needed`` have a bit in it.
    covers = specs.groupBy("dataset_family", "counter_alias").agg(F.bit_or("_bit").alias("mask")).select(
        "dataset_family", F.lit("input").alias("kind"), F.col("counter_alias").alias("name"), F.array("mask").alias("masks"), F.lit(1).alias("needed"))
    executes = specs.where("_used").groupBy(*keys, "input_alias").agg(F.bit_or("_bit").alias("mask")).groupBy(*keys).agg(
        F.collect_list("mask").alias("masks")).select(
        "dataset_family", F.lit("kpi").alias("kind"), F.col("kpi_code").alias("name"), "masks", F.lit(2).alias("needed"))
    present = F.size(F.filter("masks", lambda mask: mask.bitwiseAND(F.col("_bits")) != 0))
    found = reduced.join(small(covers.union(executes)), "dataset_family").where(present == F.col("needed")).groupBy(
        "dataset_family", "kind", "name").agg(
        F.count("*").alias("rows"), F.count_distinct("collect_time").alias("times"), F.count_distinct("logical_entity_key").alias("entities"))

    status = counters.select("dataset_family", "counter_alias", "counter_status")
    asked = inputs.join(status, ["dataset_family", "counter_alias"], "left").select(
        *keys, F.lit("input").alias("kind"), F.col("counter_alias").alias("name"), "input_alias", "counter_status")
    asked = asked.union(inputs.select(*keys, F.lit("kpi"), F.col("kpi_code"), F.lit(None).cast("string"), F.lit(None).cast("string")).distinct())
    is_input, is_kpi = F.col("kind") == "input", F.col("kind") == "kpi"
    joined = asked.join(found, ["dataset_family", "kind", "name"], "left").groupBy(*keys).agg(
        F.count_distinct("input_alias").alias("covered_input_aliases"), F.min("counter_status").alias("min_counter_verification_status"),
        F.min(F.when(is_input, F.coalesce("times", F.lit(0)))).alias("min_input_collect_times"),
        F.min(F.when(is_input, F.coalesce("entities", F.lit(0)))).alias("min_input_entities"),
        *[F.coalesce(F.max(F.when(is_kpi, F.col(c))), F.lit(0)).alias(f"executed_{name}")
          for c, name in (("rows", "rows"), ("times", "collect_times"), ("entities", "entities"))])
    return page(joined, "kpi_code", "dataset_family", limit=limit)


# --- connected users ------------------------------------------------------------------------

def verified_rrc_entity_time(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """K3: largest maximum, mean and online count per entity and time over its intervals."""
    counters = tables.counter_dictionary.where(
        F.col("dataset_family").isin(*CELL_FAMILIES) & F.col("counter_alias").isin(*RRC_ALIASES.values())
        & (F.col("verification_status") == "VERIFIED"),
    ).select("dataset_family", "counter_id", "counter_alias", "aggregation_behavior", "unit")
    facts = keyed_facts(tables).join(counters, ["dataset_family", "counter_id"])
    stats = facts.groupBy(*ENTITY_TIME, "counter_alias", "aggregation_behavior", "unit").agg(
        F.max("counter_value").alias("max"), F.avg("counter_value").alias("mean"), F.sum("counter_value").alias("online"))
    pivoted = stats.groupBy("dataset_family", "logical_entity_key", "collect_time").agg(
        *[F.max(F.when(F.col("counter_alias") == alias, F.col(name.rsplit("_", 1)[1]))).alias(name)
          for name, alias in RRC_ALIASES.items()])
    return page(pivoted, "-collect_time", "dataset_family", "logical_entity_key", limit=limit)


def rrc_topology_join(tables: Tables) -> DataFrame:
    """Connected users with the place of their entity."""
    places = entity_topology_projection(tables).select(
        "logical_entity_key", "dataset_family", "site_code", "region_code")
    return verified_rrc_entity_time(tables).join(places, ["logical_entity_key", "dataset_family"])


def verified_rrc_place_time(tables: Tables, *, place: str, limit: int | None = None) -> DataFrame:
    """K6: maximum of the maxima, mean of the means, sum of the online users."""
    rolled = rrc_topology_join(tables).where(F.col(f"{place}_code").isNotNull()).groupBy(
        "dataset_family", F.col(f"{place}_code").alias(place), "collect_time").agg(
        F.max("rrc_connected_users_max").alias("rrc_connected_users_max"),
        F.avg("rrc_connected_users_mean").alias("rrc_connected_users_mean"),
        F.sum("rrc_connected_users_online").alias("rrc_connected_users_online"))
    return page(rolled, "-collect_time", "dataset_family", place, limit=limit)


# --- output validation ----------------------------------------------------------------------

def output_validation(tables: Tables, *, family: str, grain: str) -> DataFrame:
    """K9 (rrc by entity), K10 (by site), K11 (by region): rows and non-NULL values per data-set family."""
    if grain == "entity":
        rows = verified_rrc_entity_time(tables)
    elif family == "rrc":
        rows = verified_rrc_place_time(tables, place=grain)
    else:
        rows = verified_place_time(tables, family=family, place=grain)
    values = list(RRC_ALIASES) if family == "rrc" else list(KPI_CODES[family])
    return rows.where(F.col("dataset_family").isin(*CELL_FAMILIES)).groupBy("dataset_family").agg(
        F.count("*").alias(f"{grain}_time_rows"), *[F.count(v).alias(f"rows_with_{v}") for v in values])
