"""Coverage and completeness reports over the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from radiokpi.functions import first_per, page
from radiokpi.functions.columns import percent_of
from radiokpi.operators.activity import counter_activity, entity_activity, rows_by_file_time
from radiokpi.operators.entities import SHAPE, keyed_facts, with_level
from radiokpi.operators.records import STATS, counted, counter_stats, meanings, records, unpivoted
from radiokpi.schemas import CELL_FAMILIES
from radiokpi.tables import Tables

COUNTS = ("row_count", "non_null_counter_value_count")
REFERENCE = ("vendor", "technology", "object_type", "description", "unit")


def _row_counts() -> list:
    return [F.count("*").alias(COUNTS[0]), F.count("counter_value").alias(COUNTS[1])]


def _with_reference(frame: DataFrame, tables: Tables) -> DataFrame:
    return frame.join(meanings(tables, "counter_reference").select("counter_id", *REFERENCE), "counter_id", "left")


def _with_ani_entity(frame: DataFrame, tables: Tables) -> DataFrame:
    known = tables.ani_entity.select("ani", "logical_entity_key", "site_code", "region_name")
    return frame.join(known, "ani", "left")


# --- counts straight from facts -------------------------------------------------------------

def counts_by_source_file(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """A1."""
    counts = tables.pm_sample.groupBy("source_file", "dataset_family", "interval_start", "revision").agg(*_row_counts())
    return page(counts, "-row_count", "source_file", "dataset_family", "interval_start", "revision", limit=limit)


def counts_by_collect_time(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """A2."""
    counts = tables.pm_sample.groupBy("collect_time", "dataset_family").agg(*_row_counts())
    return page(counts, "-collect_time", "dataset_family", limit=limit)


def counts_by_ani(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """A3: counted per ani and dimensions first, named afterwards."""
    counts = tables.pm_sample.groupBy(*SHAPE).agg(*_row_counts())
    named = _with_ani_entity(counts, tables).select(
        "ani", *SHAPE[:-1], "logical_entity_key", "site_code", "region_name", *COUNTS)
    return page(named, "-row_count", "ani", *SHAPE[:-1], limit=limit)


def counts_by_counter(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """A4; with a limit, the top counters."""
    counts = tables.pm_sample.groupBy("counter_id").agg(*_row_counts())
    named = _with_reference(counts, tables).select("counter_id", *REFERENCE, *COUNTS)
    return page(named, "-row_count", "counter_id", limit=limit)


def counter_agg_by_time_counter(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """A5."""
    keys = ["collect_time", "dataset_family", "counter_id"]
    stats = counter_stats(tables, tables.pm_sample, keys[:-1])
    named = _with_reference(stats, tables).select(*keys, *REFERENCE, *STATS)
    return page(named, "-collect_time", "counter_id", "dataset_family", limit=limit)


def counter_agg_by_time_ani_counter(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """A6."""
    keys = ["collect_time", "ani", *SHAPE[:-1], "counter_id"]
    stats = counter_stats(tables, tables.pm_sample, keys[:-1], moved=True, named=lambda groups: _with_ani_entity(groups, tables))
    named = _with_reference(stats, tables).select(
        *keys[:-1], "logical_entity_key", "site_code", "region_name", "counter_id", *REFERENCE,
        *STATS)
    return page(named, "-collect_time", "ani", "counter_id", *SHAPE[:-1], limit=limit)


# --- entity grain ---------------------------------------------------------------------------

def counter_agg_by_entity_time_counter(tables: Tables) -> DataFrame:
    """A10."""
    keys = ["dataset_family", "logical_entity_key", "collect_time", "interval_start"]
    stats = counter_stats(tables, keyed_facts(tables), keys, moved=True, named=lambda groups: with_level(groups, tables))
    return stats.select("dataset_family", "entity_level", *keys[1:], "counter_id", *STATS)


def kpi_scope_entity_counter_base(tables: Tables) -> DataFrame:
    """A11."""
    return counter_agg_by_entity_time_counter(tables).select(
        "dataset_family", "entity_level", "logical_entity_key", "collect_time", "interval_start", "counter_id",
        *COUNTS, "sum_counter_value", "avg_counter_value", "min_counter_value", "max_counter_value")


def entity_counter_summary(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """Rows, entities and times per counter. Reduced to one row per entity, time and counter first."""
    if (found := records(tables)) is not None:
        return page(_summary_of_records(tables, *found), "-row_count", "dataset_family", "counter_id", "entity_level", limit=limit)
    per_entity = keyed_facts(tables).groupBy(
        "dataset_family", "logical_entity_key", "collect_time", "counter_id").agg(*_row_counts())
    summary = with_level(per_entity, tables).groupBy("dataset_family", "entity_level", "counter_id").agg(
        F.count_distinct("logical_entity_key").alias("distinct_entities"),
        F.count_distinct("collect_time").alias("distinct_collect_times"),
        *[F.sum(c).alias(c) for c in COUNTS])
    return page(summary, "-row_count", "dataset_family", "counter_id", "entity_level", limit=limit)


def _summary_of_records(tables: Tables, wide: DataFrame, counters: list[str]) -> DataFrame:
    """A29 of records: every counter has the same entities and times, so these are counted once."""
    keys = ["dataset_family", "logical_entity_key"]
    entities = with_level(wide.groupBy(*keys).agg(F.count("*").alias("row_count"), *[F.count(c).alias(c) for c in counters]), tables).groupBy(
        "dataset_family", "entity_level").agg(F.count("*").alias("distinct_entities"), *[F.sum(c).alias(c) for c in ("row_count", *counters)])
    times = with_level(wide.select(*keys, "collect_time").distinct(), tables).groupBy("dataset_family", "entity_level").agg(
        F.count_distinct("collect_time").alias("distinct_collect_times"))
    t = times.select(F.col("dataset_family").alias("_f"), F.col("entity_level").alias("_l"), "distinct_collect_times")
    joined = entities.join(t, F.col("dataset_family").eqNullSafe(F.col("_f")) & (F.col("entity_level") == F.col("_l")))
    return unpivoted(joined.drop("_f", "_l"), counters).select(
        "dataset_family", "entity_level", "counter_id", "distinct_entities", "distinct_collect_times", "row_count", F.col("counter_value").alias(COUNTS[1]))


def logical_entity_counts_by_time(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """A12."""
    keys = ["dataset_family", "entity_level", "collect_time", "interval_start"]
    counts = with_level(entity_activity(tables), tables).groupBy(*keys).agg(
        F.count_distinct("logical_entity_key").alias("distinct_logical_entity_keys"))
    return page(counts, "-collect_time", "dataset_family", "entity_level", "interval_start", limit=limit)


def cell_entity_counts_timeline(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """A13."""
    cells = with_level(entity_activity(tables), tables).where("entity_level = 'cell'")
    counts = cells.groupBy("dataset_family", "collect_time", "interval_start").agg(
        F.count_distinct("logical_entity_key").alias("distinct_cell_entities"))
    return page(counts, "-collect_time", "dataset_family", "interval_start", limit=limit)


def cell_entity_counts_by_interval(tables: Tables) -> DataFrame:
    """A13, interval first."""
    return cell_entity_counts_timeline(tables).select(
        "dataset_family", "interval_start", "collect_time", "distinct_cell_entities")


def entity_counter_coverage(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """The times of an entity and its counters are reduced apart, then joined at entity grain."""
    keys = ["dataset_family", "logical_entity_key"]
    times = entity_activity(tables).groupBy(*keys, "collect_time").agg(F.lit(1).alias("_seen")).groupBy(*keys).agg(
        F.count("*").alias("distinct_collect_times"),
        F.min("collect_time").alias("min_collect_time"), F.max("collect_time").alias("max_collect_time"))
    counters = keyed_facts(tables).select(*keys, "counter_id").distinct().groupBy("logical_entity_key").agg(
        F.count("*").alias("distinct_counter_ids"))
    joined = with_level(times.join(counters, "logical_entity_key"), tables).select(
        "dataset_family", "entity_level", "logical_entity_key", "distinct_counter_ids", "distinct_collect_times",
        "min_collect_time", "max_collect_time")
    return page(joined, "-distinct_collect_times", "-distinct_counter_ids", "logical_entity_key", limit=limit)


def family_interval_coverage(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """Five distinct counts, four on the entity activity and one on the counter activity."""
    keys = ["dataset_family", "interval_start"]
    entities = with_level(entity_activity(tables), tables).groupBy(*keys).agg(
        F.min("collect_time").alias("min_collect_time"),
        F.max("collect_time").alias("max_collect_time"),
        F.count_distinct("source_file").alias("distinct_source_files"),
        F.count_distinct("revision").alias("distinct_revisions"),
        F.count_distinct("logical_entity_key").alias("distinct_logical_entity_keys"),
        F.count_distinct(F.when(F.col("entity_level") == "cell", F.col("logical_entity_key"))).alias(
            "distinct_cell_entities"),
        F.sum("row_count").alias("row_count"))
    counters = counter_activity(tables).groupBy(*keys).agg(F.count_distinct("counter_id").alias("distinct_counter_ids"))
    c = counters.select(F.col("dataset_family").alias("_f"), F.col("interval_start").alias("_i"), "distinct_counter_ids")
    joined = entities.join(
        c, entities.dataset_family.eqNullSafe(c["_f"]) & entities.interval_start.eqNullSafe(c["_i"]))
    coverage = joined.select(*entities.columns[:-1], "distinct_counter_ids", "row_count")
    return page(coverage, "-interval_start", "dataset_family", limit=limit)


def daily_family_coverage(tables: Tables) -> DataFrame:
    """A18."""
    active = with_level(entity_activity(tables), tables).withColumn("collect_date", F.to_date("collect_time"))
    return active.groupBy("dataset_family", "collect_date").agg(
        F.sum("row_count").alias("row_count"),
        F.count_distinct("source_file").alias("distinct_source_files"),
        F.count_distinct("collect_time").alias("distinct_collect_times"),
        F.count_distinct("logical_entity_key").alias("distinct_logical_entities"),
        F.count_distinct(F.when(F.col("entity_level") == "cell", F.col("logical_entity_key"))).alias(
            "distinct_cell_entities"))


def daily_combined_coverage(tables: Tables) -> DataFrame:
    """Sums of the two cell families, as reported per family."""
    per_family = daily_family_coverage(tables).where(F.col("dataset_family").isin(*CELL_FAMILIES))
    return per_family.groupBy("collect_date").agg(
        F.sum("distinct_cell_entities").alias("combined_observed_cells"),
        *[F.sum(c).alias(c) for c in ("row_count", "distinct_source_files", "distinct_collect_times")])


def combined_cell_timeline(tables: Tables) -> DataFrame:
    """Distinct cells of the two families added up per time; not a distinct union."""
    cells = cell_entity_counts_timeline(tables).where(F.col("dataset_family").isin(*CELL_FAMILIES))
    return cells.groupBy("collect_time", "interval_start").agg(
        F.sum("distinct_cell_entities").alias("combined_observed_cells"))


def compare_expected_cells_timeline(tables: Tables, *, expected: int, limit: int | None = None) -> DataFrame:
    """A16 against an expected number of cells."""
    observed = F.col("combined_observed_cells")
    compared = combined_cell_timeline(tables).select(
        "collect_time", "interval_start", observed.alias("observed_cells"),
        F.lit(expected).cast("bigint").alias("expected_cells"), (F.lit(expected) - observed).alias("cell_gap"),
        percent_of(observed, expected).alias("coverage_pct"))
    return page(compared, "-collect_time", "-interval_start", limit=limit)


def compare_expected_cells(tables: Tables, *, expected: int) -> DataFrame:
    """Newest interval per family beside the combined total of the cell families.

    The total is one value, read through a scalar subquery.
    """
    newest = first_per(
        cell_entity_counts_by_interval(tables), ["dataset_family"],
        largest=[F.col("interval_start").isNull().alias("no_interval"), F.col("interval_start"), F.col("collect_time")])
    total = newest.where(F.col("dataset_family").isin(*CELL_FAMILIES)).agg(
        F.sum("distinct_cell_entities").alias("combined_observed_cells"))
    observed, combined = F.col("distinct_cell_entities"), F.col("combined_observed_cells")
    return newest.withColumn("combined_observed_cells", total.scalar()).select(
        "dataset_family", "interval_start", "collect_time", observed.alias("observed_cells"),
        F.lit(expected).cast("bigint").alias("expected_cells"), (F.lit(expected) - observed).alias("cell_gap"),
        percent_of(observed, expected).alias("coverage_pct"), "combined_observed_cells",
        (F.lit(expected) - combined).alias("combined_cell_gap"),
        percent_of(combined, expected).alias("combined_coverage_pct"))


# --- whole-table summaries ------------------------------------------------------------------

def dataset_family_summary(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """Grouped by the raw family, so NULL and a literal UNKNOWN stay two rows."""
    frame, rows, _ = counted(tables, tables.pm_sample)
    found = records(tables)
    # A record holds every counter, so records need not be told apart by counter.
    held = ["counter_id"] if found is None else []
    shapes = frame.groupBy("dataset_family", "source_file", "ani", *held).agg(
        rows.alias("row_count"), F.min("collect_time").alias("first_time"), F.max("collect_time").alias("last_time"))
    summary = shapes.groupBy("dataset_family").agg(
        F.sum("row_count").alias("row_count"),
        F.count_distinct("source_file").alias("distinct_source_files"),
        F.count_distinct("counter_id").alias("distinct_counter_ids") if found is None else F.lit(len(found[1])).cast("bigint").alias("distinct_counter_ids"),
        F.count_distinct("ani").alias("distinct_ani"),
        F.min("first_time").alias("min_collect_time"), F.max("last_time").alias("max_collect_time"))
    named = summary.withColumn("dataset_family", F.coalesce("dataset_family", F.lit("UNKNOWN")))
    return page(named, "-row_count", "dataset_family", limit=limit)


def _shape_counts(tables: Tables) -> DataFrame:
    dims = ["sbnid", "enbid", "enodebid", "cellid", "meid"]
    family = F.coalesce("dataset_family", F.lit("UNKNOWN")).alias("dataset_family")
    frame, rows, _ = counted(tables, tables.pm_sample)
    return frame.groupBy(family, *dims).agg(rows.alias("row_count"))


def entity_field_summary(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """Here NULL family and UNKNOWN are one group."""
    summary = _shape_counts(tables).groupBy("dataset_family").agg(
        F.sum("row_count").alias("row_count"),
        *[F.count_distinct(c).alias(f"distinct_{c}") for c in ("sbnid", "enbid", "enodebid", "cellid", "meid")])
    return page(summary, "-row_count", "dataset_family", limit=limit)


def distinct_cells(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """Distinct dimension tuples; a tuple with NULL members counts."""
    counts = _shape_counts(tables).groupBy("dataset_family").agg(F.count("*").alias("distinct_cell_keys"))
    return page(counts, "-distinct_cell_keys", "dataset_family", limit=limit)


def rows_by_source_files(tables: Tables, source_files: DataFrame) -> DataFrame:
    """Fact rows per file of ``source_files`` (column source_file)."""
    return rows_by_file_time(tables, source_files).groupBy("source_file").agg(F.sum("row_count").alias("row_count"))


def newest_days(activity: DataFrame, rows: int) -> list:
    """Days (newest first, NULL before all) that hold the ``rows`` newest fact rows, by the counts of the counter activity.

    Every day has a row, so at most ``rows`` days are looked at, one small row for each.
    """
    days = activity.groupBy(F.to_date("collect_time").alias("day")).agg(F.sum("row_count").alias("n"))
    chosen, held = [], 0
    for day, n in days.orderBy(F.desc_nulls_first("day")).limit(rows).collect():
        if held >= rows:
            break
        chosen.append(day)
        held += n
    return chosen


def recent_facts(tables: Tables, *, limit: int) -> DataFrame:
    """Newest rows by collect time; the remaining columns make the order total.

    Where the counter activity is stored and facts lie by day, only the days that hold the newest rows are read.
    """
    columns = ["source_file", "dataset_family", "revision", "csv_name", "collect_time", "ani", "sbnid", "enbid",
               "enodebid", "cellid", "meid", "counter_id", "counter_value"]
    facts = tables.pm_sample
    if "counter_activity" in tables and "collect_date" in facts.columns:
        days = newest_days(tables["counter_activity"], limit)
        dated = F.col("collect_date").isin([d for d in days if d is not None])
        facts = facts.where(dated | F.col("collect_date").isNull() if None in days else dated)
    return page(facts.select(*columns), "-collect_time", *[c for c in columns if c != "collect_time"], limit=limit)


def counter_mapping_gaps(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """Counters seen in facts without a dictionary entry. Rows without a family are gaps too."""
    mapped = tables.counter_dictionary.select("dataset_family", "counter_id")
    gaps = keyed_facts(tables).join(mapped, ["dataset_family", "counter_id"], "left_anti")
    counts = gaps.groupBy("dataset_family", "counter_id").agg(
        F.count("*").alias("row_count"),
        F.count_distinct("logical_entity_key").alias("distinct_logical_entities"),
        F.min("collect_time").alias("min_collect_time"), F.max("collect_time").alias("max_collect_time"))
    return page(counts, "-row_count", "dataset_family", "counter_id", limit=limit)


# --- topology coverage ----------------------------------------------------------------------

def _entity_times(tables: Tables) -> DataFrame:
    return entity_activity(tables).groupBy("dataset_family", "logical_entity_key", "collect_time").agg(
        F.sum("row_count").alias("row_count"))


def _topology_coverage(tables: Tables, place: list[str]) -> DataFrame:
    places = tables.topo_enrichment.join(
        tables.entity_identity.select("logical_entity_key"), "logical_entity_key", "left_semi",
    ).where(F.col(place[0]).isNotNull()).select("logical_entity_key", *place)
    active = _entity_times(tables).join(places, "logical_entity_key")
    return active.groupBy(*place, "dataset_family").agg(
        F.count_distinct("logical_entity_key").alias("distinct_logical_entities"),
        F.count_distinct("collect_time").alias("distinct_collect_times"),
        F.sum("row_count").alias("row_count"))


def site_coverage(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """A20."""
    coverage = _topology_coverage(tables, ["site_code", "site_name", "region_code", "region_name"])
    return page(coverage, "-row_count", "site_code", "dataset_family", limit=limit)


def region_coverage(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """A21."""
    coverage = _topology_coverage(tables, ["region_code", "region_name"])
    return page(coverage, "-row_count", "region_code", "dataset_family", limit=limit)


def interval_topology_coverage(tables: Tables, source_files: DataFrame) -> DataFrame:
    """Cells per interval in the given files, split into mapped and unmapped.

    Read from the entity activity, so the file list meets one row per entity, interval and file.
    """
    seen = entity_activity(tables).where(F.col("dataset_family").isin(*CELL_FAMILIES)).join(
        source_files.select("source_file"), "source_file", "left_semi")
    cells = seen.select("interval_start", "logical_entity_key").distinct()
    status = tables.topo_enrichment.select("logical_entity_key", "mapping_status")
    mapped = F.coalesce(F.col("mapping_status") != "UNMAPPED", F.lit(False))
    return cells.join(status, "logical_entity_key", "left").groupBy("interval_start").agg(
        F.count_if(mapped).alias("topology_mapped_count"), F.count_if(~mapped).alias("topology_unmapped_count"))
