"""Registered coverage queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from radiokpi.operators import coverage as c, entities as e, topology as t
from radiokpi.operators.kpi_results import collect_time_window, latest_window
from radiokpi.plans.query import PLACES, Query
from radiokpi.schemas import SDR_CELL
from radiokpi.sources.manifest import aligned_interval, filter_families, filter_time_range, request_window, revision_policy, time_window_args

_N = "count(*) as row_count, count(counter_value) as non_null_counter_value_count"
_STATS = ("sum(counter_value) as sum_counter_value, avg(counter_value) as avg_counter_value, "
          "min(counter_value) as min_counter_value, max(counter_value) as max_counter_value")
_D = "sum_counter_value avg_counter_value min_counter_value max_counter_value"
_REF = "vendor, technology, object_type, description, unit"
_DIMS = "sbnid, enbid, enodebid, cellid, meid"
_FACT = ("source_file, dataset_family, interval_start, revision, csv_name, collect_time, trncmeid, ani, sbnid, enbid, enodebid, "
         "cellid, meid, systemmode, midflag, netype, counter_id, counter_value")
_DISTINCT_DIMS = ", ".join(f"count(distinct {d}) as distinct_{d}" for d in _DIMS.split(", "))
_EXPECTED = 250
_NOON, _DAY3 = datetime(2026, 3, 1, 12), datetime(2026, 3, 3)
_WINDOW = "cast('2026-03-01 12:00:00' as timestamp)", "cast('2026-03-03 00:00:00' as timestamp)"


def _policy(policy):
    return lambda t: revision_policy(
        t.pm_wide.select("dataset_family", "interval_start", "revision", "source_file").where(
            "dataset_family is not null").distinct(), policy)


_FILES = "(select distinct dataset_family, interval_start, revision, source_file from pm_wide where dataset_family is not null) as f"
_REG = ["id", "dataset_family", "interval_start", "revision"]

RECENT = f"""
        select source_file, dataset_family, revision, csv_name, collect_time, ani, {_DIMS}, counter_id, counter_value from pm_sample
        order by collect_time desc nulls first, source_file, dataset_family nulls last, revision nulls last, csv_name, ani nulls last,
          sbnid, enbid nulls last, enodebid nulls last, cellid, meid nulls last, counter_id, counter_value nulls last limit 200"""
PLACED = f"""
        select {_FACT}, logical_entity_key as derived_logical_entity_key, own_level as derived_entity_level, logical_entity_key,
          entity_level, {PLACES}, mapping_status from placed"""
LATEST = f"""
    select collect_time, counter_id, count(*) as row_count, sum(counter_value) as sum_counter_value from pm_sample
    where dataset_family = '{SDR_CELL}' and collect_time = (select max(collect_time) from pm_sample where dataset_family = '{SDR_CELL}')
    group by all"""

QUERIES = [
    # --- counts straight from facts
    Query("counts_by_source_file", c.counts_by_source_file,
          f"select source_file, dataset_family, interval_start, revision, {_N} from pm_sample group by all"),
    Query("counts_by_collect_time", c.counts_by_collect_time, f"select collect_time, dataset_family, {_N} from pm_sample group by all"),
    Query("counts_by_ani", c.counts_by_ani, f"""
        select s.ani, dataset_family, {_DIMS}, logical_entity_key, site_code, region_name, {_N}
        from pm_sample s left join ani_entity a on a.ani = s.ani group by all"""),
    Query("counts_by_counter", c.counts_by_counter, f"""
        select counter_id, {_REF}, {_N} from pm_sample left join counter_reference using (counter_id) group by all"""),
    Query("top_counters", lambda t: c.counts_by_counter(t, limit=5), f"""
        select counter_id, {_REF}, {_N} from pm_sample left join counter_reference using (counter_id) group by all
        order by row_count desc, counter_id limit 5"""),
    Query("counter_agg_by_time_counter", c.counter_agg_by_time_counter, f"""
        select collect_time, dataset_family, counter_id, {_REF}, {_N}, {_STATS}
        from pm_sample left join counter_reference using (counter_id) group by all""", _D),
    Query("counter_agg_by_time_ani_counter", c.counter_agg_by_time_ani_counter, f"""
        select collect_time, s.ani, dataset_family, {_DIMS}, logical_entity_key, site_code, region_name, s.counter_id, {_REF},
          {_N}, {_STATS} from pm_sample s left join ani_entity a on a.ani = s.ani
          left join counter_reference r on r.counter_id = s.counter_id group by all""", _D),
    Query("recent_facts", lambda t: c.recent_facts(t, limit=200), RECENT, "counter_value"),

    # --- entities
    Query("entity_key", e.entity_keys, "select distinct dataset_family, logical_entity_key, entity_level from shapes"),
    Query("distinct_entities", e.distinct_entities, f"select dataset_family, {_DIMS}, ani, logical_entity_key, entity_level from shapes"),
    Query("entity_summary_by_family", e.entity_summary_by_family, f"""
        select dataset_family, entity_level, count(*) as distinct_logical_entity_keys, {_DISTINCT_DIMS} from shapes group by all"""),
    Query("sync_entities", e.sync_entities, f"""
        select logical_entity_key, dataset_family, r.sbnid, r.enbid, r.enodebid, r.cellid, r.meid, r.ani, entity_level, notes from (
          select s.logical_entity_key, s.dataset_family, s.entity_level, first({{'sbnid': s.sbnid, 'enbid': s.enbid, 'enodebid': s.enodebid,
              'cellid': s.cellid, 'meid': s.meid, 'ani': s.ani}} order by s.sbnid nulls last, s.enbid nulls last, s.enodebid nulls last,
              s.cellid nulls last, s.meid nulls last, s.ani nulls last) as r, any_value(i.notes) as notes
          from shapes s left join entity_identity i using (logical_entity_key) where s.dataset_family is not null
          group by s.logical_entity_key, s.dataset_family, s.entity_level)"""),
    Query("entity_identity_list", lambda t: e.entity_identity_list(t, limit=100), f"""
        select logical_entity_key, dataset_family, {_DIMS}, ani, entity_level, notes from entity_identity
        order by dataset_family, logical_entity_key limit 100"""),
    Query("raw_with_entity", e.raw_with_entity, f"""
        select {_FACT}, logical_entity_key as derived_logical_entity_key, own_level as derived_entity_level, logical_entity_key, entity_level
        from raw_entity""", "counter_value"),
    Query("counter_agg_by_entity_time_counter", c.counter_agg_by_entity_time_counter, f"""
        select dataset_family, entity_level, logical_entity_key, collect_time, interval_start, counter_id, {_N}, {_STATS}
        from raw_entity group by all""", _D),
    Query("kpi_scope_entity_counter_base", c.kpi_scope_entity_counter_base, f"""
        select dataset_family, entity_level, logical_entity_key, collect_time, interval_start, counter_id, {_N}, {_STATS}
        from raw_entity group by all""", _D),
    Query("entity_counter_summary", c.entity_counter_summary, f"""
        select dataset_family, entity_level, counter_id, count(distinct logical_entity_key) as distinct_entities,
          count(distinct collect_time) as distinct_collect_times, {_N} from raw_entity group by all"""),
    Query("logical_entity_counts_by_time", c.logical_entity_counts_by_time, """
        select dataset_family, entity_level, collect_time, interval_start,
          count(distinct logical_entity_key) as distinct_logical_entity_keys from raw_entity group by all"""),
    Query("cell_entity_counts_timeline", c.cell_entity_counts_timeline, "select * from cells"),
    Query("cell_entity_counts_by_interval", c.cell_entity_counts_by_interval, "select * from cells"),
    Query("entity_counter_coverage", c.entity_counter_coverage, """
        select dataset_family, entity_level, logical_entity_key, count(distinct counter_id) as distinct_counter_ids,
          count(distinct collect_time) as distinct_collect_times, min(collect_time) as min_collect_time,
          max(collect_time) as max_collect_time from raw_entity group by all"""),
    Query("family_interval_coverage", c.family_interval_coverage, """
        select dataset_family, interval_start, min(collect_time) as min_collect_time, max(collect_time) as max_collect_time,
          count(distinct source_file) as distinct_source_files, count(distinct revision) as distinct_revisions,
          count(distinct logical_entity_key) as distinct_logical_entity_keys,
          count(distinct if(entity_level = 'cell', logical_entity_key, null)) as distinct_cell_entities,
          count(distinct counter_id) as distinct_counter_ids, count(*) as row_count from raw_entity group by all"""),
    Query("daily_family_coverage", c.daily_family_coverage, "select * from daily"),
    Query("daily_combined_coverage", c.daily_combined_coverage, """
        select collect_date, cast(sum(distinct_cell_entities) as bigint) as combined_observed_cells,
          cast(sum(row_count) as bigint) as row_count, cast(sum(distinct_source_files) as bigint) as distinct_source_files,
          cast(sum(distinct_collect_times) as bigint) as distinct_collect_times
        from daily where dataset_family like '%/ltefdd' group by all"""),
    Query("combined_ltefdd_timeline", c.combined_cell_timeline, """
        select collect_time, interval_start, cast(sum(distinct_cell_entities) as bigint) as combined_observed_cells
        from cells where dataset_family like '%/ltefdd' group by all"""),
    Query("compare_expected_cells_timeline", lambda t: c.compare_expected_cells_timeline(t, expected=_EXPECTED), f"""
        select collect_time, interval_start, n as observed_cells, cast({_EXPECTED} as bigint) as expected_cells,
          {_EXPECTED} - n as cell_gap, n * 100.0::double / {_EXPECTED} as coverage_pct
        from (select collect_time, interval_start, cast(sum(distinct_cell_entities) as bigint) as n
              from cells where dataset_family like '%/ltefdd' group by all)""", "coverage_pct"),
    Query("compare_expected_cells", lambda t: c.compare_expected_cells(t, expected=_EXPECTED), f"""
        with newest as (select dataset_family, unnest(max_by({{'i': interval_start, 'c': collect_time, 'n': distinct_cell_entities}},
            row(interval_start is null, interval_start, collect_time))) from cells group by dataset_family),
          total as (select cast(sum(n) as bigint) as all_cells from newest where dataset_family like '%/ltefdd')
        select dataset_family, i as interval_start, c as collect_time, n as observed_cells, cast({_EXPECTED} as bigint) as expected_cells,
          {_EXPECTED} - n as cell_gap, n * 100.0::double / {_EXPECTED} as coverage_pct, all_cells as combined_observed_cells,
          {_EXPECTED} - all_cells as combined_cell_gap, all_cells * 100.0::double / {_EXPECTED} as combined_coverage_pct
        from newest, total""", "coverage_pct combined_coverage_pct"),
    Query("dataset_family_summary", c.dataset_family_summary, """
        select ifnull(f, 'UNKNOWN') as dataset_family, row_count, distinct_source_files, distinct_counter_ids, distinct_ani,
          min_collect_time, max_collect_time
        from (select dataset_family as f, count(*) as row_count, count(distinct source_file) as distinct_source_files,
          count(distinct counter_id) as distinct_counter_ids, count(distinct ani) as distinct_ani,
          min(collect_time) as min_collect_time, max(collect_time) as max_collect_time from pm_sample group by dataset_family)"""),
    Query("entity_field_summary", c.entity_field_summary, f"""
        select ifnull(dataset_family, 'UNKNOWN') as dataset_family, count(*) as row_count, {_DISTINCT_DIMS} from pm_sample group by 1"""),
    Query("distinct_cells", c.distinct_cells, f"""
        select ifnull(dataset_family, 'UNKNOWN') as dataset_family, count(distinct row({_DIMS})) as distinct_cell_keys
        from pm_sample group by 1"""),
    Query("rows_by_source_files",
          lambda t: c.rows_by_source_files(t, t.file_registry.where("status = 'INGESTED'").select(
              F.col("remote_filename").alias("source_file"))), """
        select source_file, count(*) as row_count from pm_sample
        where source_file in (select remote_filename from file_registry where status = 'INGESTED') group by all"""),
    Query("counter_mapping_gaps", c.counter_mapping_gaps, """
        select k.dataset_family, k.counter_id, count(*) as row_count, count(distinct logical_entity_key) as distinct_logical_entities,
          min(collect_time) as min_collect_time, max(collect_time) as max_collect_time
        from keyed k left join counter_dictionary d on d.dataset_family = k.dataset_family and d.counter_id = k.counter_id
        where d.counter_id is null group by all"""),

    # --- topology
    Query("entity_topology_projection", t.entity_topology_projection,
          f"select logical_entity_key, dataset_family, entity_level, {PLACES}, mapping_status from topo_enrichment"),
    Query("raw_with_entity_topology", t.raw_with_entity_topology, PLACED, "counter_value"),
    Query("topology_enrichment_sync", t.topology_enrichment, "select * from topo_enrichment"),
    Query("site_coverage", c.site_coverage, """
        select site_code, site_name, region_code, region_name, dataset_family,
          count(distinct logical_entity_key) as distinct_logical_entities, count(distinct collect_time) as distinct_collect_times,
          count(*) as row_count from placed where site_code is not null group by all"""),
    Query("region_coverage", c.region_coverage, """
        select region_code, region_name, dataset_family, count(distinct logical_entity_key) as distinct_logical_entities,
          count(distinct collect_time) as distinct_collect_times, count(*) as row_count
        from placed where region_code is not null group by all"""),
    Query("topology_overview", t.topology_overview, """
        select count(*) as total_entities, count(site_code) as mapped_entities_with_site, count(region_code) as mapped_entities_with_region,
          count(*) filter (mapping_status = 'UNMAPPED') as unmapped_entities, count(distinct site_code) as distinct_sites,
          count(distinct region_code) as distinct_regions from topo_enrichment"""),
    Query("unmapped_entities", t.unmapped_entities, """
        select logical_entity_key, dataset_family, entity_level from topo_enrichment where mapping_status = 'UNMAPPED'"""),
    Query("interval_topology_coverage",
          lambda t: c.interval_topology_coverage(t, t.file_registry.where("status = 'INGESTED'").select(
              F.col("remote_filename").alias("source_file"))), """
        select interval_start, count(*) filter (mapping_status <> 'UNMAPPED') as topology_mapped_count,
          count(*) filter (mapping_status is null or mapping_status = 'UNMAPPED') as topology_unmapped_count
        from (select distinct interval_start, logical_entity_key from keyed where dataset_family like '%/ltefdd'
                and source_file in (select remote_filename from file_registry where status = 'INGESTED'))
        left join topo_enrichment using (logical_entity_key) group by all"""),

    # --- filters
    Query("filter_time_range", lambda t: filter_time_range(t.file_registry.select(*_REG), _NOON, _DAY3), f"""
        select id, dataset_family, interval_start, revision from file_registry
        where interval_start >= {_WINDOW[0]} and interval_start < {_WINDOW[1]}"""),
    Query("filter_families", lambda t: filter_families(t.file_registry.select(*_REG), [SDR_CELL]), f"""
        select id, dataset_family, interval_start, revision from file_registry where dataset_family = '{SDR_CELL}'"""),
    Query("revision_policy", _policy("additive"), f"select * from {_FILES}"),
    Query("revision_policy_base_only", _policy("base-only"), f"select * from {_FILES} where revision = 0"),
    Query("revision_policy_revisions_only", _policy("revisions-only"), f"select * from {_FILES} where revision > 0"),
    Query("revision_policy_latest_only", _policy("latest-only"), f"""
        select dataset_family, interval_start, max(revision) as revision, max_by(source_file, revision) as source_file
        from {_FILES} group by all"""),
    Query("time_window_args", lambda t: filter_time_range(
        t.file_registry.select(*_REG), *time_window_args("2026-03-01", "20260302_0100")), """
        select id, dataset_family, interval_start, revision from file_registry
        where interval_start between cast('2026-03-01' as timestamp) and cast('2026-03-02 01:00:59.999999' as timestamp)"""),
    Query("request_window", lambda t: filter_time_range(
        t.file_registry.select(*_REG), *request_window(interval_start=datetime(2026, 3, 2, 0, 45))), """
        select id, dataset_family, interval_start, revision from file_registry where interval_start = cast('2026-03-02 00:45' as timestamp)"""),
    Query("aligned_interval", lambda t: t.reconciliation_results.where(aligned_interval("run_at")).select("reconciliation_id", "run_at"), """
        select reconciliation_id, run_at from reconciliation_results where minute(run_at) in (0, 15, 30, 45) and second(run_at) = 0"""),
    Query("collect_time_window", lambda t: collect_time_window(t.pm_sample, _NOON, _DAY3).groupBy("collect_time", "counter_id").agg(
        F.count("*").alias("row_count")), f"""
        select collect_time, counter_id, count(*) as row_count from pm_sample
        where collect_time between {_WINDOW[0]} and {_WINDOW[1]} group by all"""),
    Query("latest_window_default", lambda t: latest_window(t.pm_sample, SDR_CELL).select(
        "source_file", "collect_time", "ani", "counter_id", "counter_value"), f"""
        select source_file, collect_time, ani, counter_id, counter_value from pm_sample where dataset_family = '{SDR_CELL}'
          and collect_time = (select max(collect_time) from pm_sample where dataset_family = '{SDR_CELL}')""", "counter_value"),
]
