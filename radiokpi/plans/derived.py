"""Network tables derived from the given star-schema tables, in SQL both engines run.

Each entry is one SELECT over given tables or earlier entries. The few dialect
differences go through ``Dialect``. Counter rows, entities, registry, audit and
snapshots all grow with the given tables; missing keys and odd values are made on
purpose, since reporting them is what the operators do.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from radiokpi.operators.topology import topology_enrichment
from radiokpi.tables import Tables, shared_folder

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Counters of the derived fact table and their aliases.
COUNTERS = {
    "C373424610": "dl_prb_used", "C373424609": "dl_prb_available",
    "C373424608": "ul_prb_used", "C373424611": "ul_prb_available",
    "C373200001": "dl_tb_error_blocks", "C373200002": "dl_tb_total_blocks",
    "C373200003": "ul_tb_error_blocks", "C373200004": "ul_tb_total_blocks",
    "C373300001": "max_rrc_connected_users", "C373300002": "mean_rrc_connected_users",
    "C373300003": "online_rrc_connected_users", "C399999999": None,
}
FACT_DIMS = ("source_file, dataset_family, interval_start, revision, csv_name, collect_time, trncmeid, ani, sbnid, "
             "enbid, enodebid, cellid, meid, systemmode, midflag, netype")


@dataclass(frozen=True)
class Dialect:
    """Spellings that differ between the engines."""

    spark: bool

    @property
    def ts(self) -> str:
        return "timestamp_ntz" if self.spark else "timestamp"

    def minutes(self, base: str, n: str) -> str:
        added = f"make_dt_interval(0, 0, cast({n} as int), 0)" if self.spark else f"to_minutes(cast({n} as bigint))"
        return f"({base} + {added})"

    def name_stamp(self, value: str) -> str:
        return f"date_format({value}, 'yyyyMMdd_HHmm')" if self.spark else f"strftime({value}, '%Y%m%d_%H%M')"

    def each(self, *values: str) -> str:
        return f"explode(array({', '.join(values)}))" if self.spark else f"unnest([{', '.join(values)}])"

    def sha(self, value: str) -> str:
        return f"sha2({value}, 256)" if self.spark else f"sha256({value})"


def _text(value: str) -> str:
    return f"cast({value} as string)"


def _rows(names: str, *rows: str) -> str:
    return f"select * from (values {', '.join(rows)}) as t({names})"


_FAMILY = ("case when {k} % 20 = 19 then null when {k} % 10 < 5 then 'PM/itbbu/ltefdd' "
           "when {k} % 10 < 9 then 'PM/sdr/ltefdd' else 'PM/itbbu/itbbuplat' end")
_PREFIX = ("case dataset_family when 'PM/itbbu/ltefdd' then 'UMEID_ITBBU_LTEFDD_PM_COMMON_ZTE_' "
           "when 'PM/sdr/ltefdd' then 'UMEID_LTEFDD_PM_COMMON_ZTE_' "
           "when 'PM/itbbu/itbbuplat' then 'UMEID_ITBBU_ITBBUPLAT_PM_COMMON_ZTE_' else 'UNPARSED_' end")
_NODE = "coalesce(enbid, enodebid, meid)"


def definitions(d: Dialect) -> dict[str, str]:
    start = f"cast('2026-03-01 00:00:00' as {d.ts})"
    zero = "cast(0 as double)"
    q: dict[str, str] = {}

    # Wide counter rows, one per lineitem.
    q["pm_base"] = f"""
        select *, {_FAMILY.format(k='l_orderkey')} as dataset_family,
          {d.minutes(start, '(l_partkey % 3) * 1440 + (l_orderkey % 96) * 15')} as collect_time,
          case when l_orderkey % 7 = 0 then 1 else 0 end as file_revision
        from lineitem"""
    q["pm_wide"] = f"""
        select {_PREFIX} || {d.name_stamp('collect_time')}
            || case when file_revision = 1 then '_R1' else '' end || '.tar.gz' as source_file,
          dataset_family, case when dataset_family is not null then collect_time end as interval_start,
          case when dataset_family is not null then file_revision end as revision,
          'pm_' || {_text('l_linenumber')} || '.csv' as csv_name, collect_time,
          'TR' || {_text('l_suppkey % 3')} as trncmeid,
          case when l_linenumber <> 6 then 'ANI_' || {_text('l_suppkey')} || '_' || {_text('l_linenumber % 3 + 1')} end as ani,
          {_text('l_suppkey % 7')} as sbnid,
          case when dataset_family = 'PM/itbbu/ltefdd' then {_text('l_suppkey')} end as enbid,
          case when dataset_family = 'PM/sdr/ltefdd' then {_text('l_suppkey')} end as enodebid,
          {_text('l_linenumber % 3 + 1')} as cellid,
          case when dataset_family = 'PM/itbbu/itbbuplat' then {_text('l_suppkey')} end as meid,
          'FDD' as systemmode, cast(null as string) as midflag, 'ENODEB' as netype,
          l_quantity + {zero} as C373424610,
          case when l_linenumber = 7 then {zero} else l_quantity + l_partkey % 40 end as C373424609,
          l_discount * 100 + {zero} as C373424608,
          case when l_returnflag <> 'R' then cast(50 as double) end as C373424611,
          l_tax * 100 + {zero} as C373200001, l_quantity * 10 as C373200002, l_discount * 50 + {zero} as C373200003,
          case when l_linestatus <> 'O' then l_quantity * 5 end as C373200004,
          l_quantity as C373300001, l_quantity / 2 as C373300002, cast(l_linenumber as double) as C373300003,
          l_extendedprice + {zero} as C399999999
        from pm_base"""
    q["archive_prefix"] = f"""
        select distinct dataset_family as prefix_family, {_PREFIX} as prefix from pm_base"""
    if not d.spark:
        names = ", ".join(f"'{c}'" for c in COUNTERS)
        q["pm_sample"] = f"""
            select {FACT_DIMS}, unnest([{names}]) as counter_id, unnest([{', '.join(COUNTERS)}]) as counter_value
            from pm_wide"""

    # Entities, with some unknown to the identity table and some kept at another level.
    q["entity_identity"] = f"""
        select case dataset_family
            when 'PM/sdr/ltefdd' then 'family=PM/sdr/ltefdd|sbnid=' || sbnid || '|enodebid=' || enodebid || '|cellid=' || cellid
            when 'PM/itbbu/ltefdd' then 'family=PM/itbbu/ltefdd|sbnid=' || sbnid || '|enbid=' || enbid || '|cellid=' || cellid
            else 'family=PM/itbbu/itbbuplat|sbnid=' || sbnid || '|meid=' || meid end as logical_entity_key,
          dataset_family, sbnid, enbid, enodebid, min(cellid) as cellid, meid, min(ani) as ani,
          case when cast({_NODE} as bigint) % 23 = 6 then 'site' when cast({_NODE} as bigint) % 23 = 5 then null
            when dataset_family = 'PM/itbbu/itbbuplat' then 'meid' else 'cell' end as entity_level,
          case when sbnid = '3' then 'kept note' end as notes
        from pm_wide where dataset_family is not null and cast({_NODE} as bigint) % 17 <> 3
        group by 1, dataset_family, sbnid, enbid, enodebid, meid,
          case when dataset_family <> 'PM/itbbu/itbbuplat' then cellid end"""
    q["topo_region"] = "select r_name as region_code, 'Region ' || r_name as region_name, cast(null as string) as notes from region"
    q["topo_site"] = f"""
        select 'SITE' || {_text('s_suppkey')} as site_code, 'Site ' || s_name as site_name,
          case when s_suppkey % 11 <> 10 then r_name end as region_code, cast(null as string) as notes
        from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey"""
    q["topo_reporting"] = """
        select 'REG::' || r_name as reporting_key, r_name as reporting_name, 'region' as reporting_level,
          cast(null as string) as parent_reporting_key, cast(null as string) as notes from region
        union all
        select 'NAT::' || n_name, n_name, 'nation', 'REG::' || r_name, null from nation join region on r_regionkey = n_regionkey"""
    q["topo_entity_map"] = f"""
        select logical_entity_key, case when s_suppkey % 5 <> 0 then 'SITE' || {_text('s_suppkey')} end as site_code,
          case when s_suppkey % 3 <> 0 then 'NAT::' || n_name end as reporting_key, 'seed' as mapping_source,
          cast(null as string) as notes
        from entity_identity join supplier on s_suppkey = cast({_NODE} as bigint) join nation on n_nationkey = s_nationkey
        where s_suppkey % 10 <> 0"""
    q["ani_entity"] = f"""
        select 'ANI_' || {_text('supp')} || '_' || {_text('cell')} as ani,
          'family=PM/sdr/ltefdd|sbnid=' || {_text('supp % 7')} || '|enodebid=' || {_text('supp')} || '|cellid=' || {_text('cell')} as logical_entity_key,
          'SITE' || {_text('supp')} as site_code, nation_name as region_name
        from (select s_suppkey as supp, n_name as nation_name, {d.each('1', '2', '3')} as cell
              from supplier join nation on n_nationkey = s_nationkey) as x
        where supp % 4 <> 3"""

    # Counter meanings: the known counters and one further counter per part.
    known = [f"('{c}', '{a}')" for c, a in COUNTERS.items() if a]
    q["known_counter"] = _rows("counter_id, counter_alias", *known)
    q["counter_reference"] = f"""
        select counter_id, 'ZTE' as vendor, 'LTE' as technology, 'cell' as object_type, counter_alias as description,
          'Number' as unit, 'vendor_doc' as source_type, cast(null as string) as source_reference,
          case when counter_id = 'C373200004' then 'UNVERIFIED' else 'VERIFIED' end as verification_status,
          {start} as verified_at, cast(null as string) as notes
        from known_counter
        union all
        select 'C9' || {_text('p_partkey')}, p_brand, 'LTE', p_type, p_name, 'Number', 'part', null,
          case when p_size % 2 = 0 then 'VERIFIED' else 'UNKNOWN' end, null, null from part"""
    q["counter_dictionary"] = f"""
        select dataset_family, counter_id, counter_alias, 'name of ' || counter_alias as counter_name,
          case when dataset_family = 'PM/itbbu/ltefdd' and counter_alias = 'ul_prb_available' then 'number' else 'Number' end as unit,
          case counter_alias when 'max_rrc_connected_users' then 'MAX' when 'mean_rrc_connected_users' then 'AVG' else 'SUM' end as aggregation_behavior,
          case when dataset_family = 'PM/sdr/ltefdd' and counter_alias = 'ul_tb_total_blocks' then 'PROVISIONAL' else 'VERIFIED' end as verification_status,
          'seed' as source_note
        from (select *, {d.each("'PM/sdr/ltefdd'", "'PM/itbbu/ltefdd'", "'PM/itbbu/itbbuplat'")} as dataset_family from known_counter) as x
        union all
        select 'PM/sdr/ltefdd', 'C9' || {_text('p_partkey')}, 'part_' || {_text('p_partkey')}, p_name, 'Number', 'SUM',
          case when p_size % 3 = 0 then 'PROVISIONAL' else 'VERIFIED' end, 'part' from part"""
    q["counter_group"] = f"""
        select 'BRAND_' || p_brand as group_code, min(p_brand) as group_name, cast(null as string) as notes from part group by p_brand"""
    q["counter_group_member"] = f"""
        select 'BRAND_' || p_brand as group_code, 'PM/sdr/ltefdd' as dataset_family, 'part_' || {_text('p_partkey')} as counter_alias,
          cast(null as string) as notes from part"""
    q["kpi_definition"] = f"""
        select kpi_name, 'LTE' as technology, kpi_name || ' ratio' as description, formula_type, scale_factor,
          'sum over sum' as formula_notes, 'percent' as unit, 'collect_time + ani' as aggregation_grain_notes, status, pending_reason
        from (values ('lte_prb_utilization', 'ratio', cast(100 as double), 'ACTIVE', cast(null as string)),
          ('lte_bler', 'ratio', cast(null as double), 'ACTIVE', null), ('lte_load', 'sum', cast(1 as double), 'ACTIVE', null),
          ('lte_dl_throughput', 'ratio', cast(null as double), 'PENDING_COUNTER_MAPPING', 'not mapped'))
          as t(kpi_name, formula_type, scale_factor, status, pending_reason)
        union all
        select 'part_ratio_' || {_text('p_partkey')}, 'LTE', p_name, 'ratio', cast(p_size as double), p_type, 'percent', 'part',
          'PENDING_COUNTER_MAPPING', 'part' from part"""
    q["kpi_counter_mapping"] = f"""
        select * from (values ('lte_prb_utilization', 'numerator', 'C373424610', cast(1 as double)),
          ('lte_prb_utilization', 'numerator', 'C373424608', cast(0.5 as double)),
          ('lte_prb_utilization', 'denominator', 'C373424609', cast(1 as double)),
          ('lte_prb_utilization', 'denominator', 'C373424611', cast(0.5 as double)),
          ('lte_bler', 'numerator', 'C373200001', cast(1 as double)), ('lte_bler', 'numerator', 'C373200003', cast(1 as double)),
          ('lte_bler', 'denominator', 'C373200002', cast(1 as double)), ('lte_bler', 'denominator', 'C373200004', cast(1 as double)),
          ('lte_load', 'numerator', 'C373300001', cast(1 as double)))
          as t(kpi_name, counter_role, counter_id, weight)
        union all
        select 'part_ratio_' || {_text('p_partkey')}, case when p_size % 2 = 0 then 'numerator' else 'denominator' end,
          'C9' || {_text('p_partkey')}, cast(1 as double) from part where p_size % 7 <> 0"""
    q["kpi_formula"] = f"""
        select kpi_code, kpi_code || ' name' as kpi_name, '100 * n / d' as formula_expression, 'entity-time' as grain, 'percent' as unit,
          verification_status, kpi_code like 'dl%' as topology_rollup_allowed, cast(null as string) as notes
        from (values ('dl_prb_utilization', 'VERIFIED'), ('ul_prb_utilization', 'VERIFIED'), ('dl_bler', 'VERIFIED'),
          ('ul_bler', 'VERIFIED'), ('cell_load', 'PROVISIONAL'), ('no_inputs', 'VERIFIED'),
          ('rrc_connected_users_max', 'VERIFIED')) as t(kpi_code, verification_status)
        union all
        select 'part_kpi_' || {_text('p_partkey')}, p_name, p_type, 'part', 'percent',
          case when p_size % 4 = 0 then 'PROVISIONAL' else 'VERIFIED' end, p_size % 2 = 0, p_brand from part"""
    q["kpi_formula_input"] = f"""
        select kpi_code, input_alias, dataset_family, counter_alias, true as required, cast(null as string) as notes
        from (select *, {d.each("'PM/sdr/ltefdd'", "'PM/itbbu/ltefdd'", "'PM/itbbu/itbbuplat'")} as dataset_family
              from (values ('dl_prb_utilization', 'numerator', 'dl_prb_used'), ('dl_prb_utilization', 'denominator', 'dl_prb_available'),
                ('ul_prb_utilization', 'numerator', 'ul_prb_used'), ('ul_prb_utilization', 'denominator', 'ul_prb_available'),
                ('dl_bler', 'numerator', 'dl_tb_error_blocks'), ('dl_bler', 'denominator', 'dl_tb_total_blocks'),
                ('ul_bler', 'numerator', 'ul_tb_error_blocks'), ('ul_bler', 'denominator', 'ul_tb_total_blocks'),
                ('rrc_connected_users_max', 'value', 'max_rrc_connected_users'))
                as t(kpi_code, input_alias, counter_alias)) as x
        union all
        select 'cell_load', 'numerator', 'PM/sdr/ltefdd', 'not_in_dictionary', true, null
        union all
        select 'dl_prb_utilization', 'hint', 'PM/sdr/ltefdd', 'online_rrc_connected_users', false, null
        union all
        select 'part_kpi_' || {_text('p_partkey')}, 'numerator', 'PM/sdr/ltefdd', 'part_' || {_text('p_partkey')}, p_size % 5 <> 0, null
        from part where p_size % 7 <> 0"""
    q["vendor_indicator"] = f"""
        select 'PA' || {_text('p_partkey')} as indicator_code, p_name as indicator_name, 'part_' || {_text('p_size')} as semantic_alias,
          case when p_size % 2 = 0 then 'SUM' else 'AVG' end as aggregation_method, 'bit' as unit, 'VERIFIED' as verification_status,
          'part.csv' as source from part"""
    q["vendor_lineage"] = f"""
        select 'PA' || {_text('p_partkey')} as indicator_code, 'C9' || {_text('p_partkey')} as lineage_expression, 'direct' as lineage_type,
          'C9' || {_text('p_partkey')} as raw_counter_dependencies from part where p_size % 3 <> 0"""

    # File registry: one file per order, named as the fact files are.
    q["registry_base"] = f"""
        select o_orderkey as id, o_custkey, o_orderdate, {_FAMILY.format(k='o_orderkey')} as dataset_family,
          {d.minutes(start, '(o_custkey % 3) * 1440 + (o_orderkey % 96) * 15')} as file_time,
          case when o_orderkey % 7 = 0 then 1 else 0 end as revision,
          case o_orderkey % 6 when 0 then 'DISCOVERED' when 1 then 'DOWNLOADED' when 2 then 'INGESTED'
            when 3 then 'SKIPPED_DUPLICATE' when 4 then 'FAILED_DOWNLOAD' else 'FAILED_INGEST' end as status
        from orders"""
    q["file_registry"] = f"""
        select id, 'default' as source_name, '/pm' as remote_directory, file_name as remote_filename,
          '/pm/' || {_text('id')} || '/' || file_name as remote_path, dataset_family,
          case when dataset_family is not null then file_time end as interval_start,
          case when dataset_family is not null then revision end as revision, 'tar.gz' as extension,
          id * 10 as remote_size_bytes, o_orderdate as remote_modified_at, status,
          o_orderdate as first_seen_at, {d.minutes('o_orderdate', '(o_custkey % 2) * 60')} as last_seen_at,
          {d.minutes('o_orderdate', '(o_custkey % 2) * 60')} as last_scan_at, {d.minutes('o_orderdate', '60')} as status_updated_at,
          cast(o_custkey % 5 as int) as download_attempts, cast(o_custkey % 5 as int) as download_attempt_count,
          cast(o_custkey % 4 as int) as ingest_attempt_count, o_orderdate as last_download_attempt_at,
          cast(null as {d.ts}) as last_ingest_attempt_at,
          case when o_custkey % 4 <> 0 then '/stage/' || {_text('id')} || '/' || file_name end as local_staged_path,
          {d.sha('file_name')} as file_hash, 'run-' || {_text('id')} as ingest_run_id,
          case when id % 3 <> 0 then '/archive/' || {_text('id')} || '/' || file_name end as final_file_path,
          case when status like 'FAILED%' then 'error ' || {_text('id')} end as last_error,
          o_orderdate as created_at, {d.minutes('o_orderdate', '90')} as updated_at
        from (select *, {_PREFIX} || {d.name_stamp('file_time')} || case when revision = 1 then '_R1' else '' end || '.tar.gz' as file_name
              from registry_base) as r"""
    q["storage_listing"] = """
        select local_staged_path as path from file_registry where local_staged_path is not null and id % 11 <> 0
        union all
        select final_file_path from file_registry where final_file_path is not null and id % 5 <> 0"""
    q["file_audit"] = f"""
        select remote_filename as source_file, file_hash, ingest_run_id as run_id, 'manual' as trigger_type, 'ftp' as source_type,
          {d.minutes('updated_at', 'id % 1440')} as processed_at,
          case status when 'INGESTED' then 'SUCCESS' when 'SKIPPED_DUPLICATE' then 'SKIPPED_DUPLICATE' else 'FAILED' end as status,
          1 as csv_files_found, cast(id % 100 as bigint) as input_rows_read, cast(id % 100 * 12 as bigint) as normalized_rows_emitted,
          cast(case when status = 'INGESTED' then id % 100 * 12 else 0 end as bigint) as rows_inserted,
          cast(id % 9 as bigint) as null_counter_values,
          case when id % 13 = 0 then 'PENDING' when id % 29 = 0 then 'FAILED' else 'COMPLETED' end as lifecycle_status,
          case when id % 13 <> 0 then 'archived' end as lifecycle_action,
          case when id % 17 = 0 then 'FAILED' when id % 4 = 0 then 'PENDING' else 'COMPLETED' end as normalization_status,
          cast(null as {d.ts}) as normalized_at, cast(null as string) as normalization_error, final_file_path,
          case when status = 'FAILED_INGEST' and id % 2 = 1 then last_error end as error_message
        from file_registry where status in ('INGESTED', 'SKIPPED_DUPLICATE', 'FAILED_INGEST')"""

    # Topology snapshots: one header per customer, entity rows for two of them, results per order.
    q["snapshots"] = f"""
        select c_custkey as snapshot_id, 'topology_202603' || lpad({_text('c_custkey % 28 + 1')}, 2, '0') || '.xlsx' as source_file_name,
          '/topology/' || {_text('c_custkey')} as stored_file_path, {d.sha('c_name')} as source_sha256,
          cast(null as date) as topology_release_date, {d.minutes(start, 'c_custkey % 50000')} as uploaded_at, 'previewed' as status,
          c_custkey = 1 or c_custkey % 700 = 699 as is_active_snapshot,
          case when c_custkey % 9 = 5 then 2 else 0 end as parser_error_count, cast(c_custkey % 4 as int) as parser_warning_count,
          cast(c_custkey % 1000 as int) as workbook_row_count, cast(c_custkey % 1000 * 2 as int) as normalized_row_count
        from customer"""
    q["reconciliation_results"] = f"""
        select o_orderkey as reconciliation_id, o_custkey as snapshot_id, {d.minutes('o_orderdate', 'o_orderkey % 1440')} as run_at,
          cast(o_orderkey % 4 as bigint) as blocking_error_count, cast(o_orderkey % 50 as bigint) as warning_count,
          {', '.join(f'cast(o_orderkey % {n} as bigint) as {c}' for n, c in enumerate((
              'pm_missing_from_workbook_count', 'workbook_missing_from_pm_count', 'workbook_sites_no_pm_count',
              'duplicate_entity_mapping_count', 'conflicting_site_region_count', 'entities_added_count',
              'entities_removed_count', 'entities_moved_site_count', 'sites_moved_region_count'), start=5))}
        from orders where o_orderkey % 10 <> 9"""
    q["snapshot_cells"] = f"""
        select *, {d.each("'PM/sdr/ltefdd'", "'PM/itbbu/ltefdd'")} as dataset_family
        from (select *, {d.each('1', '2')} as snapshot_id
              from (select s_suppkey as supp, s_nationkey, {d.each('1', '2', '3')} as cell from supplier) as a) as b"""
    key = (f"'family=' || dataset_family || '|sbnid=' || {_text('supp % 7')} || case when dataset_family = 'PM/sdr/ltefdd' "
           f"then '|enodebid=' else '|enbid=' end || {_text('supp')} || '|cellid=' || {_text('cell')}")
    base = f"""
        select cast(snapshot_id as bigint) as snapshot_id, cast(supp * 3 + cell as int) as source_row_number, {key} as logical_entity_key,
          dataset_family, {{site}} as site_code, {{site}} as site_name, {{region}} as region_code, {{region}} as region_name,
          'CLUSTER::' || n_name as reporting_key, n_name as reporting_name, 'cluster' as reporting_level,
          'topology_workbook' as mapping_source, cast(null as string) as notes
        from snapshot_cells join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey
        where {{where}}"""
    moved = "case when snapshot_id = 2 and supp % 13 = 0 then supp + 1 else supp end"
    region = "case when snapshot_id = 2 and supp = 4 then 'MOVED' when supp % 41 = 7 and cell = 2 then 'OTHER' else r_name end"
    present = "(snapshot_id <> 1 or supp % 10 <> 9) and (snapshot_id <> 2 or supp % 10 <> 8)"
    q["snapshot_rows"] = (
        base.format(site=f"'SITE' || {_text(moved)}", region=region, where=present) + " union all "
        + base.format(site=f"'SECOND' || {_text('supp')}", region="r_name", where=f"supp % 29 = 0 and {present}")
        + " union all "
        + base.format(site=f"'GHOST' || {_text('supp')}", region="r_name", where="snapshot_id = 2 and supp % 17 = 3 and cell = 1"))
    return q


def with_parts(select: str, parts: dict[str, str]) -> str:
    """``select`` behind a WITH of the parts it needs, in their order of definition."""
    needed, todo = set(), [select]
    while todo:
        text = todo.pop()
        for name in set(re.findall(r"\b[a-z_]\w*\b", text)) & (parts.keys() - needed):
            needed.add(name)
            todo.append(parts[name])
    chosen = [f"{n} as ({parts[n]})" for n in parts if n in needed]
    return f"with {', '.join(chosen)} {select}" if chosen else select


_SPARK = definitions(Dialect(spark=True))
# Dimension tables written to the shared folder when first used, as a deployment would hold them: their size is
# then known exactly and decides between broadcast and shuffle.
_KEPT = ("entity_identity", "topo_site", "topo_entity_map", "ani_entity", "counter_reference", "counter_dictionary",
         "kpi_definition", "kpi_counter_mapping", "kpi_formula", "kpi_formula_input", "topo_enrichment")
_stored: dict[tuple[str, str, str], str] = {}


class DerivedTables(Tables):
    """Tables of one data directory, each built when an operator first asks for it."""

    def __init__(self, spark: SparkSession, directory: str, **given: DataFrame):
        super().__init__(**given)
        self._spark, self._directory, self._own_facts = spark, directory, True

    def __missing__(self, name: str) -> DataFrame:
        if name in ("entity_activity", "counter_activity", "entity_shapes", "entity_places"):
            raise KeyError(name)
        if name == "pm_records" and not self._own_facts:
            raise KeyError(name)
        self[name] = self._kept(name) if name in _KEPT else self._build(name)
        return self[name]

    def updated(self, **frames: DataFrame) -> "DerivedTables":
        changed = DerivedTables(self._spark, self._directory, **self.without_stale(frames))
        changed._own_facts = self._own_facts and "pm_sample" not in frames
        return changed

    def _kept(self, name: str) -> DataFrame:
        key = (self._spark.sparkContext.applicationId, self._directory, name)
        if key not in _stored:
            path = f"{shared_folder(self._spark)}/derived-{uuid.uuid4().hex}/{name}"
            self._build(name).write.parquet(path)
            _stored[key] = path
        return self._spark.read.parquet(_stored[key])

    def _build(self, name: str) -> DataFrame:
        if name == "pm_sample":
            wide = self["pm_wide"]
            return wide.unpivot([c.strip() for c in FACT_DIMS.split(",")], list(COUNTERS), "counter_id", "counter_value")
        if name == "pm_records":
            return self["pm_wide"].select(*[c.strip() for c in FACT_DIMS.split(",")], *COUNTERS)
        if name == "topo_enrichment":
            return topology_enrichment(self)
        if name in GIVEN:
            return self._spark.read.parquet(f"{self._directory}/{name}.parquet")
        if name not in _SPARK:
            raise KeyError(name)
        tables = "|".join([*GIVEN, *_SPARK])
        text = re.sub(rf"\b(from|join) ({tables})\b", r"\1 {\2}", _SPARK[name])
        used = set(re.findall(r"\{(\w+)\}", text))
        return self._spark.sql(text, **{table: self[table] for table in used})
