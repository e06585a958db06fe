"""Registered topology-snapshot queries. Snapshot 1 is the one compared against, snapshot 2 the candidate."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from radiokpi.operators import snapshots as p
from radiokpi.plans.query import Query
from radiokpi.sources import topology_sheet as sheet

_AT = datetime(2026, 3, 5, 9)
_BOTH = {"snapshot_id": 2, "active_id": 1}
_HEAD = ("s.snapshot_id, source_file_name, {more}topology_release_date, uploaded_at, status, is_active_snapshot, parser_error_count, "
         "parser_warning_count, workbook_row_count, normalized_row_count")
_HEAD_DATE = _HEAD.replace("topology_release_date", "cast(topology_release_date as varchar) as topology_release_date")
_NEWEST = ("left join (select snapshot_id, unnest(max_by(struct_pack({fields}), row(run_at, reconciliation_id))) "
           "from reconciliation_results group by snapshot_id) r using (snapshot_id)")


def _latest(detailed: bool) -> str:
    counts = ["blocking_error_count", "warning_count", *(p.COUNTS if detailed else ())]
    head = _HEAD_DATE.format(more="stored_file_path, source_sha256, " if detailed else "")
    fields = ", ".join(f"r_{c} := {c}" for c in [*counts, "reconciliation_id"])
    return (f"select {head}, {', '.join(f'ifnull(r_{c}, 0) as {c}' for c in counts)}, r_reconciliation_id as reconciliation_id "
            f"from snapshots s {_NEWEST.format(fields=fields)}")


def _issue(name: str, select: str, detail: str, entity: bool) -> str:
    severity = "ERROR" if name in p.ERRORS else "WARNING"
    who = "logical_entity_key, dataset_family" if entity else "null::varchar as logical_entity_key, null::varchar as dataset_family"
    return (f"select '{name}' as issue_type, '{severity}' as severity, {who}, json_object({detail})::varchar as detail_json from ({select})")


_R = "(select * from snapshot_rows where snapshot_id = {})"
_NEW, _OLD = _R.format(2), _R.format(1)
_SITES = "select distinct logical_entity_key, dataset_family, site_code from {}"
ISSUES = {
    "dup_entity_multiple_sites": _issue("DUPLICATE_ENTITY_MULTIPLE_SITES", f"""
        select logical_entity_key, min(dataset_family) as dataset_family, list_sort(list(distinct site_code)) as v from {_NEW}
        group by logical_entity_key having count(distinct site_code) > 1""", "'site_codes', v", True),
    "conflicting_site_region": _issue("CONFLICTING_SITE_REGION", f"""
        select site_code, list_sort(list(distinct region_code)) as v from {_NEW} group by site_code having count(distinct region_code) > 1""",
        "'site_code', site_code, 'region_codes', v", False),
    "pm_missing_from_workbook": _issue("PM_MISSING_FROM_WORKBOOK", f"""
        select logical_entity_key, dataset_family from entity_identity
        where logical_entity_key not in (select logical_entity_key from {_NEW})""", "'reason', 'pm_entity_missing_from_snapshot'", True),
    "workbook_missing_from_pm": _issue("WORKBOOK_MISSING_FROM_PM", f"""
        select distinct logical_entity_key, dataset_family from {_NEW}
        where logical_entity_key not in (select logical_entity_key from entity_identity)""", "'reason', 'snapshot_entity_missing_from_pm'", True),
    "workbook_site_no_pm": _issue("WORKBOOK_SITE_NO_PM_ACTIVITY", f"""
        select site_code from {_NEW} r left join entity_identity i using (logical_entity_key)
        group by site_code having count(i.sbnid) = 0""", "'site_code', site_code", False),
    "entity_added": _issue("ENTITY_ADDED", f"{_SITES.format(_NEW)} where logical_entity_key not in (select logical_entity_key from {_OLD})",
                           "'candidate_site_code', site_code", True),
    "entity_removed": _issue("ENTITY_REMOVED", f"{_SITES.format(_OLD)} where logical_entity_key not in (select logical_entity_key from {_NEW})",
                             "'active_site_code', site_code", True),
    "entity_moved_site": _issue("ENTITY_MOVED_SITE", f"""
        select n.*, o.site_code as old from ({_SITES.format(_NEW)}) n join ({_SITES.format(_OLD)}) o using (logical_entity_key)
        where ifnull(n.site_code, '') <> ifnull(o.site_code, '')""", "'active_site_code', old, 'candidate_site_code', site_code", True),
    "site_moved_region": _issue("SITE_MOVED_REGION", f"""
        select site_code, n.v as new, o.v as old from (select site_code, min(region_code) as v from {_NEW} group by all) n
        join (select site_code, min(region_code) as v from {_OLD} group by all) o using (site_code) where n.v is distinct from o.v""",
        "'site_code', site_code, 'active_region_code', old, 'candidate_region_code', new", False),
}
_BUILD = {
    "dup_entity_multiple_sites": p.duplicate_entity_sites, "conflicting_site_region": p.conflicting_site_region,
    "pm_missing_from_workbook": p.pm_missing_from_workbook, "workbook_missing_from_pm": p.workbook_missing_from_pm,
    "workbook_site_no_pm": p.workbook_site_no_pm, "entity_added": p.entity_added, "entity_removed": p.entity_removed,
    "entity_moved_site": p.entity_moved_site, "site_moved_region": p.site_moved_region,
}
_ALL = " union all ".join(ISSUES.values())


def _issues(t):
    return p.reconciliation_issues(t, **_BOTH)


def _one(name):
    both = name in ("entity_added", "entity_removed", "entity_moved_site", "site_moved_region")
    return lambda t: _BUILD[name](t, **(_BOTH if both else {"snapshot_id": 2}))


def _accepted(t):
    """Tables in which the candidate has no blocking result, as its apply step demands."""
    results = t.reconciliation_results.withColumn(
        "blocking_error_count", F.when(F.col("snapshot_id") == 2, 0).otherwise(F.col("blocking_error_count")))
    return p.apply_snapshot(t.updated(reconciliation_results=results), snapshot_id=2, activated_at=_AT, activated_by="planner")


def _sheet(t):
    """Sheet rows from customers: numbers as floats, some required cells blank, some clusters absent."""
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    return t.customer.select(
        (key + 2).cast("int").alias("source_row_number"), (key % 7).cast("double").alias("SubnetID"),
        F.when(key % 10 != 7, F.concat(F.lit(" "), text, F.lit("\t"))).alias("eNodeBid"),
        F.when(key % 11 != 7, F.col("c_name")).otherwise("  ").alias("ENODEBName"), (key % 3 + 1).cast("double").alias("CellID"),
        F.concat("c_name", F.lit("-1")).alias("CELLNAME"), F.concat(F.lit("SITE"), text).alias("SiteName"),
        F.when(key % 13 != 7, F.col("c_mktsegment")).alias("Region"), F.lit("Area1").alias("Area"),
        F.when(key % 4 != 3, F.concat(F.lit("CL"), (key % 4).cast("string"))).otherwise(" ").alias("ClusterID"),
        F.lit(None).cast("string").alias("TEAM"))


_COMPLETE = "c_custkey % 10 <> 7 and c_custkey % 11 <> 7 and c_custkey % 13 <> 7"
_SHEET_ROWS = " union all ".join(f"""
    select cast(c_custkey + 2 as integer) as source_row_number,
      'family={family}|sbnid=' || c_custkey % 7 || '|{node}=' || c_custkey || '|cellid=' || c_custkey % 3 + 1 as logical_entity_key,
      '{family}' as dataset_family, 'SITE' || c_custkey as site_code, 'SITE' || c_custkey as site_name, c_mktsegment as region_code,
      c_mktsegment as region_name, 'Area1' as area_name, 'CL' || cl as cluster_id, null::varchar as team_code,
      'CLUSTER::CL' || cl as reporting_key, 'CL' || cl as reporting_name, if(cl is null, null, 'cluster') as reporting_level,
      (c_custkey % 7)::varchar as workbook_subnet_id, c_custkey::varchar as workbook_enodeb_id, c_name as workbook_enodeb_name,
      c_name || '-1' as workbook_cell_name, 'topology_workbook' as mapping_source, null::varchar as notes
    from (select *, nullif(c_custkey % 4, 3)::varchar as cl from customer) where {_COMPLETE}"""
    for family, node in (("PM/sdr/ltefdd", "enodebid"), ("PM/itbbu/ltefdd", "enbid")))
_SHEET_ROWS = _SHEET_ROWS.replace("|cellid=' || c_custkey % 3 + 1", "|cellid=' || (c_custkey % 3 + 1)").replace(
    "|sbnid=' || c_custkey % 7", "|sbnid=' || (c_custkey % 7)")
_PROBLEMS = f"""select cast(c_custkey + 2 as integer) as source_row_number, 'row ' || (c_custkey + 2) || ': missing critical field: '
    || case when c_custkey % 10 = 7 then 'eNodeBid' when c_custkey % 11 = 7 then 'ENODEBName' else 'Region' end as message
    from customer where not ({_COMPLETE})"""


def _created(t):
    return p.create_snapshot(
        sheet.topology_snapshot_rows(_sheet(t)), sheet.topology_sheet_problems(_sheet(t)), snapshot_id=77,
        source_file_name="topology_20260305.xlsx", stored_file_path="/topology/77", source_sha256="0" * 64,
        release_date=date(2026, 3, 5), uploaded_at=_AT)


_APPLIED = "(select * from snapshot_rows where snapshot_id = 2)"
_FILE = "(select source_file_name from snapshots where snapshot_id = 2)"

QUERIES = [
    Query("topology_snapshot_rows", lambda t: sheet.topology_snapshot_rows(_sheet(t)), _SHEET_ROWS),
    Query("topology_sheet_problems", lambda t: sheet.topology_sheet_problems(_sheet(t)), _PROBLEMS),
    Query("release_date", lambda t: t.snapshots.select("snapshot_id", sheet.release_date("source_file_name").alias("release_date")), """
        select snapshot_id, strptime(regexp_extract(source_file_name, '[0-9]{8}'), '%Y%m%d')::date::varchar as release_date from snapshots"""),
    Query("create_snapshot", lambda t: _created(t)[0], f"""
        select 77::bigint as snapshot_id, 'topology_20260305.xlsx' as source_file_name, '/topology/77' as stored_file_path,
          repeat('0', 64) as source_sha256, '2026-03-05' as topology_release_date, cast('2026-03-05 09:00' as timestamp) as uploaded_at,
          'previewed' as status, false as is_active_snapshot, count(*) filter (not ({_COMPLETE}))::integer as parser_error_count,
          0 as parser_warning_count, count(*)::integer as workbook_row_count, 2 * count(*) filter ({_COMPLETE})::integer as normalized_row_count
        from customer"""),
    Query("create_snapshot_rows", lambda t: _created(t)[1], f"select *, 77::bigint as snapshot_id from ({_SHEET_ROWS})"),
    *[Query(name, _one(name), sql) for name, sql in ISSUES.items()],
    Query("reconciliation_issues", _issues, _ALL),
    Query("reconciliation_summary", lambda t: p.reconciliation_summary(t, **_BOTH), f"""
        select 2::bigint as snapshot_id, 1::bigint as compared_active_snapshot_id,
          count(*) filter (severity = 'ERROR') + any_value(s.parser_error_count) as blocking_error_count,
          count(*) filter (severity = 'WARNING') + any_value(s.parser_warning_count) as warning_count,
          {', '.join(f"count(*) filter (issue_type = '{issue}') as {name}" for name, issue in p.COUNTS.items())},
          any_value(s.parser_error_count) as parser_error_count, any_value(s.parser_warning_count) as parser_warning_count
        from ({_ALL}) i join snapshots s on s.snapshot_id = 2"""),
    Query("reconciliation_details", lambda t: p.reconciliation_details(_issues(t), issue_type="ENTITY_MOVED_SITE", limit=100), f"""
        select * from ({ISSUES['entity_moved_site']}) order by logical_entity_key, detail_json limit 100"""),
    Query("snapshot_latest_reconciliation", p.snapshots_with_latest_reconciliation, _latest(False)),
    Query("snapshot_summary", lambda t: p.snapshots_with_latest_reconciliation(t, detailed=True), _latest(True)),
    Query("active_snapshot", p.active_snapshot, f"""
        select {_HEAD_DATE.format(more='')} from snapshots s where is_active_snapshot order by uploaded_at desc, snapshot_id desc limit 1"""),
    Query("apply_snapshot", lambda t: _accepted(t).topology_activation, f"""
        select 2::bigint as snapshot_id, (select snapshot_id from snapshots where is_active_snapshot order by uploaded_at desc, snapshot_id desc limit 1)
            as prior_active_snapshot_id, cast('2026-03-05 09:00' as timestamp) as activated_at,
          count(distinct row(region_code, region_name)) as rows_loaded_regions,
          count(distinct row(site_code, site_name, region_code)) as rows_loaded_sites,
          count(distinct row(reporting_key, reporting_name)) as rows_loaded_reporting,
          count(distinct logical_entity_key) filter (logical_entity_key in (select logical_entity_key from entity_identity)) as rows_loaded_entity_map,
          'planner' as activated_by from {_APPLIED}"""),
    Query("apply_snapshot_regions", lambda t: _accepted(t).topo_region,
          f"select distinct region_code, region_name, {_FILE} as notes from {_APPLIED}"),
    Query("apply_snapshot_sites", lambda t: _accepted(t).topo_site,
          f"select distinct site_code, site_name, region_code, {_FILE} as notes from {_APPLIED}"),
    Query("apply_snapshot_reporting", lambda t: _accepted(t).topo_reporting, f"""
        select distinct reporting_key, reporting_name, reporting_level, null::varchar as parent_reporting_key, {_FILE} as notes from {_APPLIED}"""),
    Query("apply_snapshot_entity_map", lambda t: _accepted(t).topo_entity_map, f"""
        select logical_entity_key, unnest(min_by(struct_pack(site_code, reporting_key, mapping_source, notes), row(source_row_number, site_code)))
        from {_APPLIED} where logical_entity_key in (select logical_entity_key from entity_identity) group by logical_entity_key"""),
    Query("apply_snapshot_headers", lambda t: _accepted(t).snapshots.select("snapshot_id", "status", "is_active_snapshot"), """
        select snapshot_id, if(snapshot_id = 2, 'applied', status) as status, snapshot_id = 2 as is_active_snapshot from snapshots"""),
]
