"""Topology snapshots: storing, reconciling and applying them."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from radiokpi.functions import first_per, page
from radiokpi.tables import Tables

# Issue types by the summary column that counts them.
COUNTS = {
    "pm_missing_from_workbook_count": "PM_MISSING_FROM_WORKBOOK",
    "workbook_missing_from_pm_count": "WORKBOOK_MISSING_FROM_PM",
    "workbook_sites_no_pm_count": "WORKBOOK_SITE_NO_PM_ACTIVITY",
    "duplicate_entity_mapping_count": "DUPLICATE_ENTITY_MULTIPLE_SITES",
    "conflicting_site_region_count": "CONFLICTING_SITE_REGION",
    "entities_added_count": "ENTITY_ADDED",
    "entities_removed_count": "ENTITY_REMOVED",
    "entities_moved_site_count": "ENTITY_MOVED_SITE",
    "sites_moved_region_count": "SITE_MOVED_REGION",
}
ERRORS = ("DUPLICATE_ENTITY_MULTIPLE_SITES", "CONFLICTING_SITE_REGION")


def create_snapshot(rows: DataFrame, problems: DataFrame, *, snapshot_id: int, source_file_name: str,
                    stored_file_path: str, source_sha256: str, release_date: date | None,
                    uploaded_at: datetime) -> tuple[DataFrame, DataFrame]:
    """Header row and entity rows of a new snapshot in status 'previewed'.

    ``rows`` and ``problems`` come from the sheet parser. Parser messages stay a
    table of their own (``problems``); the header holds their number only, so a
    broken sheet of any length never becomes one large value.
    """
    sheet_rows = rows.select("source_row_number").distinct().unionByName(problems.select("source_row_number"))
    counted = (
        rows.select(F.lit("normalized").alias("kind")).unionByName(problems.select(F.lit("error").alias("kind")))
        .unionByName(sheet_rows.select(F.lit("sheet").alias("kind"))))
    header = counted.agg(
        F.count_if(F.col("kind") == "error").cast("int").alias("parser_error_count"),
        F.lit(0).alias("parser_warning_count"),
        F.count_if(F.col("kind") == "sheet").cast("int").alias("workbook_row_count"),
        F.count_if(F.col("kind") == "normalized").cast("int").alias("normalized_row_count"),
    ).select(
        F.lit(snapshot_id).cast("bigint").alias("snapshot_id"), F.lit(source_file_name).alias("source_file_name"),
        F.lit(stored_file_path).alias("stored_file_path"), F.lit(source_sha256).alias("source_sha256"),
        F.lit(release_date).cast("date").alias("topology_release_date"),
        F.lit(uploaded_at).cast("timestamp_ntz").alias("uploaded_at"), F.lit("previewed").alias("status"),
        F.lit(False).alias("is_active_snapshot"), "parser_error_count", "parser_warning_count",
        "workbook_row_count", "normalized_row_count")
    return header, rows.withColumn("snapshot_id", F.lit(snapshot_id).cast("bigint"))


def active_snapshot(tables: Tables) -> DataFrame:
    """The newest active snapshot."""
    columns = ["snapshot_id", "source_file_name", "topology_release_date", "uploaded_at", "status",
               "is_active_snapshot", "parser_error_count", "parser_warning_count", "workbook_row_count",
               "normalized_row_count"]
    return page(tables.snapshots.where("is_active_snapshot").select(*columns), "-uploaded_at", "-snapshot_id", limit=1)


def snapshots_with_latest_reconciliation(tables: Tables, *, detailed: bool = False) -> DataFrame:
    """Every snapshot with the newest of its reconciliation results; missing counts read zero."""
    newest = first_per(tables.reconciliation_results, ["snapshot_id"],
                       largest=[F.col("run_at"), F.col("reconciliation_id")])
    counts = ["blocking_error_count", "warning_count"]
    head = ["snapshot_id", "source_file_name", "topology_release_date", "uploaded_at", "status",
            "is_active_snapshot", "parser_error_count", "parser_warning_count", "workbook_row_count",
            "normalized_row_count"]
    if detailed:
        counts += list(COUNTS)
        head[2:2] = ["stored_file_path", "source_sha256"]
    found = newest.select("snapshot_id", "reconciliation_id", *counts)
    return tables.snapshots.select(*head).join(found, "snapshot_id", "left").select(
        *head, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "reconciliation_id")


# --- issues ---------------------------------------------------------------------------------

def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]), {"ignoreNullFields": "false"})


def _issue(frame: DataFrame, issue: str, detail: Column, *, entity: bool) -> DataFrame:
    none = F.lit(None).cast("string")
    return frame.select(
        F.lit(issue).alias("issue_type"), F.lit("ERROR" if issue in ERRORS else "WARNING").alias("severity"),
        (F.col("logical_entity_key") if entity else none).alias("logical_entity_key"),
        (F.col("dataset_family") if entity else none).alias("dataset_family"), detail.alias("detail_json"))


def _rows(tables: Tables, snapshot_id: int) -> DataFrame:
    return tables.snapshot_rows.where(F.col("snapshot_id") == snapshot_id)


def _values(column: str) -> Column:
    """Distinct values in order, a NULL last if there is one."""
    some = F.array_sort(F.collect_set(column))
    return F.when(F.bool_or(F.col(column).isNull()), F.array_append(some, F.lit(None).cast("string"))).otherwise(some)


def duplicate_entity_sites(tables: Tables, *, snapshot_id: int) -> DataFrame:
    """Entities given more than one site."""
    pairs = _rows(tables, snapshot_id).groupBy("logical_entity_key", "site_code").agg(
        F.min("dataset_family").alias("dataset_family"))
    entities = pairs.groupBy("logical_entity_key").agg(
        F.min("dataset_family").alias("dataset_family"), F.count("site_code").alias("n"), _values("site_code").alias("v"))
    return _issue(entities.where("n > 1"), ERRORS[0], _json(site_codes=F.col("v")), entity=True)


def conflicting_site_region(tables: Tables, *, snapshot_id: int) -> DataFrame:
    """Sites given more than one region."""
    pairs = _rows(tables, snapshot_id).select("site_code", "region_code").distinct()
    sites = pairs.groupBy("site_code").agg(F.count("region_code").alias("n"), _values("region_code").alias("v"))
    detail = _json(site_code=F.col("site_code"), region_codes=F.col("v"))
    return _issue(sites.where("n > 1"), ERRORS[1], detail, entity=False)


def pm_missing_from_workbook(tables: Tables, *, snapshot_id: int) -> DataFrame:
    """P4."""
    missing = tables.entity_identity.join(
        _rows(tables, snapshot_id).select("logical_entity_key"), "logical_entity_key", "left_anti")
    return _issue(missing, "PM_MISSING_FROM_WORKBOOK", _json(reason=F.lit("pm_entity_missing_from_snapshot")), entity=True)


def workbook_missing_from_pm(tables: Tables, *, snapshot_id: int) -> DataFrame:
    """P5."""
    missing = _rows(tables, snapshot_id).select("logical_entity_key", "dataset_family").distinct().join(
        tables.entity_identity.select("logical_entity_key"), "logical_entity_key", "left_anti")
    return _issue(missing, "WORKBOOK_MISSING_FROM_PM", _json(reason=F.lit("snapshot_entity_missing_from_pm")), entity=True)


def workbook_site_no_pm(tables: Tables, *, snapshot_id: int) -> DataFrame:
    """Sites none of whose entities is known from facts."""
    rows = _rows(tables, snapshot_id).select("site_code", "logical_entity_key")
    alive = rows.join(tables.entity_identity.select("logical_entity_key"), "logical_entity_key", "left_semi")
    silent = rows.select("site_code").distinct().join(alive.select("site_code"), "site_code", "left_anti")
    return _issue(silent, "WORKBOOK_SITE_NO_PM_ACTIVITY", _json(site_code=F.col("site_code")), entity=False)


def _entity_sites(tables: Tables, snapshot_id: int) -> DataFrame:
    return _rows(tables, snapshot_id).select("logical_entity_key", "dataset_family", "site_code").distinct()


def _only_in(tables: Tables, there: int, absent: int) -> DataFrame:
    gone = _rows(tables, absent).select("logical_entity_key")
    return _entity_sites(tables, there).join(gone, "logical_entity_key", "left_anti")


def entity_added(tables: Tables, *, snapshot_id: int, active_id: int) -> DataFrame:
    """In the candidate, not in the active snapshot."""
    return _issue(_only_in(tables, snapshot_id, active_id), "ENTITY_ADDED",
                  _json(candidate_site_code=F.col("site_code")), entity=True)


def entity_removed(tables: Tables, *, snapshot_id: int, active_id: int) -> DataFrame:
    """In the active snapshot, not in the candidate."""
    return _issue(_only_in(tables, active_id, snapshot_id), "ENTITY_REMOVED",
                  _json(active_site_code=F.col("site_code")), entity=True)


def _differs(left: str, right: str) -> Column:
    return F.coalesce(left, F.lit("")) != F.coalesce(right, F.lit(""))


def entity_moved_site(tables: Tables, *, snapshot_id: int, active_id: int) -> DataFrame:
    """Every pair of an active and a candidate site of one entity that differs."""
    active = _entity_sites(tables, active_id).select("logical_entity_key", F.col("site_code").alias("_active"))
    moved = _entity_sites(tables, snapshot_id).join(active, "logical_entity_key").where(_differs("_active", "site_code"))
    detail = _json(active_site_code=F.col("_active"), candidate_site_code=F.col("site_code"))
    return _issue(moved, "ENTITY_MOVED_SITE", detail, entity=True)


def site_moved_region(tables: Tables, *, snapshot_id: int, active_id: int) -> DataFrame:
    """P10: the smallest region code stands for a site."""
    def regions(snapshot: int, name: str) -> DataFrame:
        return _rows(tables, snapshot).where("site_code is not null").groupBy("site_code").agg(
            F.min("region_code").alias(name))

    moved = regions(snapshot_id, "_new").join(regions(active_id, "_old"), "site_code").where(_differs("_old", "_new"))
    detail = _json(site_code=F.col("site_code"), active_region_code=F.col("_old"), candidate_region_code=F.col("_new"))
    return _issue(moved, "SITE_MOVED_REGION", detail, entity=False)


def reconciliation_issues(tables: Tables, *, snapshot_id: int, active_id: int | None) -> DataFrame:
    """All issues of one snapshot against facts and, where one is active, the active snapshot."""
    parts = [f(tables, snapshot_id=snapshot_id) for f in (
        duplicate_entity_sites, conflicting_site_region, pm_missing_from_workbook, workbook_missing_from_pm,
        workbook_site_no_pm)]
    if active_id is not None:
        parts += [f(tables, snapshot_id=snapshot_id, active_id=active_id) for f in (
            entity_added, entity_removed, entity_moved_site, site_moved_region)]
    issues = parts[0]
    for part in parts[1:]:
        issues = issues.unionByName(part)
    return issues


def reconciliation_summary(tables: Tables, *, snapshot_id: int, active_id: int | None) -> DataFrame:
    """One row of counts. The parser's own errors count as blocking even when no issue is found."""
    issues = reconciliation_issues(tables, snapshot_id=snapshot_id, active_id=active_id).select(
        "issue_type", "severity", F.lit(0).alias("parser_error_count"), F.lit(0).alias("parser_warning_count"))
    header = tables.snapshots.where(F.col("snapshot_id") == snapshot_id).select(
        F.lit("HEADER").alias("issue_type"), F.lit(None).cast("string").alias("severity"),
        "parser_error_count", "parser_warning_count")
    counted = issues.unionByName(header).agg(
        F.count_if(F.col("issue_type") == "HEADER").alias("_headers"),
        F.count_if(F.col("severity") == "ERROR").alias("_errors"),
        F.count_if(F.col("severity") == "WARNING").alias("_warnings"),
        *[F.count_if(F.col("issue_type") == issue).alias(name) for name, issue in COUNTS.items()],
        *[F.sum(c).cast("int").alias(c) for c in ("parser_error_count", "parser_warning_count")]).where("_headers = 1")
    return counted.select(
        F.lit(snapshot_id).cast("bigint").alias("snapshot_id"),
        F.lit(active_id).cast("bigint").alias("compared_active_snapshot_id"),
        (F.col("_errors") + F.col("parser_error_count")).alias("blocking_error_count"),
        (F.col("_warnings") + F.col("parser_warning_count")).alias("warning_count"), *COUNTS,
        "parser_error_count", "parser_warning_count")


def reconciliation_details(issues: DataFrame, *, issue_type: str | None = None, limit: int | None = None) -> DataFrame:
    """P12."""
    rows = issues if issue_type is None else issues.where(F.col("issue_type") == issue_type)
    return page(rows, "issue_type", "logical_entity_key", "detail_json", limit=limit)


# --- activation -----------------------------------------------------------------------------

def apply_snapshot(tables: Tables, *, snapshot_id: int, activated_at: datetime, activated_by: str | None = None) -> Tables:
    """Topology tables rebuilt from a snapshot, its header made the active one, and an audit row.

    Refuses a snapshot with parser errors or blocking issues; that check reads one
    header row. Counts in the audit row are aggregates of the new tables.
    """
    header = snapshots_with_latest_reconciliation(tables).where(F.col("snapshot_id") == snapshot_id)
    found = header.select("parser_error_count", "blocking_error_count").first()
    if found is None:
        raise ValueError(f"snapshot not found: {snapshot_id}")
    if found.parser_error_count > 0:
        raise ValueError("cannot apply snapshot with parser errors")
    if found.blocking_error_count > 0:
        raise ValueError("cannot apply snapshot with blocking reconciliation issues")
    prior = active_snapshot(tables).select("snapshot_id").first()

    rows = _rows(tables, snapshot_id)
    notes = header.select("source_file_name").scalar()
    rebuilt = {
        "topo_region": rows.where("region_code is not null").select(
            "region_code", F.coalesce("region_name", "region_code").alias("region_name")).distinct().withColumn("notes", notes),
        "topo_site": rows.where("site_code is not null").select(
            "site_code", "site_name", "region_code").distinct().withColumn("notes", notes),
        "topo_reporting": rows.where("reporting_key is not null").select(
            "reporting_key", F.coalesce("reporting_name", "reporting_key").alias("reporting_name"), "reporting_level",
            F.lit(None).cast("string").alias("parent_reporting_key")).distinct().withColumn("notes", notes),
        "topo_entity_map": first_per(
            rows.join(tables.entity_identity.select("logical_entity_key"), "logical_entity_key", "left_semi").select(
                "logical_entity_key", "site_code", "reporting_key", "mapping_source", "notes", "source_row_number"),
            ["logical_entity_key"], smallest=[F.col("source_row_number"), F.col("site_code")]).drop("source_row_number"),
    }
    chosen = F.col("snapshot_id") == snapshot_id
    snapshots = tables.snapshots.withColumns({
        "is_active_snapshot": chosen, "status": F.when(chosen, "applied").otherwise(F.col("status"))})
    loaded = {"rows_loaded_regions": "topo_region", "rows_loaded_sites": "topo_site",
              "rows_loaded_reporting": "topo_reporting", "rows_loaded_entity_map": "topo_entity_map"}
    named = None
    for count, table in loaded.items():
        part = rebuilt[table].select(F.lit(count).alias("what"))
        named = part if named is None else named.unionByName(part)
    audit = named.agg(*[F.count_if(F.col("what") == count).alias(count) for count in loaded]).select(
        F.lit(snapshot_id).cast("bigint").alias("snapshot_id"),
        F.lit(prior.snapshot_id if prior else None).cast("bigint").alias("prior_active_snapshot_id"),
        F.lit(activated_at).cast("timestamp_ntz").alias("activated_at"), *loaded,
        F.lit(activated_by).cast("string").alias("activated_by"))
    return tables.updated(**rebuilt, snapshots=snapshots, topology_activation=audit)
