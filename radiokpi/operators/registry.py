"""File registry: listing merge, queues, classification, outcomes and interval quality."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from radiokpi.functions import page
from radiokpi.operators.coverage import interval_topology_coverage
from radiokpi.schemas import CELL_FAMILIES
from radiokpi.tables import Tables

STALE_AFTER = timedelta(hours=24)
# Age of a stale row above, number of attempts that counts as repeated failure here.
REPEATED = 3
QUEUE = ["id", "source_name", "remote_directory", "remote_filename", "remote_path", "dataset_family",
         "interval_start", "revision", "extension"]
REMOTE = ["remote_size_bytes", "remote_modified_at"]
QUEUE_ORDER = ["interval_start", "revision", "remote_path"]
REGISTRY_ROW = [
    *QUEUE, *REMOTE, "status", "download_attempt_count", "ingest_attempt_count", "last_download_attempt_at",
    "last_ingest_attempt_at", "download_attempts", "local_staged_path", "file_hash", "ingest_run_id",
    "final_file_path", "last_error", "first_seen_at", "last_seen_at", "last_scan_at", "status_updated_at", "updated_at"]


def _moment(value: datetime) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def upsert_manifest(tables: Tables, listing: DataFrame, *, source_name: str, seen_at: datetime) -> DataFrame:
    """S3: registry after merging a listing on (source_name, remote_path).

    New files start as DISCOVERED; known ones refresh what the listing says and
    keep their status. The id of a new row is a hash of its key, so no counter is
    shared between tasks. ``merge_action`` tells discovered, updated and untouched rows apart.
    """
    now = _moment(seen_at)
    key = ["source_name", "remote_path"]
    described = ["remote_directory", "remote_filename", "dataset_family", "interval_start", "revision", "extension", *REMOTE]
    listed = listing.select("remote_path", *[F.col(c).alias(f"_{c}") for c in described])
    listed = listed.withColumn("source_name", F.lit(source_name)).withColumn("_listed", F.lit(True))
    known = tables.file_registry.withColumn("_known", F.lit(True))
    joined = known.join(listed, key, "full_outer")
    new, seen = F.col("_known").isNull(), F.col("_listed").isNotNull()
    values = {c: F.when(seen, F.col(f"_{c}")).otherwise(F.col(c)) for c in described}
    values |= {c: F.when(seen, now).otherwise(F.col(c)) for c in ("last_seen_at", "last_scan_at", "updated_at")}
    values |= {c: F.when(new, now).otherwise(F.col(c)) for c in ("first_seen_at", "status_updated_at", "created_at")}
    values |= {c: F.coalesce(F.col(c), F.lit(0))
               for c in ("download_attempts", "download_attempt_count", "ingest_attempt_count")}
    values["status"] = F.coalesce("status", F.lit("DISCOVERED"))
    values["id"] = F.coalesce("id", F.xxhash64(*key))
    action = F.when(new, "discovered").when(seen, "updated").otherwise("untouched")
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in tables.file_registry.columns],
                         action.alias("merge_action"))


def manifest_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count_if(F.col("merge_action") == "discovered").alias("discovered"),
                      F.count_if(F.col("merge_action") == "updated").alias("updated"))


# --- queues and lists -----------------------------------------------------------------------

def _only(frame: DataFrame, wanted: DataFrame | None, column: str) -> DataFrame:
    return frame if wanted is None else frame.join(wanted.select(column), column, "left_semi")


def pending_downloads(tables: Tables, *, source_name: str, limit: int | None = None,
                      remote_paths: DataFrame | None = None) -> DataFrame:
    """F13."""
    rows = tables.file_registry.where(
        (F.col("source_name") == source_name) & F.col("status").isin("DISCOVERED", "FAILED_DOWNLOAD"))
    return page(_only(rows, remote_paths, "remote_path").select(*QUEUE, "status"), *QUEUE_ORDER, limit=limit)


def pending_ingests(tables: Tables, *, source_name: str, limit: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """F13."""
    rows = tables.file_registry.where(
        (F.col("source_name") == source_name) & F.col("status").isin("DOWNLOADED", "FAILED_INGEST"))
    rows = _only(rows, ids, "id").select(*QUEUE[:5], "local_staged_path", *QUEUE[5:], *REMOTE, "status")
    return page(rows, *QUEUE_ORDER, limit=limit)


def retry_candidates(tables: Tables, requested: DataFrame, *, source_name: str, stage: str) -> DataFrame:
    """requested ids with whether their row failed in ``stage`` (download or ingest) and may be retried."""
    failed = tables.file_registry.where(
        (F.col("source_name") == source_name) & (F.col("status") == f"FAILED_{stage.upper()}"))
    columns = [c for c in (*QUEUE[:5], *(["local_staged_path"] if stage == "ingest" else []), *QUEUE[5:], *REMOTE, "status")]
    return requested.select("id").distinct().join(failed.select(*columns, F.lit(True).alias("_hit")), "id", "left").select(
        *columns, F.coalesce("_hit", F.lit(False)).alias("retryable"))


def registry_rows(tables: Tables, *, statuses: Sequence[str] | None = None, ids: DataFrame | None = None,
                  limit: int | None = None) -> DataFrame:
    """F15."""
    rows = tables.file_registry
    if statuses is not None:
        rows = rows.where(F.col("status").isin(*statuses))
    return page(_only(rows, ids, "id").select(*REGISTRY_ROW), "-status_updated_at", "-id", limit=limit)


def row_by_id(tables: Tables, *, remote_file_id: int) -> DataFrame:
    """F15."""
    return registry_rows(tables).where(F.col("id") == remote_file_id)


def failure_rows(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """F15."""
    return registry_rows(tables, statuses=("FAILED_DOWNLOAD", "FAILED_INGEST"), limit=limit)


def recent_failures(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """F16."""
    columns = ["source_name", "remote_path", "status", "last_error", *REMOTE, "first_seen_at", "last_seen_at",
               "last_scan_at", "download_attempt_count", "ingest_attempt_count", "last_download_attempt_at",
               "last_ingest_attempt_at", "updated_at"]
    rows = tables.file_registry.where(F.col("status").isin("FAILED_DOWNLOAD", "FAILED_INGEST"))
    return page(rows.select(*columns), "-updated_at", "remote_path", "source_name", limit=limit)


# --- aggregates -----------------------------------------------------------------------------

def registry_status_counts(tables: Tables) -> DataFrame:
    """A31."""
    return tables.file_registry.groupBy("status").agg(F.count("*").alias("file_count"))


def source_intervals(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """A32. The collected sets hold family and status names, of which there are a handful."""
    intervals = tables.file_registry.where("interval_start is not null").groupBy("interval_start").agg(
        F.count("*").alias("total_files"),
        F.array_sort(F.collect_set("dataset_family")).alias("families_present"),
        F.count_distinct("dataset_family").alias("family_count"),
        F.array_sort(F.collect_set("status")).alias("statuses_present"),
        F.max("revision").alias("max_revision"), F.max("last_seen_at").alias("last_seen_at"),
        F.max("last_scan_at").alias("last_scan_at"))
    return page(intervals, "-interval_start", limit=limit)


def ingested_interval_files(tables: Tables, *, dataset_families: Sequence[str] = CELL_FAMILIES,
                            intervals: DataFrame | None = None) -> DataFrame:
    """A33."""
    rows = tables.file_registry.where(
        (F.col("status") == "INGESTED") & F.col("dataset_family").isin(*dataset_families)
        & F.col("remote_filename").isNotNull() & F.col("interval_start").isNotNull())
    return _only(rows, intervals, "interval_start").select("interval_start", "dataset_family", "remote_filename").distinct()


def latest_scan(tables: Tables) -> DataFrame:
    """A34."""
    return tables.file_registry.agg(F.max("last_scan_at").alias("latest_scan_at"))


def source_interval_quality(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """Intervals with family completeness and the share of their cells that have a site.

    An interval without any required family is 'partial' in quality_status while partial_interval is false.
    """
    intervals = source_intervals(tables, limit=limit)
    files = ingested_interval_files(tables, intervals=intervals if limit is not None else None)
    names = files.select(F.col("remote_filename").alias("source_file")).distinct()
    cells = interval_topology_coverage(tables, names)
    required = F.array(*[F.lit(f) for f in CELL_FAMILIES])
    missing = F.array_except(required, "families_present")
    mapped = F.coalesce("topology_mapped_count", F.lit(0))
    unmapped = F.coalesce("topology_unmapped_count", F.lit(0))
    total = (mapped + unmapped).cast("decimal(20,0)")
    # Quality words and notes.
    return intervals.join(cells, "interval_start", "left").select(
        "interval_start", "total_files", "families_present", F.size("families_present").alias("family_count"),
        "statuses_present", "max_revision", "last_seen_at", "last_scan_at", missing.alias("missing_families"),
        ((F.size(missing) > 0) & F.arrays_overlap("families_present", required)).alias("partial_interval"),
        F.when(F.size(missing) == 0, "complete").otherwise("partial").alias("quality_status"),
        F.when(F.size(missing) == 0, "Required LTE PM families discovered for this interval.").otherwise(
            F.concat(F.lit("Missing expected families: "), F.array_join(missing, ", "))).alias("quality_notes"),
        mapped.alias("topology_mapped_count"), unmapped.alias("topology_unmapped_count"),
        F.when(total > 0, F.round(mapped.cast("decimal(20,0)") / total * 100, 2).cast("double")).alias(
            "topology_coverage_pct"))


# --- classification -------------------------------------------------------------------------

def classify_registry(tables: Tables, *, now: datetime, rows: DataFrame | None = None) -> DataFrame:
    """G1: operational class and reason of every registry row; the first matching rule wins.

    A staged file counts as present when its path is in ``storage_listing`` (column path).
    """
    rows = tables.file_registry if rows is None else rows
    listing = tables.storage_listing.select(F.col("path").alias("local_staged_path"), F.lit(True).alias("_staged"))
    latest = latest_scan(tables).scalar()
    joined = rows.join(listing, "local_staged_path", "left").select(*rows.columns, "_staged")

    status, path = F.col("status"), F.nullif("local_staged_path", F.lit(""))
    staged = F.coalesce("_staged", F.lit(False)) & path.isNotNull()
    failed_download, failed_ingest = status == "FAILED_DOWNLOAD", status == "FAILED_INGEST"
    found, loaded = status == "DISCOVERED", status == "DOWNLOADED"
    stale = F.coalesce(F.col("status_updated_at") < _moment(now - STALE_AFTER), F.lit(False))
    unseen = F.coalesce(F.col("last_seen_at") < latest, F.lit(False))
    no_stage = F.when(path.isNull(), "local_staged_path is missing").otherwise(
        F.concat(F.lit("staged file not found: "), path))
    # Class names and reason texts.
    rules = [
        (failed_download & (F.coalesce("download_attempt_count", F.lit(0)) >= REPEATED),
         "repeatedly_failing_download", F.lit("download has failed at least three times")),
        (failed_download, "retryable_download", F.lit("download failed and can be retried from the registry")),
        ((failed_ingest | loaded) & ~staged, "reconciliation_needed", no_stage),
        (failed_ingest & (F.coalesce("ingest_attempt_count", F.lit(0)) >= REPEATED),
         "repeatedly_failing_ingest", F.lit("ingest has failed at least three times")),
        (failed_ingest, "retryable_ingest", F.lit("staged file exists and ingest can be retried")),
        (found & stale, "stale_pending", F.lit("discovered row has been pending longer than the stale threshold")),
        (loaded & stale, "stale_pending", F.lit("downloaded row has been pending longer than the stale threshold")),
        ((found | loaded) & unseen, "not_seen_in_latest_scan",
         F.lit("row was discovered previously but not seen in the latest scan")),
        (found, "pending_download", F.lit("remote file discovered but not yet downloaded")),
        (loaded, "pending_ingest", F.lit("downloaded and staged for ingest")),
        (status == "INGESTED", "completed", F.lit("ingest completed successfully")),
        (status == "SKIPPED_DUPLICATE", "completed", F.lit("ingest skipped as duplicate")),
    ]
    label, reason = F, F
    for condition, name, text in rules:
        label, reason = label.when(condition, name), reason.when(condition, text)
    return joined.select(
        *rows.columns, label.otherwise("unknown").alias("classification"),
        reason.otherwise(F.concat(F.lit("unrecognized status: "), status)).alias("classification_reason"))


def inspect_failures(tables: Tables, *, now: datetime, limit: int | None = None) -> DataFrame:
    """G2."""
    return classify_registry(tables, now=now, rows=failure_rows(tables, limit=limit))


def reconciliation_preview(tables: Tables, *, now: datetime, limit: int | None = None) -> DataFrame:
    """G3."""
    waiting = registry_rows(tables, statuses=("DOWNLOADED", "FAILED_INGEST"), limit=limit)
    return classify_registry(tables, now=now, rows=waiting).where("classification = 'reconciliation_needed'")


def operational_status(tables: Tables, *, now: datetime) -> DataFrame:
    """One row of counts. Classes are counted over the whole registry, not its newest part."""
    def status(name):
        return F.count_if(F.col("status") == name)

    def label(name):
        return F.count_if(F.col("classification") == name)

    return classify_registry(tables, now=now).agg(
        status("DISCOVERED").alias("pending_downloads"), status("DOWNLOADED").alias("pending_ingests"),
        status("FAILED_DOWNLOAD").alias("failed_downloads"), status("FAILED_INGEST").alias("failed_ingests"),
        status("FAILED_DOWNLOAD").alias("retryable_downloads"), label("retryable_ingest").alias("retryable_ingests"),
        label("reconciliation_needed").alias("reconciliation_needed"),
        label("not_seen_in_latest_scan").alias("not_seen_in_latest_scan"),
        label("repeatedly_failing_download").alias("repeatedly_failing_downloads"),
        label("repeatedly_failing_ingest").alias("repeatedly_failing_ingests"),
        label("stale_pending").alias("stale_pending_rows"), F.max("last_scan_at").alias("latest_scan_at"))


# --- outcomes -------------------------------------------------------------------------------

def _newest(value: Column) -> Column:
    return F.max_by(value, F.col("happened_at"))


def apply_transfer_outcomes(tables: Tables, outcomes: DataFrame) -> DataFrame:
    """Registry after download attempts (id, status, local_staged_path, error, happened_at).

    Every attempt counts; the newest one sets status and error. A failure keeps the staged path.
    """
    done = F.col("status") == "DOWNLOADED"
    merged = outcomes.groupBy("id").agg(
        F.count("*").alias("_attempts"), F.max("happened_at").alias("_at"), _newest(F.col("status")).alias("_status"),
        _newest(F.when(~done, F.col("error"))).alias("_error"),
        F.max_by(F.col("local_staged_path"), F.when(done, F.col("happened_at"))).alias("_path"),
        F.bool_or(done).alias("_done"))
    hit = F.col("_status").isNotNull()
    values = {
        "status": F.coalesce("_status", "status"),
        **{c: F.col(c) + F.coalesce("_attempts", F.lit(0)).cast("int")
           for c in ("download_attempts", "download_attempt_count")},
        "local_staged_path": F.when(F.col("_done"), F.col("_path")).otherwise(F.col("local_staged_path")),
        "last_error": F.when(hit, F.col("_error")).otherwise(F.col("last_error")),
        **{c: F.coalesce("_at", c) for c in ("last_download_attempt_at", "status_updated_at", "updated_at")},
    }
    registry = tables.file_registry
    return registry.join(merged, "id", "left").select(*[values.get(c, F.col(c)).alias(c) for c in registry.columns])


def apply_ingest_outcomes(tables: Tables, outcomes: DataFrame) -> DataFrame:
    """Registry after ingest attempts (id, status, file_hash, ingest_run_id, final_file_path, error, happened_at)."""
    done = F.col("status") != "FAILED_INGEST"
    facts = ("file_hash", "ingest_run_id", "final_file_path")
    merged = outcomes.groupBy("id").agg(
        F.count("*").alias("_attempts"), F.max("happened_at").alias("_at"), _newest(F.col("status")).alias("_status"),
        _newest(F.when(~done, F.col("error"))).alias("_error"), F.bool_or(done).alias("_done"),
        *[F.max_by(F.col(c), F.when(done, F.col("happened_at"))).alias(f"_{c}") for c in facts])
    hit = F.col("_status").isNotNull()
    values = {
        "status": F.coalesce("_status", "status"),
        "ingest_attempt_count": F.col("ingest_attempt_count") + F.coalesce("_attempts", F.lit(0)).cast("int"),
        **{c: F.when(F.col("_done"), F.col(f"_{c}")).otherwise(F.col(c)) for c in facts},
        "last_error": F.when(hit, F.col("_error")).otherwise(F.col("last_error")),
        **{c: F.coalesce("_at", c) for c in ("last_ingest_attempt_at", "status_updated_at", "updated_at")},
    }
    registry = tables.file_registry
    return registry.join(merged, "id", "left").select(*[values.get(c, F.col(c)).alias(c) for c in registry.columns])


def cycle_summary(tables: Tables, *, candidates: DataFrame, downloads: DataFrame, ingests: DataFrame,
                  now: datetime) -> DataFrame:
    """Counts of one cycle. reconciliation_needed is derived from the registry class of every failed ingest."""
    failed = ingests.where("status = 'FAILED_INGEST'").select("id")
    broken = classify_registry(tables, now=now, rows=_only(tables.file_registry, failed, "id")).where(
        "classification = 'reconciliation_needed'")
    events = (
        candidates.select(F.lit("scanned").alias("event"))
        .unionByName(downloads.select(F.col("status").alias("event")))
        .unionByName(ingests.select(F.col("status").alias("event")))
        .unionByName(broken.select(F.lit("reconciliation_needed").alias("event"))))
    names = {"scanned": "scanned", "DOWNLOADED": "downloaded", "INGESTED": "ingested",
             "SKIPPED_DUPLICATE": "skipped_duplicates", "FAILED_DOWNLOAD": "failed_downloads",
             "FAILED_INGEST": "failed_ingests", "reconciliation_needed": "reconciliation_needed"}
    return events.agg(*[F.count_if(F.col("event") == event).alias(name) for event, name in names.items()])


def cycle_plan(tables: Tables, *, source_name: str, candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """What a cycle over the scanned files would download, without writing anything."""
    return pending_downloads(tables, source_name=source_name, remote_paths=candidates, limit=limit)


def merge_transfer_and_ingest(downloads: DataFrame, ingests: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per downloaded file with the ingest status where there is one and the first error."""
    ingest = ingests.select("id", F.col("status").alias("_ingest_status"), F.col("error").alias("_ingest_error"))
    scanned = candidates.select("remote_path", F.col("filename").alias("_filename"), "dataset_family",
                                "interval_start", "revision")
    joined = downloads.join(ingest, "id", "left").join(scanned, "remote_path", "left")
    base = F.regexp_extract("remote_path", r"([^/]+)/*$", 1)
    return joined.select(
        "id", F.coalesce("_filename", F.nullif("remote_filename", F.lit("")), base).alias("remote_file"),
        "dataset_family", "interval_start", "revision", F.col("local_staged_path").alias("downloaded_to"),
        F.coalesce("_ingest_status", "status").alias("status"),
        F.coalesce(F.nullif("error", F.lit("")), "_ingest_error").alias("error"))


def retry_merge(original: DataFrame, retried: DataFrame) -> DataFrame:
    """Per id the retry's result where there is one."""
    rest = [c for c in original.columns if c != "id"]
    again = retried.select("id", F.struct(*rest).alias("_again"))
    joined = original.join(again, "id", "left")
    return joined.select("id", *[F.when(F.col("_again").isNotNull(), F.col("_again")[c]).otherwise(F.col(c)).alias(c)
                                 for c in rest])
