"""File audit: ingest observability, reconciliation and lifecycle updates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from radiokpi.functions import page
from radiokpi.operators.activity import rows_by_file_time
from radiokpi.tables import Tables

# Fixed value: message of a lifecycle that could not be confirmed.
MISSING_FILE = "Legacy lifecycle backfill could not confirm final file on disk."


def _raw_by_file(tables: Tables, files: DataFrame) -> DataFrame:
    """Rows and times per file; reduced per (file, time) first, so the distinct count is a plain count."""
    return rows_by_file_time(tables, files).groupBy("source_file").agg(
        F.sum("row_count").alias("raw_row_count"), F.count("*").alias("distinct_collect_times"),
        F.min("collect_time").alias("min_collect_time"), F.max("collect_time").alias("max_collect_time"))


def file_ingest_observability(tables: Tables) -> DataFrame:
    """A17. Raw rows are matched by file name, so a later file of the same name shows the same rows."""
    joined = tables.file_audit.join(_raw_by_file(tables, tables.file_audit), "source_file", "left")
    return joined.select(
        "source_file", "file_hash", "run_id", "trigger_type", "source_type", "processed_at", "status",
        "csv_files_found", "input_rows_read", "normalized_rows_emitted", "rows_inserted",
        F.coalesce("raw_row_count", F.lit(0)).alias("raw_row_count"), "lifecycle_status", "lifecycle_action",
        "normalization_status", "normalized_at", "final_file_path", "error_message", "normalization_error",
        "distinct_collect_times", "min_collect_time", "max_collect_time")


def lifecycle_exceptions(tables: Tables) -> DataFrame:
    """F10."""
    return file_ingest_observability(tables).where(
        "lifecycle_status <> 'COMPLETED' or (status = 'SUCCESS' and raw_row_count = 0)"
        " or (status = 'FAILED' and raw_row_count > 0) or (status = 'SUCCESS' and normalization_status = 'FAILED')")


def recent_audits(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """S23. Newest by processing time; the run id settles ties."""
    columns = ["source_file", "file_hash", "run_id", "trigger_type", "source_type", "processed_at", "status",
               "csv_files_found", "input_rows_read", "normalized_rows_emitted", "rows_inserted", "unknown_columns",
               "null_counter_values", "lifecycle_status", "lifecycle_action", "normalization_status",
               "normalized_at", "normalization_error", "final_file_path", "error_message"]
    return page(tables.file_audit.select(*columns), "-processed_at", "-run_id", limit=limit)


def recent_for_reconciliation(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """S23."""
    columns = ["source_file", "run_id", "status", "rows_inserted", "lifecycle_status", "lifecycle_action",
               "normalization_status", "normalized_at", "normalization_error", "final_file_path", "error_message"]
    return page(tables.file_audit.select(*columns, "processed_at"), "-processed_at", "-run_id", limit=limit).drop("processed_at")


def pending_lifecycle(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """S23."""
    columns = ["source_file", "run_id", "status", "lifecycle_status", "lifecycle_action", "final_file_path", "error_message"]
    pending = tables.file_audit.where("lifecycle_status = 'PENDING'").select(*columns, "processed_at")
    return page(pending, "-processed_at", "-run_id", limit=limit).drop("processed_at")


def has_successful_hash(tables: Tables, hashes: DataFrame) -> DataFrame:
    """Whether each hash (column file_hash) was already loaded."""
    loaded = tables.file_audit.where("status = 'SUCCESS'").select("file_hash").distinct().withColumn("_hit", F.lit(True))
    return hashes.select("file_hash").join(loaded, "file_hash", "left").select(
        "file_hash", F.coalesce("_hit", F.lit(False)).alias("has_success"))


def _listed(tables: Tables) -> DataFrame:
    return tables.storage_listing.select(F.col("path").alias("final_file_path"), F.lit(True).alias("_listed"))


def reconcile_ingest_files(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """Audited files with at least one mismatch between audit, facts and storage."""
    audits = recent_for_reconciliation(tables, limit=limit)
    counts = _raw_by_file(tables, audits).select("source_file", F.col("raw_row_count").alias("_raw"))
    joined = audits.join(counts, "source_file", "left").join(_listed(tables), "final_file_path", "left")
    path, raw = F.nullif("final_file_path", F.lit("")), F.coalesce("_raw", F.lit(0))
    status = F.col("status")
    # Issue names.
    issues = F.array_compact(F.array(
        F.when((status == "SUCCESS") & (raw == 0), "success_without_raw_rows"),
        F.when((status == "FAILED") & (raw > 0), "failed_with_raw_rows"),
        F.when(F.col("lifecycle_status") != "COMPLETED", F.concat(F.lit("lifecycle_"), F.lower("lifecycle_status"))),
        F.when(path.isNotNull() & F.col("_listed").isNull(), "final_file_missing_on_disk"),
        F.when(status.isin("SUCCESS", "SKIPPED_DUPLICATE") & path.isNull(), "missing_final_file_path")))
    return joined.select("source_file", "run_id", "status", raw.alias("raw_rows"), "lifecycle_status",
                         "lifecycle_action", "final_file_path", issues.alias("issues")).where(F.size("issues") > 0)


def backfill_lifecycle(tables: Tables) -> DataFrame:
    """Audit table with every PENDING lifecycle settled by whether the final file is in storage."""
    audits = tables.file_audit
    joined = audits.join(_listed(tables), "final_file_path", "left")
    pending = F.col("lifecycle_status") == "PENDING"
    there = F.col("_listed").isNotNull() & (F.col("final_file_path") != "")
    values = {
        "lifecycle_status": F.when(pending, F.when(there, "COMPLETED").otherwise("FAILED")).otherwise(F.col("lifecycle_status")),
        "error_message": F.when(pending & ~F.coalesce(there, F.lit(False)), F.coalesce("error_message", F.lit(MISSING_FILE)))
        .otherwise(F.col("error_message")),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in audits.columns])


def audit_write(tables: Tables, summaries: DataFrame, *, processed_at: datetime) -> DataFrame:
    """Audit table with one row per ingest summary appended."""
    added = summaries.withColumns({
        "processed_at": F.lit(processed_at).cast("timestamp_ntz"),
        "normalization_status": F.lit("PENDING"),
    })
    return tables.file_audit.unionByName(added, allowMissingColumns=True).select(*tables.file_audit.columns)


def lifecycle_update(tables: Tables, updates: DataFrame) -> DataFrame:
    """Lifecycle fields replaced for the given runs (run_id and the four fields)."""
    fields = ["lifecycle_status", "lifecycle_action", "final_file_path", "error_message"]
    new = updates.select("run_id", F.struct(*fields).alias("_new"))
    audits = tables.file_audit
    return audits.join(new, "run_id", "left").select(*[
        (F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)) if c in fields else F.col(c)).alias(c)
        for c in audits.columns])


def mark_normalization(tables: Tables, *, now: datetime, error: str | None = None) -> DataFrame:
    """Loaded files waiting for entity sync become COMPLETED, or FAILED with the error."""
    waiting = (F.col("status") == "SUCCESS") & (F.col("normalization_status") == "PENDING")
    done = waiting if error is None else F.lit(False)
    values = {
        "normalization_status": F.when(waiting, "COMPLETED" if error is None else "FAILED").otherwise(F.col("normalization_status")),
        "normalized_at": F.when(done, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("normalized_at")),
        "normalization_error": F.when(waiting, F.lit(error).cast("string")).otherwise(F.col("normalization_error")),
    }
    return tables.file_audit.select(*[values.get(c, F.col(c)).alias(c) for c in tables.file_audit.columns])
