"""Registered registry, audit and lifecycle queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from radiokpi.operators import audit as a, integrity as i, registry as g
from radiokpi.plans.query import Query

_NOW, _SCAN = datetime(2001, 8, 1, 12), datetime(2026, 3, 9)
_TS_SCAN = "cast('2026-03-09' as timestamp)"
_QUEUE = "id, source_name, remote_directory, remote_filename, remote_path, dataset_family, interval_start, revision, extension"
_REMOTE = "remote_size_bytes, remote_modified_at"
_ROW = ", ".join(g.REGISTRY_ROW)
_FAILED = "status in ('FAILED_DOWNLOAD', 'FAILED_INGEST')"
_ORDER = "order by interval_start nulls last, revision nulls last, remote_path"
_DIRECT = ("(select r.*, local_staged_path is not null and local_staged_path in (select path from storage_listing) as there "
           "from file_registry r)")
_CLASSED = f"""(select * exclude (there, old, unseen, waiting), case
      when status = 'INGESTED' or status = 'SKIPPED_DUPLICATE' then 'completed'
      when status = 'FAILED_DOWNLOAD' then if(download_attempt_count > 2, 'repeatedly_failing_download', 'retryable_download')
      when not waiting and not there then 'reconciliation_needed'
      when status = 'FAILED_INGEST' then if(ingest_attempt_count > 2, 'repeatedly_failing_ingest', 'retryable_ingest')
      when old then 'stale_pending' when unseen then 'not_seen_in_latest_scan'
      when waiting then 'pending_download' else 'pending_ingest' end as classification, case
      when status = 'INGESTED' then 'ingest completed successfully' when status = 'SKIPPED_DUPLICATE' then 'ingest skipped as duplicate'
      when status = 'FAILED_DOWNLOAD' then if(download_attempt_count > 2, 'download has failed at least three times',
        'download failed and can be retried from the registry')
      when not waiting and local_staged_path is null then 'local_staged_path is missing'
      when not waiting and not there then 'staged file not found: ' || local_staged_path
      when status = 'FAILED_INGEST' then if(ingest_attempt_count > 2, 'ingest has failed at least three times',
        'staged file exists and ingest can be retried')
      when old then if(waiting, 'discovered', 'downloaded') || ' row has been pending longer than the stale threshold'
      when unseen then 'row was discovered previously but not seen in the latest scan'
      when waiting then 'remote file discovered but not yet downloaded' else 'downloaded and staged for ingest' end as classification_reason
    from (select *, status = 'DISCOVERED' as waiting, status_updated_at < cast('2001-07-31 12:00' as timestamp) as old,
        last_seen_at < (select max(last_scan_at) from file_registry) as unseen from {_DIRECT}) as c)"""
_AUDIT = ("source_file, file_hash, run_id, trigger_type, source_type, processed_at, status, csv_files_found, input_rows_read, "
          "normalized_rows_emitted, rows_inserted, {extra}lifecycle_status, lifecycle_action, normalization_status, normalized_at, "
          "normalization_error, final_file_path, error_message")
_OBSERVED = """(select f.source_file, file_hash, run_id, trigger_type, source_type, processed_at, status, csv_files_found, input_rows_read,
      normalized_rows_emitted, rows_inserted, ifnull(n, 0) as raw_row_count, lifecycle_status, lifecycle_action, normalization_status,
      normalized_at, final_file_path, error_message, normalization_error, distinct_collect_times, min_collect_time, max_collect_time
    from file_audit f left join (select source_file, count(*) as n, count(distinct collect_time) as distinct_collect_times,
      min(collect_time) as min_collect_time, max(collect_time) as max_collect_time from pm_sample group by all) r using (source_file))"""


def _audits(t):
    """Audit table with the empty array column the stored one has."""
    return t.updated(file_audit=t.file_audit.withColumn("unknown_columns", F.array().cast("array<string>")))


def _listing(t):
    """A new scan: every second known file with a new size, and one new file per order."""
    known = t.file_registry.where("id % 2 = 0").select(
        "remote_path", "remote_directory", "remote_filename", "dataset_family", "interval_start", "revision", "extension",
        (F.col("id") + 1000).alias("remote_size_bytes"), "remote_modified_at")
    new = t.file_registry.select(
        F.concat(F.lit("/new"), "remote_path").alias("remote_path"), F.lit("/new").alias("remote_directory"), *known.columns[2:7],
        F.col("id").alias("remote_size_bytes"), "remote_modified_at")
    return known.unionByName(new)


_MERGED = f"""(
    select source_name, remote_path, if(id % 2 = 0, id + 1000, remote_size_bytes) as remote_size_bytes, status,
      if(id % 2 = 0, {_TS_SCAN}, last_seen_at) as last_seen_at, first_seen_at, download_attempts,
      if(id % 2 = 0, 'updated', 'untouched') as merge_action from file_registry
    union all
    select 'default', '/new' || remote_path, id, 'DISCOVERED', {_TS_SCAN}, {_TS_SCAN}, 0, 'discovered' from file_registry)"""


def _merged(t):
    return g.upsert_manifest(t, _listing(t), source_name="default", seen_at=_SCAN)


def _transfers(t):
    """Download outcomes: a failure and then a success for some files, a failure only for others."""
    waiting = t.file_registry.where("status in ('DISCOVERED', 'FAILED_DOWNLOAD')")
    failed = waiting.select("id", F.lit("FAILED_DOWNLOAD").alias("status"), F.lit(None).cast("string").alias("local_staged_path"),
                            F.concat(F.lit("refused "), F.col("id").cast("string")).alias("error"),
                            F.lit(datetime(2026, 3, 9, 1)).cast("timestamp_ntz").alias("happened_at"))
    loaded = waiting.where("id % 3 = 1").select(
        "id", F.lit("DOWNLOADED").alias("status"), F.concat(F.lit("/fresh"), "remote_path").alias("local_staged_path"),
        F.lit(None).cast("string").alias("error"), F.lit(datetime(2026, 3, 9, 2)).cast("timestamp_ntz").alias("happened_at"))
    return failed.unionByName(loaded)


def _ingests(t):
    rows = t.file_registry.where("status in ('DOWNLOADED', 'FAILED_INGEST')")
    kind = F.when(F.col("id") % 3 == 0, "INGESTED").when(F.col("id") % 3 == 1, "SKIPPED_DUPLICATE").otherwise("FAILED_INGEST")
    bad = kind == "FAILED_INGEST"
    return rows.select(
        "id", kind.alias("status"), F.when(~bad, F.concat(F.lit("h"), F.col("id").cast("string"))).alias("file_hash"),
        F.when(~bad, F.concat(F.lit("r"), F.col("id").cast("string"))).alias("ingest_run_id"),
        F.when(~bad, F.concat(F.lit("/done"), "remote_path")).alias("final_file_path"),
        F.when(bad, F.concat(F.lit("broken "), F.col("id").cast("string"))).alias("error"),
        F.lit(datetime(2026, 3, 9, 3)).cast("timestamp_ntz").alias("happened_at"))


_KIND = "case id % 3 when 0 then 'INGESTED' when 1 then 'SKIPPED_DUPLICATE' else 'FAILED_INGEST' end"
_W = "status in ('DISCOVERED', 'FAILED_DOWNLOAD')"
_I = "status in ('DOWNLOADED', 'FAILED_INGEST')"


def _last_downloads(t):
    """Final download result per file, as a cycle reports them."""
    results = _transfers(t).groupBy("id").agg(F.max_by(F.struct("status", "local_staged_path", "error"), "happened_at").alias("last_result"))
    return results.select("id", "last_result.*").join(t.file_registry.select("id", "remote_path", "remote_filename"), "id")


def _candidates(t):
    return t.file_registry.where("id % 5 <> 0").select(
        "remote_path", F.col("remote_filename").alias("filename"), "dataset_family", "interval_start", "revision")


def _cycle_ingests(t):
    return t.file_registry.where("id % 6 = 0 or id % 6 = 4").where("id % 3 = 1").select(
        "id", F.when(F.col("id") % 2 == 0, "INGESTED").otherwise("FAILED_INGEST").alias("status"),
        F.when(F.col("id") % 4 == 0, "late error").alias("error"))


def _settled(t):
    """Files ready for ingest whose ids are asked for; some ids exist in no such state."""
    return t.orders.where("o_orderkey % 2 = 1").select((F.col("o_orderkey") * 2 + 1).alias("id"))


_ASKED = "(select o_orderkey * 2 + 1 as id from orders where o_orderkey % 2 = 1)"

_LACKING = {"topo_region": "(select * from topo_region where region_code <> 'ASIA')", "counter_reference":
            "(select * from counter_reference where vendor <> 'ZTE')"}


def _lacking(t):
    """Tables without one region and without the known counters, so that references dangle."""
    return t.updated(topo_region=t.topo_region.where("region_code <> 'ASIA'"), counter_reference=t.counter_reference.where("vendor <> 'ZTE'"))


_DANGLING = " union all ".join(f"""
    select '{table}.{column}' as check_name, {column}::varchar as value, count(*) as row_count from {table}
    where {column} is not null and {column} not in (select {key} from {_LACKING.get(other, other)}) group by all""" for table, column, other, key in i.REFERENCES)
_REPEATED = " union all ".join([f"""
    select '{table}({', '.join(columns)})' as check_name, concat_ws('|', {', '.join(columns)}) as value, count(*) as row_count
    from {table} group by all having count(*) > 1""" for table, columns in i.UNIQUE] + [
    "select 'file_audit(file_hash of SUCCESS)', file_hash, count(*) from file_audit where status = 'SUCCESS' group by all having count(*) > 1",
    "select 'snapshots(active)', 'active', count(*) from snapshots where is_active_snapshot having count(*) > 1"])


QUERIES = [
    # --- integrity
    Query("dangling_references", lambda t: i.dangling_references(_lacking(t)), _DANGLING),
    Query("repeated_keys", i.repeated_keys, _REPEATED),

    # --- registry
    Query("upsert_manifest", lambda t: _merged(t).select("source_name", "remote_path", "remote_size_bytes", "status", "last_seen_at",
                                                         "first_seen_at", "download_attempts", "merge_action"), f"select * from {_MERGED}"),
    Query("upsert_manifest_counts", lambda t: g.manifest_counts(_merged(t)), f"""
        select count(*) filter (merge_action = 'discovered') as discovered, count(*) filter (merge_action = 'updated') as updated from {_MERGED}"""),
    Query("pending_downloads", lambda t: g.pending_downloads(t, source_name="default", limit=200),
          f"select {_QUEUE}, status from file_registry where {_W} {_ORDER} limit 200"),
    Query("pending_ingests", lambda t: g.pending_ingests(t, source_name="default", ids=_settled(t)), f"""
        select {_QUEUE}, local_staged_path, {_REMOTE}, status from file_registry where {_I} and id in (select id from {_ASKED})"""),
    *[Query("retry_candidates" if stage == "ingest" else f"retry_candidates_{stage}",
            lambda t, stage=stage: g.retry_candidates(t, _settled(t), source_name="default", stage=stage), f"""
        select a.id, r.* exclude (id, hit), ifnull(hit, false) as retryable from {_ASKED} a left join
          (select {_QUEUE}, {'local_staged_path,' if stage == 'ingest' else ''} {_REMOTE}, status, true as hit from file_registry
           where status = 'FAILED_{stage.upper()}') r on r.id = a.id""") for stage in ("ingest", "download")],
    Query("registry_rows", lambda t: g.registry_rows(t, statuses=["DISCOVERED", "INGESTED"]),
          f"select {_ROW} from file_registry where status in ('DISCOVERED', 'INGESTED')"),
    Query("row_by_id", lambda t: g.row_by_id(t, remote_file_id=29), f"select {_ROW} from file_registry where id = 29"),
    Query("failures", lambda t: g.failure_rows(t, limit=100), f"""
        select {_ROW} from file_registry where {_FAILED} order by status_updated_at desc nulls first, id desc limit 100"""),
    Query("recent_failures", lambda t: g.recent_failures(t, limit=100), f"""
        select source_name, remote_path, status, last_error, {_REMOTE}, first_seen_at, last_seen_at, last_scan_at, download_attempt_count,
          ingest_attempt_count, last_download_attempt_at, last_ingest_attempt_at, updated_at from file_registry where {_FAILED}
        order by updated_at desc, remote_path limit 100"""),
    Query("registry_status_counts", g.registry_status_counts, "select status, count(*) as file_count from file_registry group by all"),
    Query("source_intervals", g.source_intervals, """
        select interval_start, count(*) as total_files, string_agg(distinct dataset_family, ',' order by dataset_family) as families_present,
          count(distinct dataset_family) as family_count, string_agg(distinct status, ',' order by status) as statuses_present,
          max(revision) as max_revision, max(last_seen_at) as last_seen_at, max(last_scan_at) as last_scan_at
        from file_registry where interval_start is not null group by interval_start"""),
    Query("ingested_interval_files", g.ingested_interval_files, """
        select distinct interval_start, dataset_family, remote_filename from file_registry
        where status = 'INGESTED' and dataset_family like '%/ltefdd' and interval_start is not null"""),
    Query("latest_scan", g.latest_scan, "select max(last_scan_at) as latest_scan_at from file_registry"),
    Query("source_interval_quality", g.source_interval_quality, """
        select v.interval_start, total_files, families_present, family_count, statuses_present, max_revision, last_seen_at, last_scan_at,
          missing_families, families_present like '%ltefdd%' and missing_families <> '' as partial_interval,
          if(missing_families = '', 'complete', 'partial') as quality_status,
          if(missing_families = '', 'Required LTE PM families discovered for this interval.',
            'Missing expected families: ' || replace(missing_families, ',', ', ')) as quality_notes,
          ifnull(m, 0) as topology_mapped_count, ifnull(u, 0) as topology_unmapped_count,
          round(m * 100.0::double / nullif(m + u, 0), 2) as topology_coverage_pct
        from (select interval_start, count(*) as total_files, string_agg(distinct dataset_family, ',' order by dataset_family) as families_present,
            count(distinct dataset_family)::integer as family_count, string_agg(distinct status, ',' order by status) as statuses_present,
            max(revision) as max_revision, max(last_seen_at) as last_seen_at, max(last_scan_at) as last_scan_at,
            concat_ws(',', if(bool_or(dataset_family = 'PM/itbbu/ltefdd'), null, 'PM/itbbu/ltefdd'),
              if(bool_or(dataset_family = 'PM/sdr/ltefdd'), null, 'PM/sdr/ltefdd')) as missing_families
          from file_registry where interval_start is not null group by interval_start) v
        left join (select interval_start, count(*) filter (mapping_status <> 'UNMAPPED') as m,
            count(*) filter (mapping_status is null or mapping_status = 'UNMAPPED') as u
          from (select distinct interval_start, logical_entity_key from keyed where dataset_family like '%/ltefdd' and source_file in
              (select remote_filename from file_registry where status = 'INGESTED' and dataset_family like '%/ltefdd'))
          left join topo_enrichment using (logical_entity_key) group by all) c on c.interval_start = v.interval_start""",
          "topology_coverage_pct"),
    Query("classify_registry", lambda t: g.classify_registry(t, now=_NOW).select("id", "status", "classification", "classification_reason"),
          f"select id, status, classification, classification_reason from {_CLASSED}"),
    Query("inspect_failures", lambda t: g.inspect_failures(t, now=_NOW), f"""
        select {_ROW}, classification, classification_reason from {_CLASSED} where {_FAILED}"""),
    Query("reconciliation_preview", lambda t: g.reconciliation_preview(t, now=_NOW), f"""
        select {_ROW}, classification, classification_reason from {_CLASSED} where classification = 'reconciliation_needed'"""),
    Query("operational_status", lambda t: g.operational_status(t, now=_NOW), f"""
        select count(*) filter (status = 'DISCOVERED') as pending_downloads, count(*) filter (status = 'DOWNLOADED') as pending_ingests,
          count(*) filter (status = 'FAILED_DOWNLOAD') as failed_downloads, count(*) filter (status = 'FAILED_INGEST') as failed_ingests,
          count(*) filter (status = 'FAILED_DOWNLOAD') as retryable_downloads,
          {', '.join(f"count(*) filter (classification = '{c}') as {n}" for c, n in (
              ('retryable_ingest', 'retryable_ingests'), ('reconciliation_needed', 'reconciliation_needed'),
              ('not_seen_in_latest_scan', 'not_seen_in_latest_scan'), ('repeatedly_failing_download', 'repeatedly_failing_downloads'),
              ('repeatedly_failing_ingest', 'repeatedly_failing_ingests'), ('stale_pending', 'stale_pending_rows')))},
          max(last_scan_at) as latest_scan_at from {_CLASSED}"""),
    Query("apply_transfer_outcomes", lambda t: g.apply_transfer_outcomes(t, _transfers(t)).select(
        "id", "status", "download_attempts", "download_attempt_count", "local_staged_path", "last_error", "last_download_attempt_at",
        "status_updated_at", "updated_at"), f"""
        select id, case when hit and won then 'DOWNLOADED' when hit then 'FAILED_DOWNLOAD' else status end as status,
          (download_attempts + n)::integer as download_attempts, (download_attempt_count + n)::integer as download_attempt_count,
          if(hit and won, '/fresh' || remote_path, local_staged_path) as local_staged_path,
          case when hit and won then null when hit then 'refused ' || id else last_error end as last_error,
          ifnull(moment, last_download_attempt_at) as last_download_attempt_at, ifnull(moment, status_updated_at) as status_updated_at,
          ifnull(moment, updated_at) as updated_at
        from (select *, {_W} as hit, id % 3 = 1 as won, case when not ({_W}) then 0 when id % 3 = 1 then 2 else 1 end as n,
            case when not ({_W}) then null when id % 3 = 1 then cast('2026-03-09 02:00' as timestamp)
              else cast('2026-03-09 01:00' as timestamp) end as moment from file_registry)"""),
    Query("apply_ingest_outcomes", lambda t: g.apply_ingest_outcomes(t, _ingests(t)).select(
        "id", "status", "ingest_attempt_count", "file_hash", "ingest_run_id", "final_file_path", "last_error", "last_ingest_attempt_at",
        "status_updated_at", "updated_at"), f"""
        select id, if(hit, kind, status) as status, (ingest_attempt_count + hit::integer)::integer as ingest_attempt_count,
          if(ok, 'h' || id, file_hash) as file_hash, if(ok, 'r' || id, ingest_run_id) as ingest_run_id,
          if(ok, '/done' || remote_path, final_file_path) as final_file_path,
          case when ok then null when hit then 'broken ' || id else last_error end as last_error,
          if(hit, cast('2026-03-09 03:00' as timestamp), last_ingest_attempt_at) as last_ingest_attempt_at,
          if(hit, cast('2026-03-09 03:00' as timestamp), status_updated_at) as status_updated_at,
          if(hit, cast('2026-03-09 03:00' as timestamp), updated_at) as updated_at
        from (select *, {_I} as hit, {_KIND} as kind, ({_I}) and id % 3 <> 2 as ok from file_registry)"""),
    Query("cycle_summary", lambda t: g.cycle_summary(
        t, candidates=_candidates(t), downloads=_last_downloads(t), ingests=_ingests(t), now=_NOW), f"""
        select (select count(*) from file_registry where id % 5 <> 0) as scanned,
          (select count(*) from file_registry where {_W} and id % 3 = 1) as downloaded,
          count(*) filter (kind = 'INGESTED') as ingested, count(*) filter (kind = 'SKIPPED_DUPLICATE') as skipped_duplicates,
          (select count(*) from file_registry where {_W} and id % 3 <> 1) as failed_downloads,
          count(*) filter (kind = 'FAILED_INGEST') as failed_ingests,
          count(*) filter (kind = 'FAILED_INGEST' and classification = 'reconciliation_needed') as reconciliation_needed
        from (select *, {_KIND} as kind from {_CLASSED} where {_I})"""),
    Query("cycle_plan", lambda t: g.cycle_plan(t, source_name="default", candidates=_candidates(t)),
          f"select {_QUEUE}, status from file_registry where {_W} and id % 5 <> 0"),
    Query("merge_transfer_and_ingest", lambda t: g.merge_transfer_and_ingest(_last_downloads(t), _cycle_ingests(t), _candidates(t)), f"""
        select id, remote_filename as remote_file, if(id % 5 <> 0, dataset_family, null) as dataset_family,
          if(id % 5 <> 0, interval_start, null) as interval_start, if(id % 5 <> 0, revision, null) as revision,
          if(id % 3 = 1, '/fresh' || remote_path, null) as downloaded_to,
          case when id % 3 <> 1 then 'FAILED_DOWNLOAD' when id % 2 = 0 then 'INGESTED' else 'FAILED_INGEST' end as status,
          case when id % 3 <> 1 then 'refused ' || id when id % 4 = 0 then 'late error' end as error
        from file_registry where {_W}"""),
    Query("retry_merge", lambda t: g.retry_merge(
        t.file_registry.select("id", "status", "last_error"),
        t.file_registry.where("status like 'FAILED%' and id % 2 = 0").select(
            "id", F.lit("RETRIED").alias("status"), F.lit(None).cast("string").alias("last_error"))), """
        select id, if(status like 'FAILED%' and id % 2 = 0, 'RETRIED', status) as status,
          if(status like 'FAILED%' and id % 2 = 0, null, last_error) as last_error from file_registry"""),

    # --- audit
    Query("file_ingest_observability", a.file_ingest_observability, f"select * from {_OBSERVED}"),
    Query("lifecycle_exceptions", a.lifecycle_exceptions, f"""
        select * from {_OBSERVED} where lifecycle_status <> 'COMPLETED' or (status, raw_row_count = 0) = ('SUCCESS', true)
          or (status, raw_row_count > 0) = ('FAILED', true) or (status, normalization_status) = ('SUCCESS', 'FAILED')"""),
    Query("recent_audits", lambda t: a.recent_audits(_audits(t), limit=100), f"""
        select {_AUDIT.format(extra="'' as unknown_columns, null_counter_values, ")} from file_audit
        order by processed_at desc, run_id desc limit 100"""),
    Query("recent_for_reconciliation", lambda t: a.recent_for_reconciliation(t, limit=100), """
        select source_file, run_id, status, rows_inserted, lifecycle_status, lifecycle_action, normalization_status, normalized_at,
          normalization_error, final_file_path, error_message from file_audit order by processed_at desc, run_id desc limit 100"""),
    Query("pending_lifecycle", lambda t: a.pending_lifecycle(t), """
        select source_file, run_id, status, lifecycle_status, lifecycle_action, final_file_path, error_message from file_audit
        where lifecycle_status = 'PENDING'"""),
    Query("has_successful_hash", lambda t: a.has_successful_hash(t, t.file_registry.select("file_hash").distinct()), """
        select file_hash, bool_or(ok) as has_success from (
          select file_hash, false as ok from file_registry union all select file_hash, true from file_audit where status = 'SUCCESS') group by all"""),
    Query("reconcile_ingest_files", a.reconcile_ingest_files, """
        select * from (select f.source_file, run_id, status, ifnull(n, 0) as raw_rows, lifecycle_status, lifecycle_action, final_file_path,
            concat_ws(',', if(status = 'SUCCESS' and n is null, 'success_without_raw_rows', null),
              if(status = 'FAILED' and n > 0, 'failed_with_raw_rows', null),
              if(lifecycle_status <> 'COMPLETED', 'lifecycle_' || lower(lifecycle_status), null),
              if(final_file_path is not null and final_file_path not in (select path from storage_listing), 'final_file_missing_on_disk', null),
              if(status <> 'FAILED' and final_file_path is null, 'missing_final_file_path', null)) as issues
          from file_audit f left join (select source_file, count(*) as n from pm_sample group by all) r using (source_file)) where issues <> ''"""),
    Query("backfill_lifecycle", lambda t: a.backfill_lifecycle(t).select("run_id", "lifecycle_status", "final_file_path", "error_message"), """
        select run_id, case when lifecycle_status <> 'PENDING' then lifecycle_status when there then 'COMPLETED' else 'FAILED' end as lifecycle_status,
          final_file_path, if(lifecycle_status = 'PENDING' and not there,
            ifnull(error_message, 'Legacy lifecycle backfill could not confirm final file on disk.'), error_message) as error_message
        from (select *, final_file_path is not null and final_file_path in (select path from storage_listing) as there from file_audit)"""),
    Query("audit_write", lambda t: a.audit_write(t, t.file_registry.where("status = 'DOWNLOADED'").select(
        F.col("remote_filename").alias("source_file"), "file_hash", F.concat(F.lit("new-"), "ingest_run_id").alias("run_id"),
        F.lit("SUCCESS").alias("status"), F.lit("PENDING").alias("lifecycle_status")), processed_at=_SCAN).select(
        "source_file", "file_hash", "run_id", "status", "processed_at", "lifecycle_status", "normalization_status", "trigger_type"), f"""
        select source_file, file_hash, run_id, status, processed_at, lifecycle_status, normalization_status, trigger_type from file_audit
        union all select remote_filename, file_hash, 'new-' || ingest_run_id, 'SUCCESS', {_TS_SCAN}, 'PENDING', 'PENDING', null
        from file_registry where status = 'DOWNLOADED'"""),
    Query("lifecycle_update", lambda t: a.lifecycle_update(t, t.file_registry.where("id % 4 = 2").select(
        F.col("ingest_run_id").alias("run_id"), F.lit("COMPLETED").alias("lifecycle_status"), F.lit(None).cast("string").alias("lifecycle_action"),
        F.concat(F.lit("/moved"), "remote_path").alias("final_file_path"), F.lit(None).cast("string").alias("error_message"))).select(
        "run_id", "lifecycle_status", "lifecycle_action", "final_file_path", "error_message"), """
        select run_id, if(hit, 'COMPLETED', lifecycle_status) as lifecycle_status, if(hit, null, lifecycle_action) as lifecycle_action,
          if(hit, '/moved' || remote_path, a.final_file_path) as final_file_path, if(hit, null, error_message) as error_message
        from (select f.*, r.remote_path, r.id % 4 = 2 as hit from file_audit f join file_registry r on r.ingest_run_id = f.run_id) a"""),
    *[Query(f"mark_normalization{suffix}", lambda t, error=error: a.mark_normalization(t, now=_SCAN, error=error).select(
        "run_id", "status", "normalization_status", "normalized_at", "normalization_error"), f"""
        select run_id, status, if(w, '{label}', normalization_status) as normalization_status,
          {f"if(w, {_TS_SCAN}, normalized_at)" if error is None else "normalized_at"} as normalized_at,
          if(w, {'null' if error is None else f"'{error}'"}, normalization_error) as normalization_error
        from (select *, status = 'SUCCESS' and normalization_status = 'PENDING' as w from file_audit)""")
      for suffix, error, label in (("", None, "COMPLETED"), ("_failed", "sync broke", "FAILED"))],
]
