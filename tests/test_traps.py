"""Hand-made tables for the semantics that are easy to get wrong."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from radiokpi.operators import audit, coverage, entities, kpi_definitions, kpi_ratio, kpi_results, kpi_semantic, registry, snapshots
from radiokpi.schemas import ITBBU_CELL, SDR_CELL
from radiokpi.sources.facts import AUDIT_SCHEMA, store_activity
from radiokpi.tables import Tables

FACTS = ("source_file string, dataset_family string, interval_start timestamp_ntz, revision int, csv_name string, collect_time timestamp_ntz, "
         "ani string, sbnid string, enbid string, enodebid string, cellid string, meid string, counter_id string, counter_value double")
T1, T2 = datetime(2026, 3, 4, 14, 30), datetime(2026, 3, 4, 14, 45)
KEY = "family=PM/sdr/ltefdd|sbnid=1|enodebid=7|cellid="


def fact(counter, value, *, cell="1", time=T1, family=SDR_CELL, ani="A", file="f", revision=0):
    return (file, family, time, revision, "c", time, ani, "1", None, "7", cell, None, counter, value)


def tables(spark, facts, **more):
    made = {
        "pm_sample": spark.createDataFrame(facts, FACTS),
        "entity_identity": spark.createDataFrame(
            [(f"{KEY}1", SDR_CELL, "1", None, "7", "1", None, "A", "cell", None)],
            "logical_entity_key string, dataset_family string, sbnid string, enbid string, enodebid string, cellid string, meid string, "
            "ani string, entity_level string, notes string"),
        "topo_enrichment": spark.createDataFrame(
            [(f"{KEY}{c}", SDR_CELL, "cell", "S1", "Site", "R1", "Region", None, None, None, "MAPPED") for c in "12"],
            "logical_entity_key string, dataset_family string, entity_level string, site_code string, site_name string, region_code string, "
            "region_name string, reporting_key string, reporting_name string, reporting_level string, mapping_status string"),
        "counter_dictionary": spark.createDataFrame(
            [(SDR_CELL, "C1", "dl_prb_used", "n", "Number", "SUM", "VERIFIED", None),
             (SDR_CELL, "C2", "dl_prb_available", "n", "Number", "SUM", "VERIFIED", None)],
            "dataset_family string, counter_id string, counter_alias string, counter_name string, unit string, aggregation_behavior string, "
            "verification_status string, source_note string"),
        "kpi_formula": spark.createDataFrame(
            [("dl_prb_utilization", "DL", "x", "g", "percent", "VERIFIED", False, None)],
            "kpi_code string, kpi_name string, formula_expression string, grain string, unit string, verification_status string, "
            "topology_rollup_allowed boolean, notes string"),
        "kpi_formula_input": spark.createDataFrame(
            [("dl_prb_utilization", "numerator", SDR_CELL, "dl_prb_used", True, None),
             ("dl_prb_utilization", "denominator", SDR_CELL, "dl_prb_available", True, None)],
            "kpi_code string, input_alias string, dataset_family string, counter_alias string, required boolean, notes string"),
    }
    return Tables(made | more)


def test_place_value_is_the_mean_of_ratios(spark):
    t = tables(spark, [fact("C1", 10.0), fact("C2", 10.0), fact("C1", 10.0, cell="2"), fact("C2", 100.0, cell="2")])
    rolled = kpi_results.kpi_results_rollup(t, family="prb", grain="site-time", dataset_family=SDR_CELL).collect()
    assert [(r.site_code, r.dl_prb_utilization, r.ul_prb_utilization) for r in rolled] == [("S1", 55.0, None)]


def test_denominator_only_rows_stay_in_results_but_not_in_verified(spark):
    t = tables(spark, [fact("C2", 10.0), fact("C1", 1.0, cell="2")])
    rows = kpi_results.kpi_results_entity(t, family="prb", dataset_family=SDR_CELL).collect()
    assert [(r.logical_entity_key, r.dl_prb_utilization, r.site_code) for r in rows] == [(f"{KEY}1", None, "S1")]
    assert kpi_semantic.verified_entity_time(t, family="prb").count() == 0


def test_execution_check_reads_the_facts_once(spark, tmp_path):
    rows = [fact("C1", 1.0), fact("C2", 2.0), fact("C1", 1.0, cell="2"), fact("C2", 5.0, time=T2), fact("C1", 3.0, time=T2), fact("C9", 1.0)]
    t = tables(spark, rows)
    t.pm_sample.write.parquet(str(tmp_path / "facts"))
    t = t.updated(pm_sample=spark.read.parquet(str(tmp_path / "facts")))
    checked = kpi_semantic.execution_validation(t, family="prb")
    assert checked._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert [tuple(r) for r in checked.collect()] == [("dl_prb_utilization", SDR_CELL, 2, "VERIFIED", 2, 1, 2, 2, 1)]
    # An input whose counter is not usable is covered but executes nothing; one without a counter counts nothing.
    odd = t.counter_dictionary.withColumn("unit", F.when(F.col("counter_id") == "C2", "number").otherwise(F.col("unit")))
    assert [tuple(r)[4:] for r in kpi_semantic.execution_validation(t.updated(counter_dictionary=odd), family="prb").collect()] == [(2, 1, 0, 0, 0)]
    few = t.counter_dictionary.where("counter_id = 'C1'")
    assert [tuple(r)[2:] for r in kpi_semantic.execution_validation(t.updated(counter_dictionary=few), family="prb").collect()] == [
        (2, "VERIFIED", 0, 0, 0, 0, 0)]


def test_unit_is_case_sensitive_in_verified_only(spark):
    t = tables(spark, [fact("C1", 1.0), fact("C2", 4.0)])
    from pyspark.sql import functions as F
    t = t.updated(counter_dictionary=t.counter_dictionary.withColumn("unit", F.lit("number")))
    assert kpi_semantic.verified_entity_time(t, family="prb").count() == 0
    assert [r.dl_prb_utilization for r in kpi_results.kpi_results_entity(t, family="prb", dataset_family=SDR_CELL).collect()] == [25.0]


def test_zero_denominator_is_null(spark):
    t = tables(spark, [fact("C1", 1.0), fact("C2", 0.0)])
    assert [r.kpi_value for r in kpi_semantic.verified_entity_time(t, family="prb").collect()] == [None]


def test_place_needs_identity_in_verified_but_not_in_rollup(spark):
    t = tables(spark, [fact("C1", 1.0, cell="2"), fact("C2", 4.0, cell="2")])  # cell 2 is not in the identity table
    assert kpi_semantic.verified_place_time(t, family="prb", place="site").count() == 0
    assert kpi_results.kpi_results_rollup(t, family="prb", grain="site-time", dataset_family=SDR_CELL).count() == 1


def test_latest_window_and_missing_family(spark):
    t = tables(spark, [fact("C1", 1.0), fact("C2", 2.0), fact("C1", 3.0, time=T2), fact("C2", 4.0, time=T2)])
    rows = kpi_results.kpi_results(t, family="prb", grain="entity-time", dataset_family=SDR_CELL).collect()
    assert [(r.collect_time, r.dl_prb_utilization) for r in rows] == [(T2, 75.0)]
    assert kpi_results.kpi_results(t, family="prb", grain="entity-time", dataset_family=ITBBU_CELL).count() == 0
    with pytest.raises(ValueError, match="dataset_family is required"):
        kpi_results.kpi_results(t, family="prb", grain="site-time")
    with pytest.raises(ValueError, match="unsupported KPI family"):
        kpi_results.kpi_results(t, family="x", grain="site-time")


def test_kpi_without_inputs_is_provisional(spark):
    t = tables(spark, [])
    t = t.updated(kpi_formula_input=t.kpi_formula_input.limit(0))
    rows = kpi_definitions.provisional_kpis(t).collect()
    assert [(r.kpi_code, r.input_count, r.unverified_counter_aliases) for r in rows] == [("dl_prb_utilization", 0, [])]


def test_shapes_count_apart_but_sync_keeps_one_row_per_key(spark):
    t = tables(spark, [fact("C1", 1.0, ani="B"), fact("C1", 1.0, ani=None), fact("C1", 1.0, ani="A"), fact("C1", 1.0, family=None)])
    summary = {r.dataset_family: r.distinct_logical_entity_keys for r in entities.entity_summary_by_family(t).collect()}
    assert summary == {SDR_CELL: 3, None: 1}
    assert [(r.logical_entity_key, r.ani) for r in entities.sync_entities(t).collect()] == [(f"{KEY}1", "A")]


def test_null_family_and_unknown(spark):
    t = tables(spark, [fact("C1", 1.0, family=None), fact("C1", 1.0, family="UNKNOWN")])
    assert [r.row_count for r in coverage.dataset_family_summary(t).collect()] == [1, 1]
    assert [r.row_count for r in coverage.entity_field_summary(t).collect()] == [2]
    assert [r.distinct_cell_keys for r in coverage.distinct_cells(t).collect()] == [1]
    gaps = coverage.counter_mapping_gaps(t).collect()
    assert sorted((r.dataset_family or "", r.row_count) for r in gaps) == [("", 1), ("UNKNOWN", 1)]


def test_stored_activity_gives_the_same_report(spark, tmp_path):
    t = tables(spark, [fact("C1", 1.0), fact("C2", None), fact("C1", 2.0, cell="2", file="g", revision=1), fact("C1", 2.0, family=None)])
    stored = store_activity(t, str(tmp_path))
    assert sorted(map(str, coverage.family_interval_coverage(t).collect())) == sorted(
        map(str, coverage.family_interval_coverage(stored).collect()))


def test_ratio_of_a_null_ani(spark):
    t = tables(spark, [fact("C1", 2.0, ani=None), fact("C2", 8.0, ani=None), fact("C1", 1.0, ani="B")],
               kpi_definition=spark.createDataFrame(
                   [("k", "LTE", "d", "ratio", None, "n", "u", "g", "ACTIVE")],
                   "kpi_name string, technology string, description string, formula_type string, scale_factor double, formula_notes string, "
                   "unit string, aggregation_grain_notes string, status string"),
               kpi_counter_mapping=spark.createDataFrame(
                   [("k", "numerator", "C1", 2.0), ("k", "denominator", "C2", 1.0)], "kpi_name string, counter_role string, counter_id string, weight double"),
               counter_reference=spark.createDataFrame([("C1", "VERIFIED"), ("C2", "VERIFIED")], "counter_id string, verification_status string"),
               ani_entity=spark.createDataFrame([], "ani string, logical_entity_key string, site_code string, region_name string"))
    rows = kpi_ratio.kpi_ratio_values_by_time_ani(t).collect()
    assert [(r.ani, r.numerator_value, r.kpi_value) for r in rows] == [(None, 4.0, 0.5)]  # B has no denominator row


REGISTRY = "id bigint, status string, download_attempt_count int, ingest_attempt_count int, local_staged_path string, status_updated_at timestamp_ntz, last_seen_at timestamp_ntz, last_scan_at timestamp_ntz"


@pytest.mark.parametrize("row, label, reason", [
    (("FAILED_DOWNLOAD", 3, 0, None, T1, T2), "repeatedly_failing_download", "download has failed at least three times"),
    (("FAILED_DOWNLOAD", 2, 0, None, T1, T2), "retryable_download", "download failed and can be retried from the registry"),
    (("FAILED_INGEST", 0, 3, "/there", T1, T2), "repeatedly_failing_ingest", "ingest has failed at least three times"),
    (("FAILED_INGEST", 0, 3, "/gone", T1, T2), "reconciliation_needed", "staged file not found: /gone"),
    (("FAILED_INGEST", 0, 1, "/there", T1, T2), "retryable_ingest", "staged file exists and ingest can be retried"),
    (("DOWNLOADED", 1, 0, None, T1, T2), "reconciliation_needed", "local_staged_path is missing"),
    (("DOWNLOADED", 1, 0, "/there", T1, T1), "not_seen_in_latest_scan", "row was discovered previously but not seen in the latest scan"),
    (("DOWNLOADED", 1, 0, "/there", T1, T2), "pending_ingest", "downloaded and staged for ingest"),
    (("DISCOVERED", 0, 0, None, datetime(2026, 3, 1), T1), "stale_pending", "discovered row has been pending longer than the stale threshold"),
    (("DISCOVERED", 0, 0, None, None, T2), "pending_download", "remote file discovered but not yet downloaded"),
    (("INGESTED", 1, 1, None, T1, T2), "completed", "ingest completed successfully"),
    (("ODD", 1, 1, None, T1, T2), "unknown", "unrecognized status: ODD"),
])
def test_classification(spark, row, label, reason):
    status, downloads, ingests, path, updated, seen = row
    t = Tables(
        file_registry=spark.createDataFrame([(1, status, downloads, ingests, path, updated, seen, T2)], REGISTRY),
        storage_listing=spark.createDataFrame([("/there",)], "path string"))
    got = registry.classify_registry(t, now=datetime(2026, 3, 4, 15)).first()
    assert (got.classification, got.classification_reason) == (label, reason)


ROWS = "snapshot_id bigint, source_row_number int, logical_entity_key string, dataset_family string, site_code string, region_code string"
HEADER = "snapshot_id bigint, source_file_name string, topology_release_date date, uploaded_at timestamp_ntz, status string, is_active_snapshot boolean, parser_error_count int, parser_warning_count int, workbook_row_count int, normalized_row_count int"


def snapshot_tables(spark, rows, errors=0):
    counts = ", ".join(f"{c} bigint" for c in ("blocking_error_count", "warning_count"))
    return Tables(
        snapshot_rows=spark.createDataFrame(rows, ROWS),
        snapshots=spark.createDataFrame(
            [(i, "f", None, T1, "previewed", i == 1, errors, 2, 0, 0) for i in (1, 2)], HEADER),
        reconciliation_results=spark.createDataFrame([], f"snapshot_id bigint, reconciliation_id bigint, run_at timestamp_ntz, {counts}"),
        entity_identity=spark.createDataFrame([("A", "F")], "logical_entity_key string, dataset_family string"))


def test_removed_is_the_active_minus_the_candidate(spark):
    t = snapshot_tables(spark, [(1, 1, "A", "F", "S", "R"), (1, 2, "B", "F", "S", "R"), (2, 1, "A", "F", "S", "R"), (2, 2, "C", "F", "T", "R")])
    assert [r.logical_entity_key for r in snapshots.entity_removed(t, snapshot_id=2, active_id=1).collect()] == ["B"]
    assert [r.detail_json for r in snapshots.entity_added(t, snapshot_id=2, active_id=1).collect()] == ['{"candidate_site_code":"T"}']


def test_null_site_is_kept_in_issue_details(spark):
    t = snapshot_tables(spark, [(2, 1, "A", "F", "S", "R"), (2, 2, "A", "F", "T", "R"), (2, 3, "A", "F", None, None)])
    assert [r.detail_json for r in snapshots.duplicate_entity_sites(t, snapshot_id=2).collect()] == ['{"site_codes":["S","T",null]}']
    silent = snapshots.workbook_site_no_pm(t, snapshot_id=2).collect()
    assert [r.detail_json for r in silent] == ['{"site_code":null}']  # an unnamed site never matches one that is active


def test_parser_errors_block_even_without_issues(spark):
    t = snapshot_tables(spark, [(2, 1, "A", "F", "S", "R")], errors=3)
    row = snapshots.reconciliation_summary(t, snapshot_id=2, active_id=None).first()
    assert (row.blocking_error_count, row.warning_count) == (3, 2)
    with pytest.raises(ValueError, match="parser errors"):
        snapshots.apply_snapshot(t, snapshot_id=2, activated_at=T1)
    with pytest.raises(ValueError, match="snapshot not found"):
        snapshots.apply_snapshot(t, snapshot_id=9, activated_at=T1)


def test_same_file_name_inherits_rows(spark):
    t = tables(spark, [fact("C1", 1.0, file="dup")], file_audit=spark.createDataFrame(
        [("dup", "h1", "r1", "SUCCESS"), ("dup", "h2", "r2", "FAILED")],
        "source_file string, file_hash string, run_id string, status string").unionByName(
        spark.createDataFrame([], AUDIT_SCHEMA), allowMissingColumns=True))
    rows = {r.run_id: r.raw_row_count for r in audit.file_ingest_observability(t).collect()}
    assert rows == {"r1": 1, "r2": 1}
    assert [r.run_id for r in audit.lifecycle_exceptions(t).collect()] == ["r2"]
