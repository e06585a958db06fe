"""The ingest cycle on plain folders, entity sync by load and incremental discovery."""

import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from radiokpi.operators import coverage
from radiokpi.operators.entities import sync_entities
from radiokpi.operators.kpi_results import latest_window
from radiokpi.sources import cycle as cy, facts as fa, manifest as mf
from radiokpi.tables import Tables
from tests.test_archives import one_cell

NOW = datetime(2026, 3, 5)
REGISTRY = """id bigint, source_name string, remote_directory string, remote_filename string, remote_path string, dataset_family string,
    interval_start timestamp_ntz, revision int, extension string, remote_size_bytes bigint, remote_modified_at timestamp_ntz, status string,
    first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, last_scan_at timestamp_ntz, status_updated_at timestamp_ntz,
    download_attempts int, download_attempt_count int, ingest_attempt_count int, last_download_attempt_at timestamp_ntz,
    last_ingest_attempt_at timestamp_ntz, local_staged_path string, file_hash string, ingest_run_id string, final_file_path string, last_error string,
    updated_at timestamp_ntz, created_at timestamp_ntz"""
IDENTITY = ("logical_entity_key string, dataset_family string, sbnid string, enbid string, enodebid string, cellid string, meid string, "
            "ani string, entity_level string, notes string")
LISTING = """remote_path string, remote_directory string, remote_filename string, dataset_family string, interval_start timestamp_ntz, revision int,
    extension string, remote_size_bytes long, remote_modified_at timestamp_ntz"""
TRANSFERS = "remote_path string, status string, local_staged_path string, error string, happened_at timestamp_ntz"


@pytest.fixture
def cycle(spark, tmp_path):
    """Runs a cycle over {directory/name: members, or None for a file that cannot be fetched}."""
    root = str(tmp_path / "root")
    cy.write_state(Tables(file_registry=spark.createDataFrame([], REGISTRY), file_audit=spark.createDataFrame([], fa.AUDIT_SCHEMA),
                          entity_identity=spark.createDataFrame([], IDENTITY)), root, "seed")

    def run(files: dict, load_id: str, after: str):
        listing, transfers = [], []
        for path, members in files.items():
            directory, name = path.rsplit("/", 1)
            staged = tmp_path / "stage" / path
            listing.append((f"/r/{path}", f"/r/{directory}", name, "PM/sdr/ltefdd", datetime(2026, 3, 4, 14, 30), 0, "zip", 10, NOW))
            if members is not None:
                staged.parent.mkdir(parents=True, exist_ok=True)
                with zipfile.ZipFile(staged, "w") as z:  # the same members are the same bytes whenever they are written
                    for name, text in members.items():
                        z.writestr(zipfile.ZipInfo(name), text)
            transfers.append((f"/r/{path}", "FAILED_DOWNLOAD" if members is None else "DOWNLOADED", members and str(staged),
                              None if members else "gone", NOW))
        counts = cy.ingest_cycle(spark, root, spark.createDataFrame(listing, LISTING), spark.createDataFrame(transfers, TRANSFERS),
                                 load_id=load_id, after=after, source_name="src", now=NOW).first().asDict()
        return counts, cy.read_state(spark, root, load_id)
    return run


NAME = "UMEID_LTEFDD_PM_COMMON_ZTE_20260304_1430.zip"


def test_a_cycle_from_listing_to_summary(cycle):
    other = NAME.replace("1430", "1445")
    files = {f"a/{NAME}": one_cell("p"), f"b/{NAME}": one_cell("q", "later"), f"a/{other}": one_cell("p"), f"b/{other}": None}
    for _ in range(2):  # as after a crash: the same load again changes nothing
        counts, state = cycle(files, "1", "seed")
        assert counts == {"scanned": 4, "downloaded": 3, "ingested": 1, "skipped_duplicates": 1, "failed_downloads": 1,
                          "failed_ingests": 1, "reconciliation_needed": 0}
        rows = state.file_registry.collect()
        assert len({r.id for r in rows}) == 4
        assert {(r.remote_path, r.status, r.download_attempt_count, r.ingest_attempt_count, r.last_error and r.last_error[:9]) for r in rows} == {
            (f"/r/a/{NAME}", "INGESTED", 1, 1, None), (f"/r/b/{NAME}", "FAILED_INGEST", 1, 1, "time data"),
            (f"/r/a/{other}", "SKIPPED_DUPLICATE", 1, 1, None), (f"/r/b/{other}", "FAILED_DOWNLOAD", 1, 0, "gone")}
        assert {r.status: r.normalization_status for r in state.file_audit.collect()}["SUCCESS"] == "COMPLETED"
        assert [r.ani for r in state.entity_identity.collect()] == ["p"]
    # The next cycle follows it: what failed comes again.
    later = {f"b/{NAME}": one_cell("q"), f"b/{other}": one_cell("p")}
    counts, state = cycle(later, "2", "1")
    assert (counts["ingested"], counts["skipped_duplicates"]) == (1, 1)
    assert {r.remote_path: (r.status, r.download_attempt_count, r.ingest_attempt_count) for r in state.file_registry.collect()} == {
        f"/r/a/{NAME}": ("INGESTED", 1, 1), f"/r/b/{NAME}": ("INGESTED", 2, 2),
        f"/r/a/{other}": ("SKIPPED_DUPLICATE", 1, 1), f"/r/b/{other}": ("SKIPPED_DUPLICATE", 2, 1)}
    assert state.file_audit.count() == 5 and state.entity_identity.count() == 1  # p and q are one entity


def test_a_cycle_cannot_follow_itself(cycle):
    with pytest.raises(ValueError):
        cycle({f"a/{NAME}": one_cell("p")}, "1", "1")


def load(spark, root, load_id, rows):
    facts = spark.createDataFrame([], fa.FACT_SCHEMA).drop("load", "collect_date").unionByName(spark.createDataFrame(rows), allowMissingColumns=True)
    fa.write_facts(facts, f"{root}/facts", load_id=load_id)
    fa.store_activity(Tables(pm_sample=fa.read_load(spark, root, load_id)), root, load_id=load_id)
    audit = spark.createDataFrame([(f"load-{load_id}",)], "run_id string")
    spark.createDataFrame([], fa.AUDIT_SCHEMA).unionByName(audit, allowMissingColumns=True).write.parquet(f"{root}/audit/load={load_id}")


def test_sync_by_load_equals_a_sync_over_all(spark, tmp_path):
    from pyspark.sql import Row

    root = str(tmp_path)
    rows = [Row(**{"source_file": "f", "dataset_family": "PM/sdr/ltefdd", "sbnid": "1", "enodebid": str(n % 3), "cellid": None if n % 5 == 0 else "2",
                   "ani": f"a{(7 * n) % 11}" if n % 4 else None, "counter_id": "C1", "counter_value": 1.0,
                   "collect_time": datetime(2026, 3, 4 + n % 2, 14)}) for n in range(40)]
    identity, after = spark.createDataFrame([], IDENTITY), None
    for k, part in enumerate((rows[:15], rows[15:22], rows[22:])):
        load(spark, root, k, part)
        folder = str(tmp_path / "state" / str(k))
        identity = fa.sync_new_loads(spark, root, identity, after=after, folder=folder)
        after = folder
    whole = sync_entities(Tables(pm_sample=fa.read_facts(spark, f"{root}/facts"), entity_identity=spark.createDataFrame([], IDENTITY)))
    assert sorted(map(str, identity.collect())) == sorted(map(str, whole.collect())) and identity.count() == 6
    # A second sync reads the folders of new loads only.
    shapes = fa.stored(spark, f"{root}/entity_shapes", fa.SHAPES).where(F.col("load").isin(["2"]))
    assert {f.split("load=")[1][0] for f in shapes.select("_metadata.file_path").distinct().toPandas()["file_path"]} == {"2"}
    # Reports over several loads equal reports over the facts.
    tables = Tables(pm_sample=fa.read_facts(spark, f"{root}/facts"), entity_identity=identity)
    stored = tables.updated(**fa.read_activity(spark, root))
    for report in (coverage.family_interval_coverage, coverage.logical_entity_counts_by_time, coverage.daily_family_coverage):
        assert sorted(map(str, report(stored).collect())) == sorted(map(str, report(tables).collect()))


def test_newest_rows_are_read_from_their_days_only(spark, tmp_path):
    from pyspark.sql import Row

    rows = [Row(source_file=f"f{n}", dataset_family="F", collect_time=datetime(2026, 3, 1 + n % 9, n % 24), counter_id=f"C{n}", counter_value=float(n))
            for n in range(90)]
    load(spark, str(tmp_path), 0, rows[:50])
    load(spark, str(tmp_path), 1, rows[50:])
    facts = fa.read_facts(spark, f"{tmp_path}/facts")
    plain = Tables(pm_sample=facts)
    stored = plain.updated(**fa.read_activity(spark, str(tmp_path)))
    newest = coverage.recent_facts(stored, limit=15)
    assert newest.collect() == coverage.recent_facts(plain, limit=15).collect()
    assert coverage.newest_days(stored.counter_activity, 15) == [datetime(2026, 3, 9).date(), datetime(2026, 3, 8).date()]
    scan = newest._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1]
    assert "collect_date" in scan.split("]")[0] and len(newest.inputFiles()) > 0
    window = latest_window(facts, "F", stored.counter_activity)
    assert sorted(window.collect()) == sorted(latest_window(facts, "F").collect()) and window.count() > 0


def test_a_second_scan_finds_new_files_only(spark, tmp_path):
    roots = {"PM/sdr/ltefdd": str(tmp_path / "sdr"), "PM/itbbu/ltefdd": str(tmp_path / "itbbu")}

    def add(family, name):
        (tmp_path / family / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / family / "deep" / name).write_bytes(b"x")

    def scan(run_id):
        return sorted(r.filename for r in mf.discover_new_files(spark, roots, str(tmp_path / "state"), run_id=run_id).collect())

    add("sdr", NAME), add("sdr", "other.zip"), add("itbbu", NAME)  # a name of the other family is not found there
    assert scan("1") == [NAME] == [r.filename for r in mf.discover_files(spark, roots).collect()]
    assert scan("1") == [NAME]  # the same run again keeps what it found
    add("sdr", NAME.replace("1430", "1445")), add("itbbu", NAME.replace("LTEFDD", "ITBBU_LTEFDD"))
    assert scan("2") == sorted([NAME.replace("1430", "1445"), NAME.replace("LTEFDD", "ITBBU_LTEFDD")])
    assert scan("3") == []


def test_facts_by_entity_are_not_moved_for_a_join(spark, tmp_path):
    from pyspark.sql import Row

    from radiokpi.operators.topology import raw_with_entity_topology

    rows = [Row(source_file="f", dataset_family="PM/sdr/ltefdd", sbnid="1", enodebid=str(n % 7), cellid="2", collect_time=NOW, counter_id="C1",
                counter_value=float(n)) for n in range(50)]
    facts = spark.createDataFrame([], fa.FACT_SCHEMA).drop("load", "collect_date").unionByName(spark.createDataFrame(rows), allowMissingColumns=True)
    identity = sync_entities(Tables(pm_sample=facts, entity_identity=spark.createDataFrame([], IDENTITY))).where("enodebid <> '3'")
    places = identity.select("logical_entity_key", "dataset_family", "entity_level", *[F.lit("p").alias(c) for c in (
        "site_code", "site_name", "region_code", "region_name", "reporting_key", "reporting_name", "reporting_level")], F.lit("MAPPED").alias("mapping_status"))
    tables = Tables(pm_sample=facts, entity_identity=identity, topo_enrichment=places)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = raw_with_entity_topology(fa.store_by_entity(tables, str(tmp_path), buckets=3))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(map(str, joined.collect())) == sorted(map(str, raw_with_entity_topology(tables).select(joined.columns).collect()))
        # A filter on the facts goes with them, and an aggregate by entity finds its rows in place as well.
        some = tables.updated(**fa.read_by_entity(spark, str(tmp_path), buckets=3))
        counts = some.pm_sample.groupBy("logical_entity_key", "counter_id").count()
        assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString() and counts.count() == 7
        filtered = some.updated(pm_sample=some.pm_sample.where("counter_value < 5"))
        assert raw_with_entity_topology(filtered).count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_folders_are_listed_by_tasks_level_by_level(spark, tmp_path):
    """No file stream or file index: those list and log every name on the driver."""
    for place in ("a", "a/b", "a/b/c", "d"):
        (tmp_path / "in" / place).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / place / NAME).write_bytes(b"xy")
    (tmp_path / "in" / "d" / NAME.replace("1430", "1445")).write_bytes(b"")  # empty: none
    (tmp_path / "in" / "_temporary").mkdir()
    (tmp_path / "in" / "_temporary" / NAME).write_bytes(b"x")
    found = mf.listed(spark, {"PM/sdr/ltefdd": str(tmp_path / "in")})
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    assert sorted((r.path, r.remote_size_bytes, r.root_family) for r in found.collect()) == sorted(
        (f"{tmp_path}/in/{place}/{NAME}", 2, "PM/sdr/ltefdd") for place in ("a", "a/b", "a/b/c", "d"))
