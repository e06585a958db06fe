"""Archives on disk through the ingest job, in batch and as a stream."""

import io
import tarfile
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from radiokpi.operators.kpi_results import latest_window
from radiokpi.sources import archives as ar, facts as fa
from radiokpi.streaming import jobs

HEAD = "MEID,CollectTime, eNBid ,CellID,c1,SBNID,ANI,ENODEBID,TRNCMEID,C2,Spare,SYSTEMMODE,MIDFLAG,NETYPE,DETECTPORT\n"
ROW = "m7,{t},88,{n},3_000.25,6,west-{n},,t9,,?,TDD,flag,node,80\n"
GOOD = "UMEID_ITBBU_LTEFDD_PM_COMMON_ZTE_20260304_1430.tar.gz"
BAD = "UMEID_LTEFDD_PM_COMMON_ZTE_20260304_1430_R1.zip"


def csv_text(times):
    return "\ufeff" + HEAD + "".join(ROW.format(t=t, n=n) for n, t in enumerate(times))


def write_zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)


def write_tar(path, members):
    with tarfile.open(path, "w:gz") as t:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            t.addfile(info, io.BytesIO(text.encode()))


@pytest.fixture
def folder(tmp_path):
    good = csv_text(["20260304143000", "20260304143000 "])
    write_tar(tmp_path / GOOD, {"a/one.CSV": good, "readme.md": "x", "two.csv": HEAD})
    write_zip(tmp_path / BAD, {"x.csv": csv_text(["20260304143000", "badtime", "20260304143000"]), "y.csv": good})
    (tmp_path / "copy_of.tar.gz").write_bytes((tmp_path / GOOD).read_bytes())
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    return tmp_path


def load(spark, folder):
    return ar.archive_files(spark.read.format("binaryFile").load(str(folder)))


def test_members_and_markers(spark, folder):
    rows = ar.expand_archives(load(spark, folder).where(F.col("source_file") == GOOD)).collect()
    assert [(r.csv_name, r.member_no, r.row_no) for r in rows] == [("a/one.CSV", 1, 0), ("a/one.CSV", 1, 1), ("a/one.CSV", 1, 2), ("two.csv", 2, 0)]
    assert rows[1].collecttime == "20260304143000" and rows[1].enbid == "88" and rows[1].counters == [3000.25, None]
    assert rows[0].names[:4] == ["MEID", "COLLECTTIME", "ENBID", "CELLID"] and {r.layout for r in rows} == {rows[0].layout}


def test_later_equal_header_wins_and_short_rows_are_null(spark, tmp_path):
    write_zip(tmp_path / "h.zip", {"a.csv": "COLLECTTIME,C1, c1 ,C2\n20260304143000,1,2\n\n20260304143000,1,2,3,4\n"})
    head, *rows = ar.expand_archives(load(spark, tmp_path)).orderBy("row_no").collect()
    assert head.names == ["COLLECTTIME", "C1", "C2"]
    assert [(r.collecttime, r.counters) for r in rows] == [("20260304143000", [2.0, None]), ("20260304143000", [2.0, 3.0])]


def test_members_of_one_archive_are_read_by_many_tasks(spark, tmp_path):
    text = "COLLECTTIME,ANI,C1\n20260304143000,a,1\n"
    write_zip(tmp_path / "m.zip", {f"{n:02d}.csv": text for n in range(20)} | {"skip.txt": "x"})
    write_tar(tmp_path / "m.tar.gz", {f"{n:02d}.csv": text for n in range(20)})
    files = load(spark, tmp_path)
    spans = sorted((r.source_file, r.first, r.last) for r in ar.archive_spans(files, 3).collect())
    assert spans == [("m.tar.gz", 1, 0), *[("m.zip", n, min(n + 2, 20)) for n in range(1, 21, 3)]]
    rows = ar.expand_archives(files, 3).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows if r.source_file == "m.zip"}) == 4  # all partitions of the session
    for name in ("m.zip", "m.tar.gz"):
        assert sorted((r.member_no, r.csv_name, r.row_no) for r in rows if r.source_file == name) == [
            (n + 1, f"{n:02d}.csv", k) for n in range(20) for k in (0, 1)]


@pytest.mark.parametrize("write", [write_zip, write_tar])
def test_memory_does_not_grow_with_the_archive(tmp_path, write):
    import tracemalloc

    def peak(members: int) -> int:
        path = tmp_path / f"{members}.bin"
        write(path, {f"{n}.csv": "COLLECTTIME,C1,C2\n" + "20260304143000,1,2\n" * 30_000 for n in range(members)})
        tracemalloc.start()
        rows = ar._Rows()
        sent = sum(batch.num_rows for batch in ar._read_span((str(path), "x"), 1, 0, rows))
        used = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sent + len(rows.head) == members * 30_001
        return used

    small = peak(1)
    assert peak(6) < 1.5 * small


def test_a_broken_archive_fails_where_it_breaks(spark, tmp_path):
    write_zip(tmp_path / "b.zip", {f"{n}.csv": "COLLECTTIME,ANI,C1\n" + f"20260304143000,a{n},1\n" * 50 for n in range(3)})
    data = bytearray((tmp_path / "b.zip").read_bytes())
    at = data.find(b"a1,1")
    data[at] ^= 1  # stored members are protected by a checksum
    (tmp_path / "b.zip").write_bytes(bytes(data))
    parsed = ar.parse_pm_rows(ar.expand_archives(load(spark, tmp_path), 1))
    bad = ar.failed_files(parsed).collect()
    assert [(b.source_file, b.failed_at.member_no) for b in bad] == [("b.zip", 3)] and "CRC" in bad[0].error_message


def test_files_with_different_headers_in_one_load(spark, tmp_path):
    write_zip(tmp_path / "UMEID_LTEFDD_PM_COMMON_ZTE_20260304_1430.zip", {
        "a.csv": "C2,COLLECTTIME,ODD,C1,ANI\n2,20260304143000,x,1,p\n", "b.csv": "ANI,C9,COLLECTTIME\nq,9,20260304143000\n",
        "empty.csv": "COLLECTTIME,STRAY\n", "none.csv": ""})
    parsed = ar.parse_pm_rows(ar.expand_archives(load(spark, tmp_path)))
    cells = ar.unpivot_counters(ar.good_rows(parsed), ar.layouts(parsed))
    assert "map<" not in cells._jdf.queryExecution().analyzed().toString()
    assert sorted((c.ani, c.counter_id, c.counter_value) for c in cells.collect()) == [("p", "C1", 1.0), ("p", "C2", 2.0), ("q", "C9", 9.0)]
    assert [r.unknown_columns for r in ar.unknown_columns(parsed).collect()] == [["ODD"]]  # STRAY has no records


def test_unpivot(spark, folder):
    parsed = ar.parse_pm_rows(ar.expand_archives(load(spark, folder).where(F.col("source_file") == GOOD)))
    cells = ar.unpivot_counters(ar.good_rows(parsed), ar.layouts(parsed)).orderBy("ani", "counter_id").collect()
    assert [(c.ani, c.counter_id, c.counter_value) for c in cells] == [
        ("west-0", "C1", 3000.25), ("west-0", "C2", None), ("west-1", "C1", 3000.25), ("west-1", "C2", None)]
    first = cells[0]
    assert (first.dataset_family, first.interval_start, first.revision) == ("PM/itbbu/ltefdd", datetime(2026, 3, 4, 14, 30), 0)
    assert (first.collect_time, first.enbid, first.enodebid, first.midflag) == (datetime(2026, 3, 4, 14, 30), "88", None, "flag")


def test_missing_time_column_fails_the_file(spark, tmp_path):
    write_zip(tmp_path / "n.zip", {"a.csv": "ANI,C1\nx,1\n"})
    bad = ar.failed_files(ar.parse_pm_rows(ar.expand_archives(load(spark, tmp_path)))).collect()
    assert [(b.source_file, b.error_message) for b in bad] == [("n.zip", "Missing required columns: COLLECTTIME")]


EXPECTED = {
    GOOD: ("SUCCESS", 2, 2, 4, 4, 2, ["SPARE"]),
    "copy_of.tar.gz": ("SKIPPED_DUPLICATE", 0, 0, 0, 0, 0, []),
    BAD: ("FAILED", 1, 2, 2, 0, 1, ["SPARE"]),
    "broken.zip": ("FAILED", 0, 0, 0, 0, 0, []),
}


def audit_rows(spark, root):
    return {r.source_file: (r.status, r.csv_files_found, r.input_rows_read, r.normalized_rows_emitted, r.rows_inserted,
                            r.null_counter_values, r.unknown_columns) for r in fa.read_audit(spark, f"{root}/audit").collect()}


def test_ingest_batch_and_rerun(spark, folder, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("out"))
    for _ in range(2):  # the second run repeats the load after a crash and must change nothing
        fa.ingest_batch(load(spark, folder), root, load_id=0, processed_at=datetime(2026, 3, 5))
        assert audit_rows(spark, root) == EXPECTED
        assert fa.read_facts(spark, f"{root}/facts").count() == 4
    # Another load of the same bytes is a duplicate of the first one; failed files are tried again.
    fa.ingest_batch(load(spark, folder), root, load_id=1, processed_at=datetime(2026, 3, 6))
    second = fa.read_audit(spark, f"{root}/audit").where("run_id = 'load-1'")
    assert {r.source_file: r.status for r in second.collect()} == {
        GOOD: "SKIPPED_DUPLICATE", "copy_of.tar.gz": "SKIPPED_DUPLICATE", BAD: "FAILED", "broken.zip": "FAILED"}
    assert fa.read_facts(spark, f"{root}/facts").count() == 4


def test_copy_of_a_failed_file_has_failed(spark, tmp_path):
    write_zip(tmp_path / "a.zip", {"x.csv": csv_text(["badtime"])})
    (tmp_path / "b.zip").write_bytes((tmp_path / "a.zip").read_bytes())
    files = ar.skip_duplicate_files(load(spark, tmp_path), spark.createDataFrame([], fa.AUDIT_SCHEMA))
    parsed = ar.parse_pm_rows(ar.expand_archives(files.where("duplicate_of is null")))
    got = {r.source_file: (r.status, r.error_message) for r in ar.ingest_summary(files, parsed).collect()}
    error = "time data 'badtime' does not match format '%Y%m%d%H%M%S'"
    assert got == {"a.zip": ("FAILED", error), "b.zip": ("FAILED", error)}


def test_stream_equals_batch(spark, folder, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stream"))
    jobs.stream_ingest(jobs.archive_stream(spark, str(folder)), root, processed_at=datetime(2026, 3, 5)).awaitTermination()
    assert audit_rows(spark, root) == EXPECTED
    # A second cycle sees only what is new.
    write_zip(folder / "UMEID_LTEFDD_PM_COMMON_ZTE_20260304_1445.zip", {"z.csv": csv_text(["20260304144500"])})
    jobs.stream_ingest(jobs.archive_stream(spark, str(folder)), root, processed_at=datetime(2026, 3, 6)).awaitTermination()
    assert {r.status: r.files for r in jobs.loaded_once(spark, root).collect()} == {"SUCCESS": 2, "SKIPPED_DUPLICATE": 1, "FAILED": 2}
    assert fa.read_facts(spark, f"{root}/facts").count() == 6


def test_fact_table_prunes_partitions_and_counters(spark, folder, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("pruned"))
    fa.ingest_batch(load(spark, folder), root, load_id=0, processed_at=datetime(2026, 3, 5))
    narrow = fa.read_facts(spark, f"{root}/facts").where(
        "dataset_family = 'PM/itbbu/ltefdd' and collect_date = date'2026-03-04' and counter_id = 'C1'").select("counter_value")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_family" in plan and "EqualTo(counter_id,C1)" in plan
    assert "ReadSchema: struct<counter_id:string,counter_value:double>" in plan
    assert [r.counter_value for r in narrow.collect()] == [3000.25, 3000.25]
    # The newest time is evaluated first and also bounds the partitions read.
    newest = latest_window(fa.read_facts(spark, f"{root}/facts"), "PM/itbbu/ltefdd")
    plan = newest._jdf.queryExecution().executedPlan().toString()
    partition_filters = [part.split("PushedFilters", 1)[0] for part in plan.split("PartitionFilters: ")[1:]]
    assert any("isnotnull(collect_date#" in filters for filters in partition_filters)
    assert newest.count() == 4


def test_large_group_of_copies_keeps_exactly_one(spark):
    rows = [(f"f{n:04d}", "hot" if n % 3 else f"h{n}", None) for n in range(900)]
    archives = spark.createDataFrame(rows, "source_file string, file_hash string, content binary")
    audit = spark.createDataFrame([("SUCCESS", "h3"), ("FAILED", "h6")], "status string, file_hash string")
    got = {r.source_file: r.duplicate_of for r in ar.skip_duplicate_files(archives, audit).collect()}
    assert len(got) == 900 and got.pop("f0003") == "audit"
    assert got.pop("f0001") is None
    assert {got[f"f{n:04d}"] for n in range(2, 900) if n % 3} == {"f0001"}
    assert {got[f"f{n:04d}"] for n in range(0, 900, 3) if n != 3} == {None}


def one_cell(name, time="20260304143000"):
    return {"a.csv": "COLLECTTIME,ANI,SBNID,C5\n" + f"{time},{name},3,7\n"}


def statuses(spark, root):
    return sorted((r.source_file, r.status, r.rows_inserted) for r in fa.read_audit(spark, f"{root}/audit").collect())


def test_equal_names_in_two_folders(spark, tmp_path):
    name = "UMEID_LTEFDD_PM_COMMON_ZTE_20260304_1430.zip"
    for case, second in (("same bytes", one_cell("p")), ("one bad", one_cell("q", "later"))):
        folder, root = tmp_path / case / "in", str(tmp_path / case / "out")
        for part, members in (("a", one_cell("p")), ("b", second)):
            (folder / part).mkdir(parents=True)
            write_zip(folder / part / name, members)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder))
        fa.ingest_batch(ar.archive_files(files), root, load_id=0, processed_at=datetime(2026, 3, 5))
        other = ("SKIPPED_DUPLICATE", 0) if case == "same bytes" else ("FAILED", 0)
        assert statuses(spark, root) == sorted([(name, "SUCCESS", 1), (name, *other)])
        assert [r.ani for r in fa.read_loaded_facts(spark, root).collect()] == ["p"]


def test_batch_and_stream_loads_share_a_root(spark, tmp_path):
    root, one, two = str(tmp_path / "out"), tmp_path / "one", tmp_path / "two"
    for folder, cell in ((one, "p"), (two, "q")):
        folder.mkdir()
        write_zip(folder / f"UMEID_LTEFDD_PM_COMMON_ZTE_20260304_1430_R{ord(cell)}.zip", one_cell(cell))
    fa.ingest_batch(load(spark, one), root, load_id=0, processed_at=datetime(2026, 3, 5))
    jobs.stream_ingest(jobs.archive_stream(spark, str(two)), root).awaitTermination()
    assert sorted(r.ani for r in fa.read_loaded_facts(spark, root).collect()) == ["p", "q"]
    assert len(statuses(spark, root)) == 2
    counts = {n: f.agg(F.sum("row_count")).first()[0] for n, f in fa.read_activity(spark, root).items()}
    assert counts == {"entity_activity": 2, "counter_activity": 2}


def test_a_load_without_a_good_file_and_one_without_audit(spark, tmp_path):
    root = str(tmp_path / "out")
    assert fa.read_loaded_facts(spark, root).count() == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "n.zip").write_bytes(b"nothing")
    fa.ingest_batch(load(spark, tmp_path / "in"), root, load_id=0, processed_at=datetime(2026, 3, 5))
    assert fa.read_facts(spark, f"{root}/facts").count() == 0
    fact = spark.createDataFrame([("f", datetime(2026, 3, 4), "C1", 1.0)], "source_file string, collect_time timestamp_ntz, counter_id string, counter_value double")
    whole = spark.createDataFrame([], fa.FACT_SCHEMA).drop("load", "collect_date").unionByName(fact, allowMissingColumns=True)
    fa.write_facts(whole, f"{root}/facts", load_id=9)  # broke off before its audit
    assert fa.read_facts(spark, f"{root}/facts").count() == 1 and fa.read_loaded_facts(spark, root).count() == 0


def test_stream_intervals_are_complete(spark, tmp_path):
    schema = "collect_time timestamp_ntz, dataset_family string, counter_id string, counter_value double"
    hours = [[14, 20], [14], [20, 14], [23]]
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in hours:
        rows = [(datetime(2026, 3, 4, h, 5), "F", "C1", float(h)) for h in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.stream_intervals(spark.readStream.schema(schema).parquet(source), root).awaitTermination()
    # What is stored does not follow the batches: there is no folder but the state's.
    import os
    assert os.listdir(root) == ["checkpoint"]
    got = sorted(map(tuple, jobs.interval_totals(spark, root).collect()))
    assert got == sorted(map(tuple, jobs.interval_statistics(spark.read.schema(schema).parquet(source)).collect()))
    assert [(r[0].hour, r[3], r[4]) for r in got] == [(14, 3, 42.0), (20, 2, 40.0), (23, 1, 23.0)]


def test_revisions_replace_across_batches(spark, tmp_path):
    schema = "dataset_family string, interval_start timestamp_ntz, revision int, counter_value double"
    t1, t2 = datetime(2026, 3, 4, 14, 30), datetime(2026, 3, 4, 14, 45)
    batches = [
        [("F", t1, 0, 1.0), ("F", t2, 1, 2.0)],
        [("F", t1, 1, 3.0), ("F", t2, 0, 4.0)],   # restates t1; t2 is older than what is there
        [("F", t1, 1, 5.0), (None, t1, 9, 6.0)],  # more rows of the restatement; a row without family is none
    ]
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.stream_revisions(stream, root).awaitTermination()
    # A batch reads the revisions of its days only: the days are folders.
    plan = jobs.revisions_of(spark, root, [t1.date()])._jdf.queryExecution().executedPlan().toString()
    assert "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    got = sorted((r.interval_start, r.revision, r.counter_value) for r in jobs.latest_revisions(spark, root).collect())
    assert got == [(t1, 1, 3.0), (t1, 1, 5.0), (t2, 1, 2.0)]
