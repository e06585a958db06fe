"""What the registered queries move, store and hold as their tables grow."""

import hashlib
import io
import tarfile
import zipfile

from radiokpi.plans import ingest_queries as iq
from radiokpi.plans.archive_tables import archives
from radiokpi.plans.derived import DerivedTables
from radiokpi.sources import archives as ar

DIRECTORY = "/root/testdata/sf0.001"


def test_fact_stream_arrives_as_wide_records_in_several_batches(spark, tmp_path):
    tables = DerivedTables(spark, DIRECTORY)
    stream = iq._fact_stream(tables, str(tmp_path))
    arrived = spark.read.parquet(f"{tmp_path}/arrived")
    assert stream.isStreaming and stream.columns == tables.pm_sample.columns
    assert arrived.count() == tables.lineitem.count() and len(arrived.inputFiles()) >= iq.BATCHES
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Repartition" not in plan


def test_archives_lie_in_as_many_files_as_tasks_and_are_read_in_place(spark, tmp_path):
    packed = archives(DerivedTables(spark, DIRECTORY), str(tmp_path), copies="copy_")
    files = [p for p in tmp_path.glob("*/*") if p.parent.name in ("in", "more") and not p.name.startswith(".")]
    assert packed.count() > 1000 and len(files) <= 2 * spark.sparkContext.defaultParallelism
    row = packed.where("source_file like 'copy%.zip'").first()
    with ar.opened(row.path) as file:
        content = file.read()
    assert hashlib.sha256(content).hexdigest() == row.file_hash and content[:2] == b"PK"
    assert {r.file_hash for r in ar.archive_files(packed.where(packed.path == row.path)).collect()} == {row.file_hash}


def test_a_large_archive_in_a_container_is_read_as_a_stretch(tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as box:  # stored, so it is as large as its lines
        box.writestr("a.csv", "COLLECTTIME,C1\n" + "20260301000000,1\n" * 100_000)
    content = held.getvalue()
    (tmp_path / "c").write_bytes(b"before" + content + b"behind")
    path = f"{tmp_path}/c#6+{len(content)}/a.zip"
    assert len(content) > 1 << 20 and not isinstance(ar.opened(path), io.BytesIO)
    rows = ar._Rows()
    sent = sum(batch.num_rows for batch in ar._read_span((path, "a.zip"), 1, 0, rows)) + len(rows.head)
    assert sent == 100_001
    assert ar._spans(path, 1) == [(1, 1)] == ar._spans(path, 5)


def test_a_torn_gzip_archive_keeps_the_records_before_the_tear(tmp_path):
    lines = "COLLECTTIME,C1\n" + "".join(f"20260301000000,{n * 7919 % 10007}\n" for n in range(20_000))
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:gz") as box:
        entry = tarfile.TarInfo("a.csv")
        entry.size = len(lines)
        box.addfile(entry, io.BytesIO(lines.encode()))
    (tmp_path / "t.tar.gz").write_bytes(packed.getvalue()[:-4000])
    rows = ar._Rows()
    for _ in ar._read_span((f"{tmp_path}/t.tar.gz", "t"), 1, 0, rows):
        pass
    assert rows.head[-1][-1] and len(rows.head) > 100


def test_buckets_follow_the_records():
    assert iq._buckets(6_000) == 8
    assert all(records / iq._buckets(records) <= iq.RECORDS_PER_BUCKET for records in (3_600_000, 36_000_000, 216_000_000))


def test_small_archives_in_their_plainest_form_are_read_at_once_and_others_as_before(monkeypatch, tmp_path):
    from radiokpi.plans import archive_tables

    def packed(kind, members, **options):
        held = io.BytesIO()
        if kind == "zip":
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as box:
                for name, text in members.items():
                    box.writestr(zipfile.ZipInfo(name), text, **options)
        else:
            with tarfile.open(fileobj=held, mode="w:gz", **options) as box:
                for name, text in members.items():
                    entry = tarfile.TarInfo(name)
                    entry.size = len(text.encode())
                    box.addfile(entry, io.BytesIO(text.encode()))
        return held.getvalue()

    text = "﻿COLLECTTIME,ANI,C1,C2,c1\n20260301000000,a,1,x,\n\n20260301000000,\"b\nc\",1_0,2\nshort\n20260301000000,d,1,2,3,4,5\r\n"
    members = {"d/a.csv": text, "B.CSV": "COLLECTTIME,C1\n", "n.txt": "x", "e.csv": "", "f.csv": "ANI\nq\n"}
    plain = [packed("zip", members), packed("zip", members, compress_type=zipfile.ZIP_DEFLATED), packed("tar", members, format=tarfile.USTAR_FORMAT),
             *(archive_tables._pack(name, ["l,m", "n"]) for name in ("a.zip", "a.tar.gz"))]
    long = {"long" * 30 + ".csv": text}
    odd = [plain[0][:-30], plain[0] + b"more", plain[2][:-9], plain[2] + plain[2], packed("tar", long), packed("zip", {"é.csv": text}),
           plain[0].replace(b"20260301", b"20260302"), b"", b"PK", b"nothing", packed("tar", {"t.csv": text}, format=tarfile.GNU_FORMAT)]
    for content in [*plain, *odd]:
        (tmp_path / "c").write_bytes(b"before" + content)
        path = f"{tmp_path}/c#6+{len(content)}/a"
        seen = []
        for quick in (True, False):
            with monkeypatch.context() as patch:
                if not quick:
                    patch.setattr(ar, "_few_members", lambda data: None)
                rows = ar._Rows()
                sent = list(ar._read_span((path, "a"), 1, 0, rows)) + ([rows.take()] if len(rows) else [])
                seen.append(sorted(map(str, [r for batch in sent for r in batch.to_pylist()])))
        assert seen[0] == seen[1] != []
    assert all(ar._few_members(content) for content in plain)
    assert not any(ar._few_members(content) for content in odd[:-1])


def test_archives_are_deflated_and_a_copy_is_one_more_name(spark, tmp_path):
    packed = archives(DerivedTables(spark, DIRECTORY), str(tmp_path), copies="copy_")
    copy = packed.where("source_file like 'copy%.zip'").first()
    with ar.opened(copy.path) as file, zipfile.ZipFile(file) as box:
        assert box.testzip() is None
        assert [(e.filename, e.compress_type) for e in box.infolist()][1] == ("data/PM_B.CSV", zipfile.ZIP_DEFLATED)
    original = packed.where(packed.source_file == copy.source_file.removeprefix("copy_")).first()
    assert original.path.rsplit("/", 1)[0] == copy.path.rsplit("/", 1)[0] and original.file_hash == copy.file_hash


def test_a_load_moves_records_and_keeps_nothing_staged(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from pyspark.sql import functions as F

    from radiokpi.sources import facts as fa

    packed = archives(DerivedTables(spark, DIRECTORY), f"{tmp_path}/a").where("source_file like '%_0_15_R%' or source_file like '%00_R%'")
    wanted = ar.parse_pm_rows(ar.expand_archives(packed))
    wanted = ar.unpivot_counters(ar.good_rows(wanted).drop("dataset_family", "interval_start", "revision"), ar.layouts(wanted))
    monkeypatch.setattr(fa, "FACTS_PER_FILE", 500)
    fa.ingest_batch(packed, f"{tmp_path}/out", load_id=0, processed_at=datetime(2026, 3, 5))
    loaded = fa.read_facts(spark, f"{tmp_path}/out/facts")
    assert sorted(map(str, loaded.select(wanted.columns).collect())) == sorted(map(str, wanted.collect())) != []
    assert len(loaded.inputFiles()) > 4 and loaded.where(F.to_date("collect_time") != F.col("collect_date")).isEmpty()
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out/staging").isEmpty()
