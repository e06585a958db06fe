"""Seed files read from disk and their rejects."""

from datetime import datetime

from radiokpi.sources import seeds, topology_sheet as sheet


def write(tmp_path, text):
    path = tmp_path / "seed.csv"
    path.write_text(text, encoding="utf-8-sig")
    return str(path)


def test_counter_dictionary(spark, tmp_path):
    path = write(tmp_path, "dataset_family,counter_id,counter_alias,counter_name,unit,aggregation_behavior,verification_status,source_note,group_code,group_name,group_notes\n"
                 "PM/itbbu/ltefdd, C77 ,handover_tries,\"Handovers, tried\",times,max,VERIFIED,page 9,HO,Handover,moves\n"
                 "PM/sdr/ltefdd,C2,,x,,sum,,,,,\nPM/sdr/ltefdd,C3,a,x,,sum,MAYBE,,,,\n")
    rows = seeds.load_counter_dictionary(seeds.read_seed(spark, path)).orderBy("line_no").collect()
    assert (rows[0].counter_id, rows[0].counter_name, rows[0].reject_reason) == ("C77", "Handovers, tried", None)
    assert [r.reject_reason for r in rows[1:]] == ["Missing required field: counter_alias", "Invalid verification_status: MAYBE"]
    assert rows[1].verification_status == "UNKNOWN"


def test_counter_reference_default_date(spark, tmp_path):
    path = write(tmp_path, "counter_id,vendor,technology,verification_status,verified_at\nC1,ZTE,LTE,VERIFIED,\nC2,ZTE,LTE,,2026-01-02\nC3,ZTE,,,\n")
    rows = seeds.load_counter_reference(seeds.read_seed(spark, path), now=datetime(2026, 3, 1)).orderBy("counter_id").collect()
    assert [r.verified_at for r in rows] == [datetime(2026, 3, 1), datetime(2026, 1, 2), None]
    assert [r.reject_reason for r in rows] == [None, None, "Missing required field: technology"]


def test_vendor_indicators(spark, tmp_path):
    path = write(tmp_path, "vendor_indicator_code,vendor_indicator_name,proposed_counter_alias,aggregation_method,unit,counter_lineage_expression\n"
                 "QX1,Pings,ping_total,MAX,times,C11|C12\nQX2,Pongs,pong_total,SUM,times, C13 \n")
    rows = seeds.load_vendor_indicators(seeds.read_seed(spark, path), file_name="v.csv").orderBy("indicator_code").collect()
    assert [(r.lineage_type, r.raw_counter_dependencies, r.source, r.verification_status) for r in rows] == [
        ("composed", "C11|C12", "v.csv", "VERIFIED"), ("direct", "C13", "v.csv", "VERIFIED")]


def test_topology_seed(spark, tmp_path):
    path = write(tmp_path, "reporting_key,reporting_name,reporting_level,parent_reporting_key,notes\nR1,Region 1,region,,\nR2,,x,R1,\n")
    rows = seeds.load_topology(seeds.read_seed(spark, path), kind="reporting")
    assert [r.reporting_key for r in seeds.accepted(rows).collect()] == ["R1"]
    assert [r.reject_reason for r in seeds.rejected(rows).collect()] == ["Missing required field: reporting_name"]


SHEET = "source_row_number int, SubnetID double, eNodeBid string, ENODEBName string, CellID double, CELLNAME string, SiteName string, Region string, Area string, ClusterID string, TEAM double"


def test_topology_sheet(spark):
    frame = spark.createDataFrame([(2, 8.0, "907", "mast-a", 5.0, "mast-a/5", "hilltop", "north", "coast", "blue", 3.0),
                                   (3, 8.0, " ", "N", 1.5, "C", "S", None, None, None, None)], SHEET)
    rows = sheet.topology_snapshot_rows(frame).orderBy("dataset_family").collect()
    assert [r.logical_entity_key for r in rows] == [
        "family=PM/itbbu/ltefdd|sbnid=8|enbid=907|cellid=5", "family=PM/sdr/ltefdd|sbnid=8|enodebid=907|cellid=5"]
    assert (rows[0].site_code, rows[0].region_code, rows[0].reporting_key, rows[0].reporting_level, rows[0].team_code) == (
        "hilltop", "north", "CLUSTER::blue", "cluster", "3")
    assert [r.message for r in sheet.topology_sheet_problems(frame).collect()] == ["row 3: missing critical field: eNodeBid"]
