"""Column helpers against literal values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from radiokpi.functions import blank_to_null, counter_number, entity_level, logical_entity_key, page, safe_ratio, stamp
from radiokpi.functions.columns import percent_of
from radiokpi.functions.ordering import first_per

DIMS = "dataset_family string, sbnid string, enbid string, enodebid string, cellid string, meid string, ani string"


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_counter_text(spark):
    texts = ["12.5", " 7 ", "", "  ", None, "noop", "1e3", "+.5", "-2.", "1d", "1f", "1_000", "1__0", "_1", "0x10", "inf", "\t3\n"]
    values = one(spark, [(t,) for t in texts], "v string", counter_number("v"))
    assert values == [12.5, 7.0, None, None, None, None, 1000.0, 0.5, -2.0, None, None, 1000.0, None, None, None, float("inf"), 3.0]


def test_blank_to_null_strips_every_whitespace(spark):
    assert one(spark, [(" a\t",), (" b\n",), ("  ",), (None,)], "v string", blank_to_null("v")) == ["a", "b", None, None]


def test_stamp(spark):
    texts = ["20260304143000", "202603041430", "20261304143000", "2026-03-04", "badtime", None, "20260230000000"]
    assert one(spark, [(t,) for t in texts], "v string", stamp("v")) == [
        datetime(2026, 3, 4, 14, 30), datetime(2026, 3, 4, 14, 30), None, None, None, None, None]


def test_stamp_is_the_same_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # 02:30 does not exist on that day in New York
        assert one(spark, [("20260308023000",)], "v string", stamp("v")) == [datetime(2026, 3, 8, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("row, key, level", [
    (("PM/itbbu/ltefdd", "41", "1010", None, "3", "9", "A"), "family=PM/itbbu/ltefdd|sbnid=41|enbid=1010|cellid=3", "cell"),
    (("PM/sdr/ltefdd", "41", None, "77", None, None, None), "family=PM/sdr/ltefdd|sbnid=41|enodebid=77|cellid=", "cell"),
    (("PM/itbbu/itbbuplat", "4", None, None, "1", "8", None), "family=PM/itbbu/itbbuplat|sbnid=4|meid=8", "meid"),
    ((None, "1", "2", "3", "4", "5", "6"), "family=UNKNOWN|sbnid=1|enbid=2|enodebid=3|cellid=4|meid=5|ani=6", "raw"),
    (("X", None, None, None, None, None, None), "family=X|sbnid=|enbid=|enodebid=|cellid=|meid=|ani=", "raw"),
])
def test_entity_key(spark, row, key, level):
    got = spark.createDataFrame([row], DIMS).select(logical_entity_key(), entity_level()).first()
    assert tuple(got) == (key, level)


def test_safe_ratio(spark):
    rows = [(5.0, 10.0), (5.0, 0.0), (None, 10.0), (5.0, None)]
    assert one(spark, rows, "n double, d double", safe_ratio("n", "d", 100)) == [50.0, None, None, None]


def test_percent_of_rounds_half_up_and_guards_zero(spark):
    assert [str(v) for v in one(spark, [(1,), (2,)], "n bigint", percent_of("n", 800))] == ["0.13", "0.25"]
    assert one(spark, [(1,)], "n bigint", percent_of("n", 0)) == [None]


def test_page_places_nulls_explicitly(spark):
    frame = spark.createDataFrame([(1,), (None,), (2,)], "v int")
    assert [r.v for r in page(frame, "v", limit=3).collect()] == [1, 2, None]
    assert [r.v for r in page(frame, "-v", limit=3).collect()] == [None, 2, 1]
    assert [r.v for r in page(frame, "v", limit=1, offset=1).collect()] == [2]


def test_first_per_matches_brute_force(spark):
    rows = [(k, (k * 7 + i * 5) % 11, f"{k}-{i}") for k in range(4) for i in range(9)]
    frame = spark.createDataFrame(rows, "k int, o int, v string")
    want = {k: max((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))[2] for k in range(4)}
    got = {r.k: r.v for r in first_per(frame, ["k"], largest=[F.col("o"), F.col("v")]).collect()}
    assert got == want
