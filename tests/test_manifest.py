"""Archive names, windows and revision rules."""

from datetime import date, datetime

import pytest

from radiokpi.schemas import ITBBU_CELL, ITBBU_PLATFORM, SDR_CELL
from radiokpi.sources import manifest as m


def parsed(spark, *paths):
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path: r for r in m.archive_manifest(frame).collect()}


def test_names(spark):
    got = parsed(
        spark, "UMEID_ITBBU_LTEFDD_PM_COMMON_ZTE_20250717_0915_R3.tar.gz", "/x/UMEID_LTEFDD_PM_COMMON_ZTE_20260305_1345.zip",
        "umeid_itbbu_itbbuplat_pm_common_zte_20260305_0000_r12.TAR.GZ", "UMEID_PM_COMMON_ZTE_20260305_1330.zip",
        "UMEID_LTEFDD_PM_COMMON_ZTE_99999999_0000.zip", "UMEID_LTEFDD_PM_COMMON_ZTE_20260305_1345.zip.bak", "notes.txt", "a|b|c|d")
    assert {p: (r.dataset_family, r.interval_start, r.revision, r.extension, r.filename) for p, r in got.items()} == {
        "UMEID_ITBBU_LTEFDD_PM_COMMON_ZTE_20250717_0915_R3.tar.gz": (
            ITBBU_CELL, datetime(2025, 7, 17, 9, 15), 3, "tar.gz", "UMEID_ITBBU_LTEFDD_PM_COMMON_ZTE_20250717_0915_R3.tar.gz"),
        "/x/UMEID_LTEFDD_PM_COMMON_ZTE_20260305_1345.zip": (
            SDR_CELL, datetime(2026, 3, 5, 13, 45), 0, "zip", "UMEID_LTEFDD_PM_COMMON_ZTE_20260305_1345.zip"),
        "umeid_itbbu_itbbuplat_pm_common_zte_20260305_0000_r12.TAR.GZ": (
            ITBBU_PLATFORM, datetime(2026, 3, 5), 12, "tar.gz", "umeid_itbbu_itbbuplat_pm_common_zte_20260305_0000_r12.TAR.GZ"),
    }


@pytest.mark.parametrize("policy, kept", [
    ("additive", [0, 1, 2]), ("base-only", [0]), ("revisions-only", [1, 2]), ("latest-only", [2])])
def test_revision_policy(spark, policy, kept):
    paths = [f"UMEID_LTEFDD_PM_COMMON_ZTE_20260305_1345{s}.zip" for s in ("", "_R1", "_R2")]
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(r.revision for r in m.select_archives(listing, policy=policy).collect()) == kept


def test_bad_arguments(spark):
    listing = spark.createDataFrame([("x",)], "path string")
    with pytest.raises(ValueError, match="unsupported revision policy"):
        m.select_archives(listing, policy="newest")
    with pytest.raises(ValueError, match="unsupported dataset families: PM/x"):
        m.select_archives(listing, families=["PM/x"])


def test_time_window_args():
    assert m.time_window_args("2026-03-05", "2026-03-05") == (datetime(2026, 3, 5), datetime(2026, 3, 6))
    assert m.time_window_args("202603051330", "20260305_1345") == (datetime(2026, 3, 5, 13, 30), datetime(2026, 3, 5, 13, 46))
    assert m.time_window_args(None, "2026-03-05 13:45") == (None, datetime(2026, 3, 5, 13, 46))
    with pytest.raises(ValueError):
        m.time_window_args("yesterday", None)


def test_request_window():
    at = datetime(2026, 3, 5, 13, 45)
    assert m.request_window(interval_start=at) == (at, datetime(2026, 3, 5, 14))
    assert m.request_window(start=date(2026, 3, 5), end=date(2026, 3, 5)) == (
        datetime(2026, 3, 5), datetime(2026, 3, 5, 23, 59, 59, 999999))
    assert m.request_window() == (None, None)


def test_discover_files_reads_only_matching_family(spark, tmp_path):
    for family in ("sdr", "itbbu"):
        (tmp_path / family).mkdir()
        for name in ("UMEID_LTEFDD_PM_COMMON_ZTE_20260305_1345.zip", "UMEID_ITBBU_LTEFDD_PM_COMMON_ZTE_20260305_1345.zip", "x.txt"):
            (tmp_path / family / name).write_bytes(b"abc")
    found = m.discover_files(spark, {SDR_CELL: str(tmp_path / "sdr"), ITBBU_CELL: str(tmp_path / "itbbu")}).collect()
    assert sorted((r.dataset_family, r.filename, r.remote_size_bytes) for r in found) == [
        (ITBBU_CELL, "UMEID_ITBBU_LTEFDD_PM_COMMON_ZTE_20260305_1345.zip", 3), (SDR_CELL, "UMEID_LTEFDD_PM_COMMON_ZTE_20260305_1345.zip", 3)]
