"""Fixed vocabulary and table layouts."""

from __future__ import annotations

# Data-set families and the raw dimensions that identify an entity in each.
SDR_CELL = "PM/sdr/ltefdd"
ITBBU_CELL = "PM/itbbu/ltefdd"
ITBBU_PLATFORM = "PM/itbbu/itbbuplat"
FAMILIES = (ITBBU_PLATFORM, ITBBU_CELL, SDR_CELL)
CELL_FAMILIES = (ITBBU_CELL, SDR_CELL)
IDENTITY_FIELDS = {
    SDR_CELL: ("sbnid", "enodebid", "cellid"),
    ITBBU_CELL: ("sbnid", "enbid", "cellid"),
    ITBBU_PLATFORM: ("sbnid", "meid"),
}
ALL_IDENTITY_FIELDS = ("sbnid", "enbid", "enodebid", "cellid", "meid", "ani")

# Archive name prefix per family.
ARCHIVE_PREFIXES = {
    "UMEID_ITBBU_ITBBUPLAT_PM_COMMON_ZTE_": ITBBU_PLATFORM,
    "UMEID_ITBBU_LTEFDD_PM_COMMON_ZTE_": ITBBU_CELL,
    "UMEID_LTEFDD_PM_COMMON_ZTE_": SDR_CELL,
}

# Columns of a counter file that are not counters.
TIME_COLUMN = "COLLECTTIME"
KEPT_DIMENSIONS = (
    "TRNCMEID", "ANI", "SBNID", "ENBID", "ENODEBID", "CELLID", "MEID", "SYSTEMMODE", "MIDFLAG", "NETYPE",
)
DROPPED_DIMENSIONS = ("DESTIPADDR", "DETECTPRO", "DETECTPORT")
KNOWN_COLUMNS = (TIME_COLUMN, *KEPT_DIMENSIONS, *DROPPED_DIMENSIONS)

FACT_COLUMNS = (
    "source_file", "dataset_family", "interval_start", "revision", "csv_name", "collect_time",
    "trncmeid", "ani", "sbnid", "enbid", "enodebid", "cellid", "meid", "systemmode", "midflag", "netype",
    "counter_id", "counter_value",
)

# Policies and verification statuses.
REVISION_POLICIES = ("additive", "base-only", "revisions-only", "latest-only")
COUNTER_STATUSES = ("VERIFIED", "UNVERIFIED", "UNKNOWN")
SEMANTIC_STATUSES = ("VERIFIED", "PROVISIONAL", "UNVERIFIED", "UNKNOWN")
INTERVAL_MINUTES = 15
