"""Key and reference checks that a database would enforce: a clean set of tables yields no row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from radiokpi.tables import Tables

# Fixed values: (table, column, referenced table, referenced column).
REFERENCES = (
    ("topo_site", "region_code", "topo_region", "region_code"),
    ("topo_reporting", "parent_reporting_key", "topo_reporting", "reporting_key"),
    ("topo_entity_map", "logical_entity_key", "entity_identity", "logical_entity_key"),
    ("topo_entity_map", "site_code", "topo_site", "site_code"),
    ("topo_entity_map", "reporting_key", "topo_reporting", "reporting_key"),
    ("kpi_counter_mapping", "kpi_name", "kpi_definition", "kpi_name"),
    ("kpi_counter_mapping", "counter_id", "counter_reference", "counter_id"),
    ("kpi_formula_input", "kpi_code", "kpi_formula", "kpi_code"),
    ("vendor_lineage", "indicator_code", "vendor_indicator", "indicator_code"),
    ("snapshot_rows", "snapshot_id", "snapshots", "snapshot_id"),
    ("reconciliation_results", "snapshot_id", "snapshots", "snapshot_id"),
)
# Columns that may hold a value once.
UNIQUE = (
    ("counter_dictionary", ("dataset_family", "counter_id")),
    ("counter_dictionary", ("dataset_family", "counter_alias")),
    ("entity_identity", ("logical_entity_key",)),
    ("topo_entity_map", ("logical_entity_key",)),
    ("counter_reference", ("counter_id",)),
    ("file_registry", ("source_name", "remote_path")),
)


def _found(rows: DataFrame, check: str, value) -> DataFrame:
    return rows.groupBy(F.lit(check).alias("check_name"), value.cast("string").alias("value")).agg(
        F.count("*").alias("row_count"))


def dangling_references(tables: Tables) -> DataFrame:
    """Values that point at no row, with the number of rows holding them."""
    parts = []
    for table, column, other, key in REFERENCES:
        known = tables[other].select(F.col(key).alias(column))
        parts.append(_found(tables[table].where(F.col(column).isNotNull()).select(column).join(known, column, "left_anti"),
                            f"{table}.{column}", F.col(column)))
    return _union(parts)


def repeated_keys(tables: Tables) -> DataFrame:
    """Values of a unique key that occur more than once; loaded hashes and active snapshots count as such keys."""
    parts = [_found(tables[table], f"{table}({', '.join(columns)})", F.concat_ws("|", *columns)) for table, columns in UNIQUE]
    loaded = tables.file_audit.where("status = 'SUCCESS' and file_hash is not null")
    parts.append(_found(loaded, "file_audit(file_hash of SUCCESS)", F.col("file_hash")))
    parts.append(_found(tables.snapshots.where("is_active_snapshot"), "snapshots(active)", F.lit("active")))
    return _union(parts).where("row_count > 1")


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
