"""Topology sheet to snapshot rows (S16, S17). The sheet arrives as a tabular export, CSV or Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from radiokpi.functions import strip_space
from radiokpi.schemas import ITBBU_CELL, SDR_CELL

# Columns without which a sheet row cannot be placed, in checking order.
REQUIRED = ("SubnetID", "eNodeBid", "ENODEBName", "CellID", "CELLNAME", "SiteName", "Region")
OPTIONAL = ("Area", "ClusterID", "TEAM")


def _text(sheet: DataFrame, name: str) -> Column:
    """Cell as stripped text; a whole number held as a float loses its ``.0``."""
    if name not in sheet.columns:
        return F.lit("")
    column = F.col(name)
    if isinstance(sheet.schema[name].dataType, (T.DoubleType, T.FloatType)):
        whole = column == F.floor(column)
        text = F.when(whole, column.cast("decimal(38,0)").cast("string")).otherwise(column.cast("string"))
    else:
        text = column.cast("string")
    return F.coalesce(strip_space(text), F.lit(""))


def _cleaned(sheet: DataFrame) -> DataFrame:
    absent = sorted(set(REQUIRED) - set(sheet.columns))
    if absent:
        raise ValueError(f"Workbook is missing required columns: {', '.join(absent)}")
    first_missing = F.coalesce(*[F.when(F.col(n) == "", n) for n in REQUIRED])
    return sheet.select("source_row_number", *[_text(sheet, n).alias(n) for n in (*REQUIRED, *OPTIONAL)]).withColumn(
        "missing", first_missing)


def topology_snapshot_rows(sheet: DataFrame) -> DataFrame:
    """Two entity rows per complete sheet row, one for each cell family. Needs source_row_number."""
    rows = _cleaned(sheet).where("missing is null")
    cluster, area, team = (F.nullif(n, F.lit("")) for n in ("ClusterID", "Area", "TEAM"))

    def entity(family: str, node: str) -> Column:
        key = F.concat(F.lit(f"family={family}|sbnid="), "SubnetID", F.lit(f"|{node}="), "eNodeBid",
                       F.lit("|cellid="), "CellID")
        return F.struct(key.alias("logical_entity_key"), F.lit(family).alias("dataset_family"))

    both = rows.withColumn("entity", F.explode(F.array(entity(SDR_CELL, "enodebid"), entity(ITBBU_CELL, "enbid"))))
    return both.select(
        "source_row_number", "entity.logical_entity_key", "entity.dataset_family",
        F.col("SiteName").alias("site_code"), F.col("SiteName").alias("site_name"),
        F.col("Region").alias("region_code"), F.col("Region").alias("region_name"), area.alias("area_name"),
        cluster.alias("cluster_id"), team.alias("team_code"),
        F.concat(F.lit("CLUSTER::"), cluster).alias("reporting_key"), cluster.alias("reporting_name"),
        F.when(cluster.isNotNull(), "cluster").alias("reporting_level"),
        F.col("SubnetID").alias("workbook_subnet_id"), F.col("eNodeBid").alias("workbook_enodeb_id"),
        F.col("ENODEBName").alias("workbook_enodeb_name"), F.col("CELLNAME").alias("workbook_cell_name"),
        F.lit("topology_workbook").alias("mapping_source"), F.lit(None).cast("string").alias("notes"))


def topology_sheet_problems(sheet: DataFrame) -> DataFrame:
    """Sheet rows that lack a required cell, with the first one missing."""
    return _cleaned(sheet).where("missing is not null").select(
        "source_row_number",
        F.concat(F.lit("row "), F.col("source_row_number").cast("string"), F.lit(": missing critical field: "),
                 F.col("missing")).alias("message"))


def release_date(file_name) -> Column:
    """Date in the first run of eight digits of a file name; NULL when they are no date."""
    return F.try_to_date(F.nullif(F.regexp_extract(file_name, r"(\d{8})", 1), F.lit("")), "yyyyMMdd")
