"""Entity identity: raw shapes, the identity table and rows carrying their entity.

``entity_level`` of a row is the level kept in the identity table, else the one
derived from its family. Only identity rows whose level differs from the derived
one can change a result, so aggregates join just those rows, after aggregating.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from radiokpi.functions import entity_level, logical_entity_key, page
from radiokpi.operators.records import counted, records, unpivoted
from radiokpi.tables import Tables

SHAPE = ["dataset_family", "sbnid", "enbid", "enodebid", "cellid", "meid", "ani"]


def keyed_facts(tables: Tables) -> DataFrame:
    """Fact rows with ``logical_entity_key`` computed from the raw dimensions; no join. Facts stored with their key keep it."""
    if "logical_entity_key" in tables.pm_sample.columns:
        return tables.pm_sample
    return tables.pm_sample.withColumn("logical_entity_key", logical_entity_key())


def fact_columns(tables: Tables) -> list[str]:
    return [c for c in tables.pm_sample.columns if c != "logical_entity_key"]


def level_overrides(tables: Tables) -> DataFrame:
    identity = tables.entity_identity
    family_in_key = F.regexp_extract("logical_entity_key", r"^family=([^|]*)", 1)
    return identity.where(
        F.col("entity_level").isNotNull() & (F.col("entity_level") != entity_level(family_in_key))
    ).select("logical_entity_key", F.col("entity_level").alias("_kept_level"))


def with_level(frame: DataFrame, tables: Tables) -> DataFrame:
    """Add ``entity_level`` to a frame holding dataset_family and logical_entity_key."""
    joined = frame.join(level_overrides(tables), "logical_entity_key", "left")
    return joined.withColumn("entity_level", F.coalesce("_kept_level", entity_level())).drop("_kept_level")


def raw_with_entity(tables: Tables) -> DataFrame:
    """Every fact row with its derived key and level and the level kept in the identity table."""
    identity = tables.entity_identity.select(
        "logical_entity_key", F.col("entity_level").alias("_identity_level"))
    found = records(tables)
    facts = (keyed_facts(tables) if found is None else found[0]).withColumn("derived_logical_entity_key", F.col("logical_entity_key"))
    facts = facts.withColumn("derived_entity_level", entity_level())
    joined = facts.join(identity, "logical_entity_key", "left")
    if found is not None:
        joined = unpivoted(joined, found[1])  # a record is joined, not each of its facts
    return joined.select(
        *fact_columns(tables), "derived_logical_entity_key", "derived_entity_level", "logical_entity_key",
        F.coalesce("_identity_level", "derived_entity_level").alias("entity_level"),
    )


def entity_keys(tables: Tables) -> DataFrame:
    """key and level per raw shape."""
    return distinct_entities(tables).select("dataset_family", "logical_entity_key", "entity_level").distinct()


def distinct_entities(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """Distinct raw shapes; the key string is built after the distinct, on far fewer rows."""
    shapes = counted(tables, tables.pm_sample)[0].select(*SHAPE).distinct()
    shapes = shapes.withColumn("logical_entity_key", logical_entity_key()).withColumn("entity_level", entity_level())
    return page(shapes, "dataset_family", "logical_entity_key", *SHAPE[1:], limit=limit)


def entity_summary_by_family(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """Shapes and distinct dimension values per family. ``distinct_logical_entity_keys`` counts shapes."""
    summary = distinct_entities(tables).groupBy("dataset_family", "entity_level").agg(
        F.count("*").alias("distinct_logical_entity_keys"),
        *[F.count_distinct(c).alias(f"distinct_{c}") for c in ("sbnid", "enbid", "enodebid", "cellid", "meid")],
    )
    return page(summary, "-distinct_logical_entity_keys", "dataset_family", limit=limit)


def entity_shapes(tables: Tables) -> DataFrame:
    """Raw shapes with a family and their rows: the part of the facts that an entity sync reads. May be stored per load."""
    if "entity_shapes" in tables:
        return tables["entity_shapes"]
    frame, rows, _ = counted(tables, tables.pm_sample)
    return frame.where("dataset_family is not null").groupBy(*SHAPE).agg(rows.alias("row_count"))


def sync_entities(tables: Tables, *, new_only: bool = False) -> DataFrame:
    """Identity table after merging the entities seen in facts.

    An entity may have several raw shapes; the smallest one represents it, so the
    result does not depend on row order. Entities without a family are left out.
    Shapes are counted in a hash aggregate of their own: without the count Spark
    would merge it with the choice of the smallest shape, which sorts what it reads.

    ``new_only``: the shapes are those of loads that no sync has seen. An entity then keeps the smaller of its new shape
    and the one that earlier syncs have left in the identity table, which is what a sync over all loads would choose.
    """
    dims = SHAPE[1:]

    def ordered(prefix: str = "") -> list:
        return [F.struct(F.col(prefix + c).isNull().alias("absent"), F.col(prefix + c).alias("value")).alias(c) for c in dims]

    shapes = entity_shapes(tables).groupBy(*SHAPE).agg(F.sum("row_count").alias("_rows"))
    seen = shapes.withColumns({"logical_entity_key": logical_entity_key(), "entity_level": entity_level()})
    seen = seen.groupBy("logical_entity_key", "dataset_family", "entity_level").agg(
        F.sum("_rows").alias("_rows"), F.min(F.struct(*ordered())).alias("_shape"))
    fresh = seen.where("_rows > 0").select(
        "logical_entity_key", "_shape", F.lit(True).alias("_fresh"), F.col("dataset_family").alias("_family"), F.col("entity_level").alias("_level"))
    merged = tables.entity_identity.withColumn("_known", F.lit(True)).join(fresh, "logical_entity_key", "full_outer")
    if new_only:
        merged = merged.withColumn("_shape", F.when(F.col("_known") & F.col("_fresh"), F.least("_shape", F.struct(*ordered()))).otherwise(F.col("_shape")))
    taken = {"dataset_family": F.col("_family"), **{c: F.col("_shape")[c]["value"] for c in dims}, "entity_level": F.col("_level")}
    return merged.select("logical_entity_key", *[F.when(F.col("_fresh"), value).otherwise(F.col(c)).alias(c) for c, value in taken.items()], "notes")


def entity_identity_list(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """F18."""
    columns = ["logical_entity_key", "dataset_family", *SHAPE[1:], "entity_level", "notes"]
    return page(tables.entity_identity.select(*columns), "dataset_family", "logical_entity_key", limit=limit)

