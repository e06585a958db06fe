"""Site, region and reporting topology over entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from radiokpi.functions import entity_level, page
from radiokpi.operators.entities import fact_columns, keyed_facts
from radiokpi.operators.records import records, unpivoted
from radiokpi.tables import Tables

PLACES = ["site_code", "site_name", "region_code", "region_name", "reporting_key", "reporting_name", "reporting_level"]


def topology_enrichment(tables: Tables) -> DataFrame:
    """One row per identity entity with its curated place; MAPPED when it has a site.

    Identity rows are never deleted, so recomputing the whole table equals upserting into it.
    """
    entities = tables.entity_identity.select("logical_entity_key", "dataset_family", "entity_level")
    placed = tables.topo_entity_map.select("logical_entity_key", "site_code", "reporting_key")
    sites = tables.topo_site.select("site_code", "site_name", "region_code")
    regions = tables.topo_region.select("region_code", "region_name")
    reporting = tables.topo_reporting.select("reporting_key", "reporting_name", "reporting_level")
    joined = (
        entities.join(placed, "logical_entity_key", "left").join(sites, "site_code", "left")
        .join(regions, "region_code", "left").join(reporting, "reporting_key", "left"))
    return joined.select(
        "logical_entity_key", "dataset_family", "entity_level", *PLACES,
        F.when(F.col("site_code").isNull(), "UNMAPPED").otherwise("MAPPED").alias("mapping_status"))


def entity_topology_projection(tables: Tables) -> DataFrame:
    """J2."""
    entities = tables.entity_identity.select("logical_entity_key", "dataset_family", "entity_level")
    places = tables.topo_enrichment.select("logical_entity_key", *PLACES, "mapping_status")
    return entities.join(places, "logical_entity_key", "left")


def with_places(frame: DataFrame, tables: Tables, *extra: str) -> DataFrame:
    """Add the place columns of the identity entities to any frame keyed by logical_entity_key.

    Places of keys unknown to the identity table stay out. That test is a semi join, whose
    size Spark bounds by the enrichment table, so a small one is still broadcast.
    """
    known = tables.entity_identity.select("logical_entity_key")
    places = tables.topo_enrichment.select("logical_entity_key", *PLACES, *extra).join(
        known, "logical_entity_key", "left_semi")
    return frame.join(places, "logical_entity_key", "left")


def entity_places(tables: Tables) -> DataFrame:
    """Identity entities with their kept level and their place: what a fact row takes from both, in one dimension.

    May be stored beside the facts, bucketed as they are.
    """
    if "entity_places" in tables:
        return tables["entity_places"]
    identity = tables.entity_identity.select("logical_entity_key", F.col("entity_level").alias("kept_level"))
    places = tables.topo_enrichment.select("logical_entity_key", *PLACES, "mapping_status")
    return identity.join(places, "logical_entity_key", "left")


def raw_with_entity_topology(tables: Tables) -> DataFrame:
    """Every fact row with its entity and place. One join: places belong to identity entities only.

    Facts and ``entity_places`` that are stored in buckets of the entity key meet without moving a fact row. Of facts
    held as records, the records are joined and then unpivoted.
    """
    found = records(tables)
    facts = (keyed_facts(tables) if found is None else found[0]).withColumns({
        "derived_logical_entity_key": F.col("logical_entity_key"), "derived_entity_level": entity_level()})
    joined = facts.join(entity_places(tables), "logical_entity_key", "left")
    if found is not None:
        joined = unpivoted(joined, found[1])
    return joined.select(
        *fact_columns(tables), "derived_logical_entity_key", "derived_entity_level", "logical_entity_key",
        F.coalesce("kept_level", "derived_entity_level").alias("entity_level"), *PLACES, "mapping_status")


def topology_overview(tables: Tables) -> DataFrame:
    """A22."""
    return tables.topo_enrichment.agg(
        F.count("*").alias("total_entities"),
        F.count("site_code").alias("mapped_entities_with_site"),
        F.count("region_code").alias("mapped_entities_with_region"),
        F.count_if(F.col("mapping_status") == "UNMAPPED").alias("unmapped_entities"),
        F.count_distinct("site_code").alias("distinct_sites"),
        F.count_distinct("region_code").alias("distinct_regions"))


def unmapped_entities(tables: Tables, *, limit: int | None = None) -> DataFrame:
    """F12."""
    unmapped = tables.topo_enrichment.where("mapping_status = 'UNMAPPED'")
    return page(unmapped.select("logical_entity_key", "dataset_family", "entity_level"),
                "dataset_family", "logical_entity_key", limit=limit)
