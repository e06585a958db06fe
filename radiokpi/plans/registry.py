"""All registered queries by name."""

from __future__ import annotations

from radiokpi.plans import coverage_queries, file_queries, ingest_queries, kpi_queries, snapshot_queries
from radiokpi.plans.query import Query

MODULES = (coverage_queries, kpi_queries, snapshot_queries, file_queries, ingest_queries)
ALL: dict[str, Query] = {q.name: q for module in MODULES for q in module.QUERIES}

if len(ALL) != sum(len(m.QUERIES) for m in MODULES):
    raise RuntimeError("two registered queries share a name")
