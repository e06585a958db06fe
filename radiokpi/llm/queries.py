"""The registered queries of this package and their DuckDB statements."""

from __future__ import annotations

from radiokpi.llm import collocations, imatch, language, mixing, neighbours, packing, passages, pii, quality, rollups, simhash, spelling, toxicity

MODULES = (imatch, quality, mixing, toxicity, pii, passages, packing, neighbours, rollups, simhash, collocations, language, spelling)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in getattr(module, "SQL", {}).items()}
