"""All queries of the core by name, with the SQL that states them."""

from __future__ import annotations

from evidara.plans import curation_plans, data_quality, graph_plans, retrieval_plans, text_plans

MODULES = (text_plans, graph_plans, retrieval_plans, curation_plans, data_quality)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}
FLAGSHIP = "p5_found"
