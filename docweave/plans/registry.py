"""All registered queries over documents and business records, and their SQL for DuckDB."""

from __future__ import annotations

from . import queries_more, queries_ops, queries_rules, queries_search, queries_text

MODULES = (queries_rules, queries_text, queries_search, queries_ops, queries_more)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()} | {"diverse_results": queries_more.DIVERSE, "retrieve_and_rerank": queries_more.RERANKED}
