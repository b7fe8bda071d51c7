"""All registered queries of the core library."""

from __future__ import annotations

from loam.plans import crawl_queries, page_queries, retrieval_queries, show_queries, snapshot_queries, store_queries

MODULES = [retrieval_queries, store_queries, crawl_queries, page_queries, show_queries, snapshot_queries]
FLAGSHIP = "bm25_search_top10"


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
