"""All registered queries of the training-data operators."""

from __future__ import annotations

from loam.llm import encoding_repair_queries, leakage_queries, main_body_queries, packing_queries, pii_queries, repeated_lines_queries, splitting_queries

MODULES = [repeated_lines_queries, encoding_repair_queries, main_body_queries, splitting_queries, packing_queries, leakage_queries, pii_queries]


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
