"""Catalogue of the engine's registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lacuna.plans import corpus_queries, evolution_queries, expansion_queries, extraction_queries, formulation_queries, graph_queries, inventory_queries, judge_queries, rubric_queries, search_queries, state_queries

_MODULES = (graph_queries, corpus_queries, judge_queries, extraction_queries, rubric_queries, formulation_queries, evolution_queries, inventory_queries, search_queries, state_queries, expansion_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}

flagship = graph_queries.flagship
