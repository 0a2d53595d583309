"""Queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = ["language", "lm", "topk", "toxicity", "minhash", "sharding", "bpe", "simhash", "chat", "packing", "divergence", "decontaminate", "repair"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql.strip()
        return function

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and SQL of this folder, the pipeline at the repository top included."""
    for name in MODULES:
        import_module(f"kinloom.llm.{name}")
    pipeline = import_module("corpus_pipeline")
    QUERIES["pipeline"] = pipeline.run
    if pipeline.ORACLE_SQL is not None:
        SQL["pipeline"] = pipeline.ORACLE_SQL.strip()
    return QUERIES, SQL
