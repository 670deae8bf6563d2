"""Registered queries: name -> (DataFrame builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(builder: Builder) -> Builder:
        QUERIES[name] = builder
        if sql is not None:
            ORACLE[name] = sql
        return builder
    return keep


def load_all() -> None:
    """Import every module that registers queries."""
    from claimgrain.plans import (answer_queries, audit_queries, catalog_queries,  # noqa: F401
                                  graph_queries, ingest_queries, retrieval_queries,
                                  stream_queries, text_queries)
