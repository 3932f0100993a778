"""Registry of named queries: a Spark builder and, where SQL can say it, a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return wrap


def load_all() -> None:
    """Import every plan module so their queries register."""
    from corpusflow.plans import (  # noqa: F401
        q_batches,
        q_communities,
        q_files,
        q_mixture,
        q_pages,
        q_sparse,
        q_store,
        q_stream,
        q_text,
        q_tokenizer,
        q_urls,
        q_windows,
    )
