"""Named queries over the test tables, each with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, ints: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its name, with the equivalent SQL if there is one; ints: columns that are 32-bit integers in Spark and wider in the SQL."""
    if sql and ints:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in ints)}) FROM ({sql}) q"

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from tessera.plans import chunks, documents, evaluation, graph, integrity, lifecycle, monitoring, projections, retrieval, rules, streams, text  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions answered end to end: lexical and vector candidates, bounded, fused, de-duplicated and cut to a budget."""
    _load()
    return _QUERIES["answer_contexts"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
