"""The queries that SQL can express against DuckDB."""

import duckdb
import pytest

from tessera.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = duck.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(str([r[i] for i in at]) for r in want.fetchall()) == sorted(str(list(r)) for r in got.select(*order).collect())
