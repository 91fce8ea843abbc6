"""The operators that have SQL against it, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import DATA

from hopmetrics.llm import registry

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_operator_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    found = registry.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    expected = sorted((tuple(row) for row in cursor.fetchall()), key=repr)
    assert expected and sorted((tuple(row[c] for c in columns) for row in found.collect()), key=repr) == expected
