"""The dealt queries that have SQL against DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from versewright.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = con.execute(queries.ORACLE_SQL[name]).fetchall()
    at = [[d[0] for d in con.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == sorted((tuple(r[k] for k in at) for r in want), key=str)
