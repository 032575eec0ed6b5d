"""Every query that has SQL against DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from versewright import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    """A value as both engines would show it: whole numbers without a fraction, lists as tuples."""
    if isinstance(x, list):
        return tuple(map(plain, x))
    return int(x) if isinstance(x, float) and x.is_integer() else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    rows = db.execute(catalog.ORACLE_SQL[name])
    at = [[d[0] for d in rows.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in at) for r in rows.fetchall()), key=str)
    assert len(rows.description) == len(columns) and got == want
