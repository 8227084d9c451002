"""Every registered query of the suites against DuckDB over the same tables."""

import math

import duckdb
import pytest

from loomwork.plans import registry

#: Queries whose result is empty by definition.
EMPTY = {"scan_empty", "subquery_not_in_null"}
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ")
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf001):
    con = duckdb.connect()
    for t in registry.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf001}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf001, duck, name):
    df = registry.QUERIES[name](spark, sf001)
    rows, columns = df.collect(), sorted(df.columns)
    assert bool(rows) != (name in EMPTY)
    if name not in registry.SQL:
        return
    want = duck.sql(registry.SQL[name])
    assert sorted(want.columns) == columns
    kinds = dict(zip(want.columns, map(str, want.types)))
    for c, kind in df.dtypes:
        assert kinds[c] == TYPES.get(kind, kinds[c])
    assert name in EMPTY or any(r[c] is not None for r in rows for c in columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())
