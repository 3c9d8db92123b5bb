"""Every core query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from deskloom.plans.catalog import CORE
from deskloom.sources.tables import BASE


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return value


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CORE.oracle))
def test_same_rows(spark, small, duck, name):
    df = CORE.queries[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r.asDict(True)[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(CORE.oracle[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(CORE.queries) - set(CORE.oracle)))
def test_rows_without_sql(spark, small, name):
    assert CORE.queries[name](spark, small).count() > 0
