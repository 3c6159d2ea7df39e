"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from hitloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def shown(v) -> str:
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v) + 0.0:.9g}"
    return "" if v is None else str(v)


def rows(names: list[str], found: list) -> list[tuple]:
    order = [names.index(n) for n in sorted(names)]
    return sorted(tuple(shown(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got
    if sql := catalog.oracle_sql().get(name):
        want = duck.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())
