"""Every query with SQL gives what DuckDB gives; those without run and have a stable schema."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from tallyweave.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL, SQL = Q.queries(), Q.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _norm(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    df = ALL[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in SQL:
        again = ALL[name](spark, SF).repartition(3)
        assert got and got == sorted((tuple(_norm(r[c]) for c in cols) for r in again.collect()), key=str)
        return
    res = duck.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(_norm(r[i]) for i in at) for r in res.fetchall()), key=str)
