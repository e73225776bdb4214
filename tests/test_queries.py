"""Every registered query of the library against its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pytest

from vellumgrid.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = sorted(repr(norm(tuple(r))) for r in df.collect())
    rel = db.sql(ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert got == sorted(repr(norm(tuple(r[i] for i in at))) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
