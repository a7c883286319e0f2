"""Every registered query with SQL equals it on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def plain(cols, rows):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return [cols[k] for k in order], sorted(tuple(repr(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    got = plain(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.ORACLES:
        rel = con.sql(registry.ORACLES[name])
        assert got == plain(rel.columns, rel.fetchall())
    else:
        assert got[1]


def test_entry_needs_no_training_operators():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
