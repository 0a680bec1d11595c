"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import datetime as dt
import decimal

import duckdb
import pytest

import __spark_entry__
from polyscan import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def value(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, dt.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = sorted(tuple(map(value, r)) for r in df.select(sorted(df.columns)).collect())
    assert got or name.startswith(("login_storm", "setop", "join_right", "join_anti", "agg_having"))
    if name not in registry.ORACLES:
        return
    r = con.execute(registry.ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted(tuple(value(x[i]) for i in order) for x in r.fetchall())


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns
