"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tidewell.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    own = duckdb.connect()
    for t in TABLES:
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return own


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_names_of_sql_are_queries():
    assert registry.oracle_sql().keys() <= registry.queries().keys()


def test_listing_needs_no_session():
    import subprocess
    import sys

    from tests.conftest import ROOT

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
