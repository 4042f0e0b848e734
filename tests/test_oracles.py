"""Every core query with an oracle gives the rows of its SQL; the rest run and have rows."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from cairn.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in catalog.ORACLES:
        assert got
        return
    sql = duck.sql(catalog.ORACLES[name])
    assert sorted(sql.columns) == columns
    assert got == sorted(tuple(map(plain, r)) for r in sql.select(*[f'"{c}"' for c in columns]).fetchall())
