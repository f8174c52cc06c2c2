"""Every registered signal query against DuckDB on the small tables."""

import datetime
import decimal
import glob
import os

import duckdb
import numpy as np
import pytest

from signalmill.plans import catalog

DIR = "/root/testdata/sf0.001"
catalog.load()


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(plain(y) for y in x) + "]"
    if isinstance(x, dict):
        return str(sorted((k, plain(v)) for k, v in x.items()))
    if x is None or isinstance(x, float) and x != x:
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, decimal.Decimal, np.number)):
        return repr(round(float(x), 6) + 0.0)
    if isinstance(x, datetime.date) and not isinstance(x, datetime.datetime):
        return f"{x} 00:00:00"
    return str(x)


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(DIR + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in catalog.SQL:
        want = duck.execute(catalog.SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(want.fetchall(), names)
