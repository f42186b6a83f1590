"""Every registered query against its SQL twin; those without one give rows."""

import glob
import math

import duckdb
import pytest

from holdfast.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {f.rsplit('/', 1)[1][:-8]} as select * from '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return tuple(x) if isinstance(x, list) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in ORACLE:
        assert got
        return
    out = duck.execute(ORACLE[name])
    names = [c[0] for c in out.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, out.fetchall())
