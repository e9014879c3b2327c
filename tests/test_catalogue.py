"""Every query of the core against its SQL over the smallest tables."""

import os

import duckdb
import pytest

from pairloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW \"{f[:-8]}\" AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in catalogue.SQL:
        rel = duck.sql(catalogue.SQL[name])
        at = [rel.columns.index(c) for c in cols]
        assert len(rel.columns) == len(cols)
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    else:
        assert got
