"""Every registered query against its SQL on the smallest supplied tables."""

import math
import os

import duckdb
import pytest

from wardgrid.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are not here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracles())


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.oracles())))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=key)
    res = db.execute(catalog.oracles()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in order) for r in res.fetchall()), key=key)
    assert got == want
