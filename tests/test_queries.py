"""Every table query against its SQL in another engine."""

import os

import duckdb
import pytest

from inkspan.plans import files, stores  # noqa: F401  they register their queries
from inkspan.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name not in plans.SQL:
        assert got
        return
    found = db.execute(plans.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(dict(zip(names, r))[c]) for c in cols)) for r in found.fetchall())
    assert got == want


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["path", "summary"]
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
