"""Every query against its SQL on the small tables."""

import os

import duckdb
import pytest

from codelode import catalog, catalog_reviews, catalog_tools  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def plain(rows):
    return sorted((tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    a = plain(tuple(r[c] for c in cols) for r in got.collect())
    b = plain(want.select(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
