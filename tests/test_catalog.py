"""Every query whose rows SQL can give is compared with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tailwise.plans import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(DIR):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return con


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-5 * max(1, abs(a))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns, key=str.lower)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in catalog.oracles():
        assert rows
        return
    found = duck.sql(catalog.oracles()[name])
    assert sorted(c.lower() for c in found.columns) == [c.lower() for c in columns]
    want = duck.sql("select {} from found".format(", ".join(f'"{c}"' for c in sorted(found.columns, key=str.lower)))).fetchall()
    assert len(rows) == len(want)
    for a, b in zip(sorted(rows, key=repr), sorted(want, key=repr), strict=True):
        assert all(map(close, a, b)), (a, b)


def test_third_degree_where_curves_begin(spark):
    """Curves are 0 at the least value; a rounding error there once decided at sf0.01."""
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{folder}/lineitem.parquet'")
    want = con.sql(catalog.oracles()["tsd_pairs"]).fetchall()
    assert sorted(tuple(r) for r in catalog.queries()["tsd_pairs"](spark, folder).select("x", "y", "dominates").collect()) == sorted(want)
