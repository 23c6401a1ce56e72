"""Every registered query that has SQL gives the rows of that SQL."""

import decimal

import duckdb
import pytest

from acrelake.plans import catalogue, cycles, discoveries, layouts, reports, shapes, snapshots, stores, upkeep, validators  # noqa: F401  (the others register their queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*want.columns).collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
