"""Every query of the core against its SQL on the smallest tables, and against an empty collection."""

import os

import pytest

from loomdex.plans import registry
from loomdex.plans.session import TABLES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def canon(frame):
    import pandas as pd

    def cell(x):
        if isinstance(x, float):
            return "NULL" if x != x else str(int(x)) if x == int(x) else repr(round(x, 6))
        return "NULL" if x is None or x is pd.NaT else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    if name not in registry.SQL:
        assert df.count() >= 0
        return
    want = duck.sql(registry.SQL[name]).df()
    got = df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{DIR}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", [n for n in sorted(registry.QUERIES) if n[0] == "p" and n[1].isdigit()])
def test_empty_tables(spark, empty_dir, name):
    assert registry.QUERIES[name](spark, empty_dir).count() == 0
