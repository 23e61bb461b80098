"""Every query that SQL can express gives DuckDB's rows; the others run and give rows."""

import math

import duckdb
import pytest

from lodestone.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if hasattr(x, "isoformat"):
        return x.replace(tzinfo=None).isoformat()
    if hasattr(x, "as_tuple"):
        return round(float(x), 9)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    data = got.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert data
        return
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, data) == rows(want.columns, want.fetchall())
