"""Every core query against its SQL."""

import duckdb
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def rows_of(values):
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in row) for row in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, small, name):
    got = registry.queries()[name](spark, small)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.select(*names).collect()) == rows_of(found.fetchall())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(SQL)


def test_every_posting_is_written_as_json(spark, small):
    keys = spark.read.parquet(f"{small}/orders.parquet").selectExpr("o_orderkey as k")
    got = registry.queries()["json_without_empty_whole"](spark, small)
    assert sorted(r.k for r in got.select("k").collect()) == sorted(r.k for r in keys.collect())
