"""Every query against its SQL on the smallest tables; the queries of the corpus operators have their own tests."""

import math

import duckdb
import pytest

from weir.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "clicks", "sales", "sale_lines", "clients", "client_changes", "vendors", "items", "stamps"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    found = duck.execute(SQL[name])
    at = [[c[0] for c in found.description].index(c) for c in columns]
    assert len(found.description) == len(columns)
    want = [tuple(plain(r[k]) for k in at) for r in found.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
