import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from lumenrel.operators import catalogue, stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: "null" if v is None else f"{v:.6g}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", [*catalogue.SQL, *catalogue.PAIRS, *stored.ORACLES])
def test_query_equals_oracle(spark, duck, name):
    got = (catalogue.queries() | stored.QUERIES)[name](spark, SF)
    want = duck.sql((catalogue.oracles() | stored.ORACLES)[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_uuidv7(spark):
    found = [r["id"] for r in stored.QUERIES["fn_uuidv7"](spark, SF).collect()]
    assert len(set(found)) == len(found) == 25
    import re

    assert all(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", x) for x in found)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 10


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.queries()["filter_gt"](spark, SF)._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,400000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
