"""Every query with SQL gives DuckDB's rows."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from threadloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def plain(x):
    if isinstance(x, (float, Decimal)):
        return None if math.isnan(x) else round(float(x), 6)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    result = con.execute(registry.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_the_others_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_filters_reach_the_scan(spark):
    plan = registry.flt_since_until(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "In(role, [assistant,user])" in plan.split("PushedFilters")[1].split("\n")[0]
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]
