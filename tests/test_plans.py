import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from basalt.plans import core_queries, core_sql

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not glob.glob(f"{FOLDER}/*.parquet"), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v if not isinstance(v, (list, tuple)) else tuple(map(plain, v))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(core_sql()))
def test_query_matches_sql(spark, duck, name):
    df = core_queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    r = duck.execute(core_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == Counter(tuple(plain(row[i]) for i in at) for row in r.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(core_queries().keys() - core_sql().keys()))
def test_query_runs(spark, name):
    assert core_queries()[name](spark, FOLDER).count() >= 0


@needs_data
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()


def test_dates_are_comparable():
    assert plain(datetime.date(2026, 1, 1)) == datetime.date(2026, 1, 1)
