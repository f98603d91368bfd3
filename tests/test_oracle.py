"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from loomwright import queries_catalog, queries_jobs, queries_rows, registry  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v).removesuffix(" 00:00:00")


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_plan_order(spark):
    """Every edge points backwards, and of two changes without an edge between them the smaller key isn't needlessly late."""
    from loomwright.plans import changeplan
    from loomwright.queries_catalog import simple_changes, simple_deps

    changes = simple_changes(spark, DATA)
    edges = changeplan.wire_dependencies(changes, simple_deps(spark, DATA))
    cyclic = {(r.comparison_id, r.id) for r in changeplan.cyclic(edges).collect()}
    place = {(r.comparison_id, r.id): r.position for r in registry.QUERIES["d16_order_changes"](spark, DATA).collect()}
    after = {(r.comparison_id, r.needs) for r in edges.collect()}
    for r in edges.collect():
        if (r.comparison_id, r.id) not in cyclic and (r.comparison_id, r.needs) not in cyclic and not any((c, i) in cyclic for c, i in after if c == r.comparison_id):
            assert place[r.comparison_id, r.needs] < place[r.comparison_id, r.id]
    for c in {c for c, _ in place}:
        own = sorted(v for (k, _), v in place.items() if k == c)
        assert own == list(range(1, len(own) + 1))


def test_pages_follow_one_another(spark):
    from loomwright.operators import browse

    df = spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey")
    pages = [[r.c_custkey for r in p.orderBy("c_custkey").collect()] for p in browse.iterate_pages(df, 40, "c_custkey")]
    assert [len(p) for p in pages] == [40, 40, 40, 30]
    assert [x for p in pages for x in p] == sorted(r.c_custkey for r in df.collect())
