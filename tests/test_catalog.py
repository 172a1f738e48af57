"""Every query runs on the smallest test data, and equals its SQL there."""

import os

import duckdb
import pandas as pd
import pytest

from galewright.plans.catalog import core_oracles, core_queries

DATA = os.environ.get("GALEWRIGHT_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        p = f"{DATA}/{f}"
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "null" if v is None or v is pd.NaT or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(core_queries()))
def test_query(spark, con, name):
    df = core_queries()[name](spark, DATA)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    if name in core_oracles():
        sql = con.execute(core_oracles()[name])
        want = pd.DataFrame(sql.fetchall(), columns=[c[0] for c in sql.description], dtype=object)
        assert sorted(want.columns) == sorted(got.columns)
        assert rows(got) == rows(want)


def test_oracles_belong_to_queries():
    assert set(core_oracles()) <= set(core_queries())


@needs_data
def test_plans(spark):
    plan = lambda n: core_queries()[n](spark, DATA)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan("top_k_per_group")
    assert "LeftAnti" in plan("orphans_anti") and "LeftSemi" in plan("keep_semi")
    assert "GreaterThanOrEqual(o_totalprice" in plan("range_computed")
    assert "CartesianProduct" not in plan("outpaced_orders") and "BroadcastNestedLoopJoin" not in plan("fitness_share")
