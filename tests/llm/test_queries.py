import os

import pytest

from galewright.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("GALEWRIGHT_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(df.collect()) >= 0 and df.columns
    assert set(ORACLES) <= set(QUERIES)
