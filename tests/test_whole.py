"""Queries do the whole job: all generations, all pairs, all episodes, whole vectors."""

import duckdb
import numpy as np
import pandas as pd

from galewright.plans.catalog import core_queries


def write_events(spark, folder, episodes):
    """One user's events, just enough for so many episodes."""
    n = episodes * 20
    rows = pd.DataFrame({"event_id": np.arange(n), "user_id": 1, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "h"), "event_type": "view", "value": 50 + 30 * np.sin(np.arange(n) / 5)})
    spark.createDataFrame(rows).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_windows_reach_the_last_generation(spark, tmp_path):
    got = {tuple(r) for r in core_queries()["train_val_test_windows"](spark, write_events(spark, tmp_path / "many", 70)).collect()}
    role = lambda g, k: "train" if k < g + 10 else "validation" if k < g + 13 else "test"
    assert got == {(g, k, role(g, k)) for g in range(70 - 14) for k in range(g + 14)}


def test_too_few_episodes_have_no_window(spark, tmp_path):
    query = core_queries()["train_val_test_windows"]
    assert query(spark, write_events(spark, tmp_path / "none", 14)).count() == 0
    assert query(spark, write_events(spark, tmp_path / "one", 15)).count() == 14


# P21: all pairs of results of one work unit.
AGREEING = """WITH x AS (SELECT row_number() OVER () AS k, l_extendedprice AS p, l_partkey, l_suppkey, (l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS text FROM lineitem)
SELECT a.l_partkey, a.l_suppkey, count(*) FILTER (a.text IS NOT DISTINCT FROM b.text OR isfinite(a.p) AND isfinite(b.p) AND abs(a.p - b.p) < 100) AS n_agree, count(*) AS n_compared
FROM x a JOIN x b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.k < b.k GROUP BY ALL"""


def line_items(prices):
    """Results of one work unit with these prices; the rest of their text is the same."""
    return pd.DataFrame({"l_orderkey": np.arange(len(prices)), "l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 1.0, "l_extendedprice": pd.Series(prices, dtype=object), "l_discount": 0.0, "l_tax": 0.0, "l_returnflag": "N", "l_linestatus": "O", "l_shipdate": pd.Timestamp("2024-01-01")})


def agreeing(spark, folder, frame):
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    rows = [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in frame.astype(object).itertuples(index=False)]
    spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/lineitem.parquet")
    return sorted(tuple(r) for r in core_queries()["agreeing_results"](spark, str(folder)).collect())


def test_all_pairs_of_results_are_compared(spark, tmp_path):
    assert agreeing(spark, tmp_path / "three", line_items([0.0, 40.0, 80.0])) == [(1, 1, 3, 3)]
    # 100 apart is too far, on both sides of a bucket and below zero; copies are pairs too.
    assert agreeing(spark, tmp_path / "edge", line_items([-100.0, 0.0, 100.0, 199.99, 199.99])) == [(1, 1, 3, 10)]
    # Without a price the text decides: the same, or another.
    odd = line_items([None, None, None, 5.0, float("nan"), float("nan"), float("inf"), float("inf")])
    odd.loc[2, "l_returnflag"] = "R"
    assert agreeing(spark, tmp_path / "odd", odd) == [(1, 1, 3, 28)]
    assert agreeing(spark, tmp_path / "one", line_items([3.0])) == []


def test_agreeing_results_equal_the_self_join(spark, tmp_path):
    rng = np.random.default_rng(3)
    frame = pd.concat([line_items([float(v) for v in np.round(rng.uniform(-400, 900, 300), 2)]), line_items([float(v) for v in np.arange(0, 300) * 10 + 0.1])])
    frame["l_partkey"], frame["l_suppkey"] = rng.integers(1, 4, len(frame)), rng.integers(1, 3, len(frame))
    got = agreeing(spark, tmp_path / "many", frame)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/many/lineitem.parquet/*.parquet'")
    assert got == sorted(con.execute(AGREEING).fetchall())


def test_the_run_goes_on_to_the_last_episode(spark, tmp_path):
    log = core_queries()["evolve_small"](spark, write_events(spark, tmp_path / "run", 20)).orderBy("generation").collect()
    # The last row has no next value, so that the last episode isn't full: 19 stay.
    assert [(r["generation"], r["test_episode"]) for r in log] == [(g, g + 12) for g in range(19 - 12)]
    assert all(r["naive_mse"] >= 0 and r["model_mse"] >= 0 for r in log)


def test_array_functions_take_whole_vectors(spark, tmp_path):
    vectors = np.random.default_rng(2).normal(0, 0.4, (5, 64)).astype("float32")
    vectors[:, 40] = 3.0  # the greatest
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = core_queries()["array_functions"](spark, str(tmp_path)).orderBy("vec_id").toPandas()
    v = vectors.astype(float)
    p = np.exp(v) / np.exp(v).sum(1, keepdims=True)
    assert np.allclose(got["norm"], np.linalg.norm(v, axis=1), atol=1e-6) and (got["argmax"] == 40).all()
    assert np.allclose(got["product"], v.prod(1), rtol=1e-9, atol=0) and (got["product"] != 0).all()
    assert np.allclose(got["p0"], p[:, 0], atol=1e-6)
    assert np.allclose(got["top3"], p.max(1) / np.sort(p, 1)[:, -3:].sum(1), atol=1e-6)
