import numpy as np
import pytest
from pyspark.sql import functions as F

from galewright.operators import metrics as M
from galewright.operators import series as S
from galewright.spec import RunConfig, SeriesSpec, merge_names


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = [(s, k * 10 + int(rng.integers(9)), float(v)) for s, n in ((0, 53), (1, 20), (2, 7)) for k, v in enumerate(rng.normal(0, 1, n))]
    df = spark.createDataFrame([out[int(i)] for i in rng.permutation(len(out))], "s int, at long, v double")
    return S.number_rows(df, "s", ["at"], F.floor(F.col("at") / 100)).persist()


def by_series(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r["s"], r["at"])):
        out.setdefault(r["s"], []).append(r)
    return out


def test_numbering_follows_the_order(rows):
    for rs in by_series(rows).values():
        assert [r["t"] for r in rs] == list(range(len(rs)))


@pytest.mark.parametrize("block", [4, 1_000_000])
def test_neighbours_across_blocks(rows, block):
    got = {(r["s"], r["t"]): (r["a"], r["b"]) for r in S.neighbours(rows, "s", "t", {"a": ("v", 2), "b": ("v", -3)}, block).collect()}
    for s, rs in by_series(rows).items():
        v = [r["v"] for r in rs]
        for t in range(len(v)):
            assert got[s, t] == (v[t + 2] if t + 2 < len(v) else None, v[t - 3] if t >= 3 else None)


def test_normalizations_invert(rows):
    for mode in ("min_max", "avg_std_dev", "avg_var"):
        b = S.fit_bounds(rows, ["v"])
        there = S.normalize(rows, b, ["v"], mode=mode)
        back = S.denormalize(there, b, ["v"], mode=mode).join(rows.select("s", "t", F.col("v").alias("v0")), ["s", "t"])
        assert back.where("abs(v - v0) > 1e-9").count() == 0 and back.count() == rows.count()


def test_constant_column_normalizes_to_null(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [r["v"] for r in S.normalize(df, S.fit_bounds(df, ["v"]), ["v"]).collect()] == [None, None]


def test_episodes_keep_order_and_drop_only_remainders(rows):
    e = S.episodes(rows, "s", "t", 10).collect()
    assert sorted({r["episode_id"] for r in e}) == list(range(7))
    kept = {(r["s"], r["t"]) for r in e}
    assert kept == {(s, t) for s, n in ((0, 50), (1, 20)) for t in range(n)}
    assert all(r["step"] == r["t"] % 10 for r in e)


def test_slices(rows):
    got = S.split_slices(rows, "s", "t", 3).groupBy("s", "slice_no").count().collect()
    for s, n in ((0, 53), (1, 20), (2, 7)):
        assert [r["count"] for r in sorted((r for r in got if r["s"] == s), key=lambda r: r["slice_no"])] == [int((i + 1) * n / 3) - int(i * n / 3) for i in range(3)]


def test_lagged_correlation(rows):
    got = {(r["s"], r["lag"]): r["corr"] for r in S.lagged_correlation(rows.withColumn("w", F.col("v") * F.col("t")), "s", "t", "v", "w", [1, 10]).collect()}
    for s, rs in by_series(rows).items():
        a = np.array([r["v"] for r in rs])
        b = a * np.arange(len(a))
        for lag in (1, 10):
            if lag >= len(a):
                assert (s, lag) not in got
                continue
            want = ((a[lag:] - a.mean()) * (b[: len(a) - lag] - b.mean())).sum() / np.sqrt(a.var(ddof=1) * b.var(ddof=1)) / (len(a) - lag)
            assert abs(got[s, lag] - want) < 1e-9


def test_pooled_variance_is_that_of_the_union(rows):
    p = S.pooled_stats(S.series_stats(rows, "s", "t", "v")).collect()[0]
    v = np.array([r["v"] for r in rows.collect()])
    assert abs(p["avg"] - v.mean()) < 1e-12 and abs(p["pooled_var"] - v.var(ddof=1)) < 1e-12 and p["n"] == len(v)


def test_empty_series(spark):
    df = spark.createDataFrame([], "s int, at long, v double")
    n = S.number_rows(df, "s", ["at"], F.col("at"))
    assert n.collect() == [] and S.episodes(n, "s", "t", 5).collect() == [] and S.offset_pairs(n, "s", "t", ["v"], ["v"]).collect() == []
    assert M.running_wins(spark.createDataFrame([], "g int, winner string"), "g").collect() == []


def test_spec():
    assert merge_names(["a", "b"], ["b", "c"], ["a"]) == ["a", "b", "c"]
    s = SeriesSpec.from_parameters({"a": "i 0 1", "b": "b", "c": "o", "d": "s"}, offset=2)
    assert (s.inputs, s.outputs, s.shifted, s.bounds) == (("a", "b", "d"), ("b", "c"), ("d",), {"a": (0.0, 1.0)})
    assert RunConfig.from_toml('islands = 3\nupdate = "adam-bias"').islands == 3
    assert RunConfig.from_arguments(["--islands", "4", "--learning-rate", "0.1", "--prioritized", "false"]) == RunConfig(islands=4, learning_rate=0.1, prioritized=False)
    for bad in ("update = 'adam_bias'", "population_size = 3", "islands = 0", "mutation_weights = 'kaiming'"):
        with pytest.raises(ValueError):
            RunConfig.from_toml(bad)
    for bad in ({"inputs": ("a",), "outputs": ()}, {"inputs": ("a",), "outputs": ("b",), "shifted": ("c",)}, {"inputs": ("a",), "outputs": ("b",), "training": (1,), "testing": (1,)}):
        with pytest.raises(ValueError):
            SeriesSpec(**bad)
    with pytest.raises(ValueError):
        RunConfig.from_arguments(["--population-size", "4"])


def test_windows_are_listed_last_and_only_over_ids_that_exist(spark):
    """Gaps, blocks, ids below 0 and repeats; nothing is shuffled or sorted once a window's rows are made."""
    ids = [-3, 0, 1, 1, 2, 5, 6, 1022, 1023, 1024, 1025, 2047, 2048, 2050]
    generations = [0, 1, 4, 1019, 1021, 2040]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = S.availability(spark.createDataFrame([(k,) for k in ids], "episode_id long"), spark.createDataFrame([(g,) for g in generations], "generation long").repartition(3, "generation"), 2, 3)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = sorted(tuple(r) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    role = lambda g, k: "train" if k < g + 2 else "validation" if k < g + 5 else "test"
    assert rows == sorted((g, k, role(g, k)) for g in generations for k in set(ids) if 0 <= k <= g + 5)
    above = plan.split("Generate explode(sequence", 1)[0]
    assert len(above) < len(plan) and "Exchange" not in above and "Join" not in above
    empty = spark.createDataFrame([], "episode_id long")
    assert S.availability(empty, spark.createDataFrame([(0,)], "generation long"), 2, 3).count() == 0
