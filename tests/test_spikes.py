import numpy as np
from pyspark.sql import functions as F

from galewright.operators.spikes import Field, constant_runs, gesd, implausible_values, t_quantile

FIELDS = [Field("v", ("w",), least=2.0, low=-20.0, high=60.0)]


def series(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    w = 20 + 5 * np.sin(np.arange(n) / 40) + rng.normal(0, 0.2, n)
    return w + rng.normal(0, 0.1, n), w


def frame(spark, v, w, t=None, source="a"):
    t = np.arange(len(v)) * 600 if t is None else t
    rows = [(k, source, None if t[k] is None else int(t[k]), int(k * 600), None if v[k] is None else float(v[k]), float(w[k]), "x") for k in range(len(v))]
    return spark.createDataFrame(rows, "id long, s string, t long, arrived long, v double, w double, field string")


def found(df, **more):
    return {(r["id"]) for r in implausible_values(df, "id", "s", "t", FIELDS, "arrived", **more).collect()}


def test_spikes_runs_and_ranges_but_no_level_shift(spark):
    v, w = series()
    want = set()
    for a, n, d in ((100, 1, 9), (500, 2, -7), (1200, 3, 6), (2999, 1, 8), (0, 1, 8)):
        v[a : a + n] += d
        want |= set(range(a, a + n))
    v[700:712] = v[700]  # stuck: all but the first
    want |= set(range(701, 712))
    v[1500] = 500.0  # out of range
    v[1600:1606] = 90.0
    want |= {1500, *range(1600, 1606)}
    v[2000:] += 10  # a lasting change
    v[900:905] += 8  # five readings are no spike
    w[1000:1100] += 12  # a storm that both sensors see
    v[1000:1100] += 12
    v = list(v)
    v[300] = None
    v[301] = float("nan")
    got = found(frame(spark, v, w))
    assert got == want
    # The blocks' size doesn't matter.
    assert found(frame(spark, v, w), block_rows=400) == want


def test_a_real_gust_beyond_the_usual_range_is_no_case(spark):
    rng = np.random.default_rng(7)
    w = np.abs(rng.normal(100, 5, 2000))
    w[600:606] = 300.0
    v = 2 * w + rng.normal(0, 0.5, 2000)
    v[1200:1206] = 900.0  # the companion stays
    fields = [Field("v", ("w",), least=0.1, low=-0.2, high=1.3, scaled=True, relative=True)]
    got = {r["id"] for r in implausible_values(frame(spark, v, w), "id", "s", "t", fields, "arrived").collect()}
    assert got == set(range(1200, 1206))


def test_repeats_and_rows_without_time(spark):
    v, w = series(400)
    v[50] += 9
    v[200:208] = v[200]
    base = frame(spark, v, w)
    again = base.where("id IN (50, 203)").withColumn("id", F.col("id") + 10_000)
    loose = base.where("id = 204").withColumn("id", F.lit(20_000).cast("long")).withColumn("t", F.lit(None).cast("long"))
    assert found(base.unionByName(again).unionByName(loose)) == {50, 10_050, *range(201, 208), 10_203, 20_000}


def test_edge_cases(spark):
    df = frame(spark, [1.0, 2.0, 99.0], [1.0, 2.0, 3.0])
    assert found(df) == {2}
    assert found(df.where("false")) == set()
    assert found(df.withColumn("s", F.lit(None).cast("string"))) == {2}
    assert found(df.withColumn("t", F.lit(None).cast("long")).withColumn("arrived", F.lit(None).cast("long"))) == {2}


def textbook_gesd(x, alpha):
    """The test as published, with mean and deviation in place of median and MAD: removed values in order, deviations, limits."""
    x, left, out = np.asarray(x, float), list(range(len(x))), []
    for i in range(1, len(x) // 2 + 1):
        v = x[left]
        far = int(np.argmax(np.abs(v - np.median(v))))
        mad = 1.4826 * np.sort(np.abs(v - np.median(v)))[(len(v) + 1) // 2 - 1]
        n = len(x)
        t = t_quantile(np.array([1 - alpha / (2 * (n - i + 1))]), np.array([n - i - 1.0]))[0]
        out.append((left.pop(far), abs(v[far] - np.median(v)) / max(mad, 1e-9), (n - i) * t / np.sqrt((n - i - 1 + t * t) * (n - i + 1))))
    last = max([k + 1 for k, (_, r, limit) in enumerate(out) if r > limit], default=0)
    return {k for k, _, _ in out[:last]}


def test_gesd_takes_centre_and_scale_anew_at_each_step():
    rng = np.random.default_rng(11)
    for n in (3, 4, 7, 8, 25, 60, 151):
        for k in (0, 1, n // 5, n // 3):
            x = rng.normal(0, 1, n)
            x[:k] += rng.choice([-1, 1], k) * rng.uniform(4, 30, k)
            assert set(np.nonzero(gesd(x, 0.05))[0]) == textbook_gesd(x, 0.05), (n, k)
    # The published example of 54 values has three outliers; a third of outliers are all found.
    rosner = [-0.25, 0.68, 0.94, 1.15, 1.20, 1.26, 1.26, 1.34, 1.38, 1.43, 1.49, 1.49, 1.55, 1.56, 1.58, 1.65, 1.69, 1.70, 1.76, 1.77, 1.81, 1.91, 1.94, 1.96, 1.99, 2.06, 2.09, 2.10, 2.14, 2.15, 2.23, 2.24, 2.26, 2.35, 2.37, 2.40, 2.47, 2.54, 2.62, 2.64, 2.90, 2.92, 2.92, 2.93, 3.21, 3.26, 3.30, 3.59, 3.68, 4.30, 4.64, 5.34, 5.42, 6.01]
    assert {51, 52, 53} <= set(np.nonzero(gesd(np.array(rosner), 0.05))[0])
    x = np.r_[rng.normal(0, 1, 140), 100 + rng.normal(0, 1, 60)]
    assert set(np.nonzero(gesd(x))[0]) == set(range(140, 200))
    assert set(np.nonzero(gesd(np.array([1.0, 2.1, 1.4, 3.0, 2.4, 1e6, 1.9])))[0]) == {5}


def test_without_companion_the_reading_itself_is_decomposed(spark):
    v, w = series()
    v[400] += 40
    nulls = [float("nan")] * len(w)
    assert found(frame(spark, v, nulls)) == {400}
    # Power without torque: the own range is the unit, and ranges are checked.
    fields = [Field("v", ("w",), least=0.1, low=-0.2, high=1.3, scaled=True, relative=True)]
    p = np.abs(v) * 10
    p[700], p[900] = 5_000.0, -900.0
    got = {r["id"] for r in implausible_values(frame(spark, p, nulls), "id", "s", "t", fields, "arrived").collect()}
    assert {700, 900, 400} <= got and len(got) <= 6


def test_many_spikes_and_few_readings(spark):
    v, w = series(600)
    at = np.arange(5, 595, 6)
    v[at] += 30  # a sixth of the readings
    assert found(frame(spark, v, w)) == set(at.tolist())
    few = [1.0, 1.2, 1.1, 59.0, 1.3, 1.2, 1.1]
    assert found(frame(spark, few, [1.0] * 7)) == {3}


def test_a_wrong_date_makes_no_block_longer(spark):
    v, w = series(2000)
    v[500] += 9
    t = [int(k * 600) + 1_500_000_000 for k in range(2000)]
    t[1000] = 0  # 1970
    assert found(frame(spark, v, w, t), block_rows=300) == {500}


def test_parts():
    x = np.r_[np.random.default_rng(1).normal(0, 1, 500), 12.0, -11.0, np.nan]
    assert set(np.nonzero(gesd(x))[0]) == {500, 501}
    assert abs(t_quantile(np.array([0.975]), np.array([10.0]))[0] - 2.228139) < 1e-3
    assert not gesd(np.zeros(50)).any() and not gesd(np.array([1.0])).any()
    runs = constant_runs(np.array([5, 5, np.nan, 5, 5, 5, 5, 5, 0, 0, 0, 0, 0, 0, 0, 0]), np.ones(16, bool), 7)
    assert list(np.nonzero(runs)[0]) == [1, 3, 4, 5, 6, 7]
