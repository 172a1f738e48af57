import numpy as np

from galewright.operators.gridding import regular_grid


def reference(rows, step, bandwidth, min_support, degree=1):
    """Weighted local polynomials by NumPy's least squares."""
    out = {}
    for s in {r[0] for r in rows}:
        t = np.array([r[1] for r in rows if r[0] == s])
        v = np.array([r[2] for r in rows if r[0] == s], float)
        slots = t - t % step
        for slot in range(slots.min(), slots.max() + 1, step):
            x = (t - slot - step // 2) / bandwidth
            inside = slots == slot
            w = np.where((np.abs(x) < 1) | inside, (1 - np.minimum(np.abs(x), 0.999) ** 3) ** 3, 0.0) * ~np.isnan(v)
            support = w.sum() ** 2 / (w**2).sum() if w.any() else 0.0
            y = None
            if support >= min_support or (inside.any() and w.any()):
                k = w > 0
                sw = np.sqrt(w[k])
                wide = np.average(x[k] ** 2, weights=w[k]) - np.average(x[k], weights=w[k]) ** 2 > 1e-3
                a = np.stack([x[k] ** p for p in range((degree if wide else 0) + 1)], 1)
                y = float(np.linalg.lstsq(a * sw[:, None], v[k] * sw, rcond=None)[0][0])
            out[s, slot] = (int(inside.sum()), y)
    return out


def test_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    rows = [("a", int(t), float(np.sin(t / 5000))) for t in np.sort(rng.choice(200_000, 120, replace=False))] + [("b", 1_000, 3.0), ("b", 1_000, 3.0), ("b", 9_000, float("nan"))]
    df = spark.createDataFrame(rows, "s string, t long, v double")
    got = {(r["s"], r["slot_s"]): r for r in regular_grid(df, "s", "t", ["v"], 600, 1500, 1.5).collect()}
    want = reference(rows, 600, 1500, 1.5)
    assert got.keys() == want.keys()
    for k, (n, y) in want.items():
        assert got[k]["n"] == n and got[k]["is_empty"] == (n == 0)
        assert (got[k]["v"] is None) == (y is None) == got[k]["v_missing"], k
        assert y is None or abs(got[k]["v"] - y) < 1e-6, k


def test_degrees(spark):
    """Each degree gives back polynomials of its own."""
    t = np.arange(0, 86400, 450)
    df = spark.createDataFrame([("a", k, 1.0, 2.0 + k / 9000, 1 + (k / 9000 - 3) ** 2) for k in t.tolist()], "s string, t long, c double, l double, q double")
    for degree, columns in ((0, "c"), (1, "cl"), (2, "clq")):
        for r in regular_grid(df, "s", "t", list(columns), degree=degree).where("slot_s BETWEEN 3000 AND 80000").collect():
            m = (r["slot_s"] + 300) / 9000
            assert all(abs(r[c] - want) < 1e-6 for c, want in (("c", 1.0), ("l", 2 + m), ("q", 1 + (m - 3) ** 2)) if c in columns), (degree, r)


def test_the_sums_are_worked_out_once(spark):
    """The grid and its values read one exchange; the kernel stays in the plan of the empty slots alone."""
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 90_000, 1.0)], "s string, t long, v double")
    empty = regular_grid(df, "s", "t", []).where("is_empty").select("s", "slot_s")
    assert empty.count() == 149
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert "POWER" in plan.upper()


def test_edges(spark):
    df = spark.createDataFrame([(None, 5, 1.0), ("a", None, 1.0), ("a", -601, 1.0), ("a", 599, 2.0)], "s string, t long, v double")
    got = sorted((r["slot_s"], r["n"]) for r in regular_grid(df, "s", "t", []).collect())
    assert got == [(-1200, 1), (-600, 0), (0, 1)]
    assert regular_grid(df.where("false"), "s", "t", ["v"]).collect() == []
    far = spark.createDataFrame([("a", 0, 1.0), ("a", 86400 * 9, 1.0)], "s string, t long, v double")
    assert regular_grid(far, "s", "t", ["v"]).where("is_empty").count() == 144 * 9 - 1
