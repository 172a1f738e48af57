"""Queries of the time-series operators. The series is ``events`` by user, in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewright.operators import metrics as M
from galewright.operators import series as S
from galewright.session import table

EPISODE = 20


def _seconds(c: str):
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as (user_id, t, event_id, event_type, value), t being the row's place in its user's series."""
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return S.number_rows(df, "user_id", ["ts", "event_id"], F.to_date("ts"))


def r(c, digits: int = 6):
    return F.round(c, digits)


def series_rows(spark, d):
    return events(spark, d).select("user_id", "t", "event_id")


def series_stats(spark, d):
    s = S.series_stats(events(spark, d), "user_id", "t", "value")
    return s.select("user_id", "n", *[r(c).alias(c) for c in ("min", "max", "avg", "var", "sd", "min_change", "max_change")])


def series_constant(spark, d):
    """Order statuses never change within an order: series of one repeated value are found."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.round("l_tax", 2).alias("value"), F.row_number().over(_by_order()).alias("t"))
    return S.constant_series(S.series_stats(rows.withColumn("t", (F.col("t") - 1).cast("bigint")), "l_orderkey", "t", "value")).select("l_orderkey", "n")


def _by_order():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_tax", "l_linenumber", "l_partkey")


def series_cut(spark, d):
    return S.cut(events(spark, d), "t", 5, 15).groupBy("user_id").agg(F.count("*").alias("n"), r(F.avg("value")).alias("avg_value"))


def series_project(spark, d):
    """Series with their role: each third user's trains."""
    training = F.col("user_id") % 3 == 1
    return events(spark, d).select("user_id", "t", "value", F.when(training, "train").otherwise("test").alias("role"))


def global_bounds(spark, d):
    b = S.fit_bounds(table(spark, d, "events"), ["value"], ["event_type"])
    return b.select("event_type", r("min_value").alias("lo"), r("max_value").alias("hi"))


def pooled_var(spark, d):
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"), F.var_samp("value").alias("var"))
    p = S.pooled_stats(per, "event_type")
    return p.select("event_type", "n", r("avg").alias("avg"), r("pooled_var", 4).alias("pooled_var"))


def _scaled(mode):
    def run(spark, d):
        df = table(spark, d, "events").select("event_id", "event_type", "value")
        b = S.fit_bounds(df, ["value"], ["event_type"])
        return S.normalize(df, b, ["value"], ["event_type"], mode).select("event_id", r("value").alias("scaled"))

    return run


def denorm_min_max(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type", "value")
    b = S.fit_bounds(df, ["value"], ["event_type"])
    back = S.denormalize(S.normalize(df, b, ["value"], ["event_type"]), b, ["value"], ["event_type"])
    return back.select("event_id", r("value").alias("value"))


def norm_given_bounds(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type", "value")
    b = S.fit_bounds(df, ["value"], given={"value": (0.0, 500.0)})
    return S.normalize(df, b, ["value"]).select("event_id", r("value").alias("scaled"))


def norm_outside(spark, d):
    df = table(spark, d, "events").select("event_type", "value")
    b = S.fit_bounds(df.where("event_type = 'purchase'"), ["value"])
    return S.outside_bounds(df, b, ["value"]).select(F.col("value").alias("n_outside"))


def _pairs(k, shifted=False):
    def run(spark, d):
        e = events(spark, d).withColumn("log_value", F.round(F.log1p(F.abs("value")), 9))
        p = S.offset_pairs(e, "user_id", "t", ["value", "log_value"], ["value"], k, ["log_value"] if shifted else [])
        return p.select("user_id", "t", r("x_value").alias("x_value"), r("x_log_value").alias("x_log_value"), r("y_value").alias("y_value"))

    return run


def lag_corr(spark, d):
    e = events(spark, d).withColumn("b", F.col("event_id").cast("double") % 97)
    c = S.lagged_correlation(e, "user_id", "t", "value", "b", [1, 2, 3, 4, 5])
    return c.select("user_id", "lag", r("corr").alias("corr"))


def lag_corr_matrix(spark, d):
    e = events(spark, d).withColumn("b", F.col("event_id").cast("double") % 97)
    c = S.lagged_correlation(e, "user_id", "t", "value", "b", [1, 2, 3])
    wide = c.groupBy("user_id").pivot("lag", [1, 2, 3]).agg(F.first("corr"))
    return wide.select("user_id", *[r(F.col(str(k))).alias(f"lag_{k}") for k in (1, 2, 3)])


def episodes_20(spark, d):
    return S.episodes(events(spark, d), "user_id", "t", EPISODE).select("user_id", "t", "episode_id", "step")


def episode_stats(spark, d):
    e = S.episodes(events(spark, d), "user_id", "t", EPISODE)
    return e.groupBy("episode_id").agg(F.count("*").alias("n"), r(F.avg("value")).alias("avg_value"))


def split_n(spark, d):
    return S.split_slices(events(spark, d), "user_id", "t", 7).groupBy("user_id", "slice_no").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


def _episode_ids(spark, d):
    return S.episodes(events(spark, d), "user_id", "t", EPISODE).select("episode_id").distinct()


def train_val_test_windows(spark, d):
    """The windows of all generations that the data gives. They list each earlier episode, so rows grow with the square of the episodes."""
    g = n_generations(spark, d).where("n_generations > 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_generations") - 1)).alias("generation"))
    return S.availability(_episode_ids(spark, d), g.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "generation"), 10, 3)


def train_val_test_ranges(spark, d):
    """The same windows as ranges, one row per generation."""
    g = n_generations(spark, d).where("n_generations > 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_generations") - 1)).alias("generation"))
    return S.availability_ranges(g, 10, 3)


def fold_membership(spark, d):
    return S.fold_membership(table(spark, d, "orders").select(F.col("o_orderkey").alias("series")).distinct(), "series", 1000)


def n_generations(spark, d):
    return _episode_ids(spark, d).agg((F.count("*") - 10 - 3 - 1).alias("n_generations"))


def kfold_assign(spark, d):
    return S.folds(table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("series")), "series", 5)


def loo_assign(spark, d):
    return S.folds(table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("series")), "series", 1)


def _naive(spark, d):
    e = S.episodes(events(spark, d), "user_id", "t", EPISODE)
    return S.neighbours(e, "episode_id", "step", {"before": ("value", -1)})


def naive_errors(spark, d):
    e = _naive(spark, d).where("before IS NOT NULL").withColumn("output", F.lit("value"))
    x = M.episode_errors(e, "episode_id", "output", "value", "before")
    return x.select("episode_id", r("mse", 4).alias("mse"), r("mae").alias("mae"))


def naive_worst_episodes(spark, d):
    e = _naive(spark, d).where("before IS NOT NULL").withColumn("output", F.lit("value"))
    x = M.episode_errors(e, "episode_id", "output", "value", "before")
    return x.orderBy(F.col("mse").desc(), "episode_id").limit(5).select("episode_id", r("mse", 4).alias("mse"), r("mae").alias("mae"))


def dataset_error(spark, d):
    e = _naive(spark, d).where("before IS NOT NULL").withColumn("output", F.lit("value"))
    x = M.dataset_error(M.episode_errors(e, "episode_id", "output", "value", "before"))
    return x.select(r("mse", 4).alias("mse"), r("mae").alias("mae"), "n_episodes")


def multi_output_error(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.explode(F.array(
        F.struct(F.lit("qty").alias("output"), F.col("l_quantity").alias("y"), F.lit(25.0).alias("p")),
        F.struct(F.lit("tax").alias("output"), (F.col("l_tax") * 100).alias("y"), F.lit(4.0).alias("p")))).alias("o")).select("l_orderkey", "o.*")
    x = M.episode_errors(li, "l_orderkey", "output", "y", "p")
    return x.select("l_orderkey", r("mse").alias("mse"), r("mae").alias("mae"))


def softmax_loss(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 10)).alias("k", "score"), "label")
    x = e.select("vec_id", F.col("score").cast("double").alias("score"), F.when(F.col("k") == F.col("label") % 10, 1.0).otherwise(0.0).alias("y"))
    return M.softmax_cross_entropy(x, ["vec_id"], "score", "y").select("vec_id", r("cross_entropy", 5).alias("cross_entropy"))


def naive_wins(spark, d):
    e = _naive(spark, d).withColumn("m", F.lit(50.0))
    return M.naive_comparison(e, "episode_id", "value", "before", "m").select(
        "episode_id", r("naive_mse", 4).alias("naive_mse"), r("model_mse", 4).alias("model_mse"), "winner")


def running_wins(spark, d):
    return M.running_wins(naive_wins(spark, d).select("episode_id", "winner"), "episode_id")


def running_best(spark, d):
    x = M.running_best(events(spark, d), "user_id", ["t"], "value", F.floor(F.col("t") / S.BLOCK))
    return x.select("user_id", "t", r("best_so_far").alias("best_so_far"))


def prediction_frame(spark, d):
    x = M.prediction_frame(events(spark, d).withColumn("p", F.lit(50.0)), "user_id", "t", "value", "p")
    return x.select("user_id", "t", r("expected").alias("expected"), r("naive").alias("naive"), "predicted")


def prediction_by_rank(spark, d):
    """One prediction column per rank of a user's events of a day, as a population's prediction file has one per genome."""
    from pyspark.sql import Window

    e = events(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    e = e.withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy(F.col("value").desc(), "event_id"))).where("k <= 3")
    wide = M.wide_by_rank(e, "day", "k", "value", [1, 2, 3])
    return wide.select("day", *[r(f"genome_{k}").alias(f"genome_{k}") for k in (1, 2, 3)])


def multi_offset_alignment(spark, d):
    e = events(spark, d)
    x = S.neighbours(e, "user_id", "t", {f"ahead_{k}": ("value", -k) for k in (1, 2, 4)})
    return x.select("user_id", "t", *[r(f"ahead_{k}").alias(f"ahead_{k}") for k in (1, 2, 4)])


def delayed_sum(spark, d):
    """A recurrent connection of depth 2 with weight 0.5: value + 0.5 * value two rows before, 0 where there is none."""
    x = S.neighbours(events(spark, d), "user_id", "t", {"late": ("value", -2)})
    return x.select("user_id", "t", r(F.col("value") + 0.5 * F.coalesce("late", F.lit(0.0))).alias("fired"))


def skip_stats(spark, d):
    e = S.number_rows(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.to_date("ts")).withColumn("s", _seconds("ts"))
    x = M.skips(e, "user_id", "t", "s")
    return x.select("user_id", F.col("min_gap").cast("bigint").alias("min_gap"), r("avg_gap").alias("avg_gap"), F.col("max_gap").cast("bigint").alias("max_gap"), r("median_gap").alias("median_gap"))


def merge_runs_clipped(spark, d):
    x = M.merge_runs(table(spark, d, "events"), "event_type", ["ts", "event_id"], "value", F.to_date("ts"))
    return x.select("row_no", r("min_value").alias("min_value"), r("avg_value").alias("avg_value"), r("max_value").alias("max_value"), "n_runs")


def population_statistics(spark, d):
    """Mean over finished genomes, bounds over all, as the search reports them with a sentinel for unfinished ones."""
    avg, lo, hi = M.without_sentinel("best_validation_error", 10_000_000.0)
    g = table(spark, d, "cnn_genome").where("best_validation_error IS NOT NULL AND NOT isnan(best_validation_error)").withColumn("best_validation_error", F.col("best_validation_error").cast("double"))
    return g.groupBy("generation_id").agg(r(avg, 4).alias("avg_error"), r(lo, 4).alias("min_error"), r(hi, 2).alias("max_error"))


def domain_heatmap(spark, d):
    e = table(spark, d, "events").select("event_type", F.pmod(F.datediff(F.to_date("ts"), F.lit("1970-01-01")), F.lit(7)).alias("wd"), "value")
    wide = e.groupBy("event_type").pivot("wd", list(range(7))).agg(F.avg("value"))
    return wide.select("event_type", *[r(F.col(str(k))).alias(f"d{k}") for k in range(7)])


QUERIES = {
    "series_rows": series_rows, "series_stats": series_stats, "series_constant": series_constant, "series_cut": series_cut, "series_project": series_project,
    "global_bounds": global_bounds, "pooled_var": pooled_var, "norm_min_max": _scaled("min_max"), "norm_avg_std_dev": _scaled("avg_std_dev"),
    "norm_avg_var": _scaled("avg_var"), "denorm_min_max": denorm_min_max, "norm_given_bounds": norm_given_bounds, "norm_outside": norm_outside,
    "offset_pairs_1": _pairs(1), "offset_pairs_5": _pairs(5), "shifted_inputs": _pairs(3, True), "lag_corr": lag_corr, "lag_corr_matrix": lag_corr_matrix,
    "episodes_20": episodes_20, "episode_stats": episode_stats, "split_n": split_n, "train_val_test_windows": train_val_test_windows,
    "train_val_test_ranges": train_val_test_ranges, "fold_membership": fold_membership, "n_generations": n_generations, "kfold_assign": kfold_assign, "loo_assign": loo_assign, "naive_errors": naive_errors, "naive_worst_episodes": naive_worst_episodes,
    "dataset_error": dataset_error, "multi_output_error": multi_output_error, "softmax_loss": softmax_loss, "naive_wins": naive_wins, "running_wins": running_wins,
    "running_best": running_best, "prediction_frame": prediction_frame, "prediction_by_rank": prediction_by_rank, "multi_offset_alignment": multi_offset_alignment,
    "delayed_sum": delayed_sum, "skip_stats": skip_stats, "merge_runs_clipped": merge_runs_clipped, "population_statistics": population_statistics,
    "domain_heatmap": domain_heatmap,
}

_E = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events)"
_EP = f"""{_E}, sl AS (SELECT user_id, count(*) // 20 AS k FROM e GROUP BY user_id),
st AS (SELECT user_id, k, coalesce(sum(k) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM sl),
ep AS (SELECT e.*, CAST(f + t // 20 AS BIGINT) AS episode_id, t % 20 AS step FROM e JOIN st USING (user_id) WHERE t // 20 < k)"""
_NV = f"{_EP}, nv AS (SELECT *, lag(value) OVER (PARTITION BY episode_id ORDER BY step) AS before FROM ep)"
_NE = f"{_NV}, er AS (SELECT episode_id, avg((before - value) ** 2) AS mse, avg(abs(before - value)) AS mae FROM nv WHERE before IS NOT NULL GROUP BY episode_id)"


def _scale_sql(expression: str) -> str:
    return f"""WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY event_type)
    SELECT event_id, round({expression}, 6) AS scaled FROM events JOIN b USING (event_type)"""


def _pair_sql(k: int, shifted: bool = False) -> str:
    x = f"lead(round(ln(1 + abs(value)), 9), {k}) OVER w" if shifted else "round(ln(1 + abs(value)), 9)"
    return f"""WITH {_E}, p AS (SELECT user_id, t, value AS x, {x} AS xl, lead(value, {k}) OVER w AS y, lead(t, {k}) OVER w AS nt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t))
    SELECT user_id, t, round(x, 6) AS x_value, round(xl, 6) AS x_log_value, round(y, 6) AS y_value FROM p WHERE nt IS NOT NULL"""


_CORR = f"""WITH {_E}, c AS (SELECT user_id, t, value AS a, CAST(event_id % 97 AS DOUBLE) AS b FROM e),
s AS (SELECT user_id, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb FROM c GROUP BY user_id),
l AS (SELECT c.user_id, k.lag, sum((x.a - ma) * (c.b - mb)) / sqrt(any_value(va) * any_value(vb)) / count(*) AS corr FROM c JOIN (SELECT unnest(range(1, 6)) AS lag) k ON true
JOIN c x ON x.user_id = c.user_id AND x.t = c.t + k.lag JOIN s ON s.user_id = c.user_id GROUP BY c.user_id, k.lag)"""

ORACLES = {
    "series_rows": f"WITH {_E} SELECT user_id, t, event_id FROM e",
    "series_stats": f"""WITH {_E}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY t) AS d FROM e)
    SELECT user_id, count(value) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS avg, round(var_samp(value), 6) AS var,
    round(stddev_samp(value), 6) AS sd, round(min(d), 6) AS min_change, round(max(d), 6) AS max_change FROM d GROUP BY user_id""",
    "series_constant": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 AND min(round(l_tax, 2)) = max(round(l_tax, 2))",
    "series_cut": f"WITH {_E} SELECT user_id, count(*) AS n, round(avg(value), 6) AS avg_value FROM e WHERE t >= 5 AND t < 15 GROUP BY user_id",
    "series_project": f"WITH {_E} SELECT user_id, t, value, CASE WHEN user_id % 3 = 1 THEN 'train' ELSE 'test' END AS role FROM e",
    "global_bounds": "SELECT event_type, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM events GROUP BY event_type",
    "pooled_var": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS avg, round(var_samp(value), 4) AS pooled_var FROM events GROUP BY event_type",
    "norm_min_max": _scale_sql("(value - lo) / (hi - lo)"),
    "norm_avg_std_dev": _scale_sql("(value - m) / sqrt(v) / (greatest(abs(lo - m), abs(hi - m)) / sqrt(v))"),
    "norm_avg_var": _scale_sql("(value - m) / v / greatest((lo - m) / v, (hi - m) / v)"),
    "denorm_min_max": "SELECT event_id, round(value, 6) AS value FROM events",
    "norm_given_bounds": "SELECT event_id, round(value / 500.0::DOUBLE, 6) AS scaled FROM events",
    "norm_outside": "WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE event_type = 'purchase') SELECT count(*) FILTER (value < lo OR value > hi) AS n_outside FROM events, b",
    "offset_pairs_1": _pair_sql(1), "offset_pairs_5": _pair_sql(5), "shifted_inputs": _pair_sql(3, True),
    "lag_corr": f"{_CORR} SELECT user_id, lag, round(corr, 6) AS corr FROM l",
    "lag_corr_matrix": f"{_CORR} SELECT user_id, " + ", ".join(f"round(max(corr) FILTER (lag = {k}), 6) AS lag_{k}" for k in (1, 2, 3)) + " FROM l GROUP BY user_id",
    "episodes_20": f"WITH {_EP} SELECT user_id, t, episode_id, step FROM ep",
    "episode_stats": f"WITH {_EP} SELECT episode_id, count(*) AS n, round(avg(value), 6) AS avg_value FROM ep GROUP BY episode_id",
    "split_n": f"""WITH {_E}, n AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id), b AS (SELECT user_id, k AS slice_no, CAST(floor(k * n / 7) AS BIGINT) AS a, CAST(floor((k + 1) * n / 7) AS BIGINT) AS z
    FROM n, (SELECT unnest(range(0, 7)) AS k)) SELECT e.user_id, slice_no, count(*) AS n, min(t) AS first_t FROM e JOIN b ON e.user_id = b.user_id AND t >= a AND t < z GROUP BY ALL""",
    "train_val_test_windows": f"""WITH {_EP}, i AS (SELECT DISTINCT episode_id FROM ep), n AS (SELECT count(*) AS n FROM i) SELECT g AS generation, episode_id, CASE WHEN episode_id < g + 10 THEN 'train' WHEN episode_id < g + 13 THEN 'validation' ELSE 'test' END AS role
    FROM i JOIN (SELECT unnest(range(0, greatest(n - 14, 0))) AS g FROM n) ON episode_id <= g + 13""",
    "n_generations": f"WITH {_EP} SELECT count(DISTINCT episode_id) - 14 AS n_generations FROM ep",
    "train_val_test_ranges": f"WITH {_EP}, n AS (SELECT count(DISTINCT episode_id) - 14 AS n FROM ep) SELECT g AS generation, g + 10 AS train_past, g + 13 AS validation_past, g + 13 AS test FROM (SELECT unnest(range(0, greatest(n, 0))) AS g FROM n)",
    "fold_membership": "SELECT DISTINCT o_orderkey AS series, o_orderkey // 1000 AS test_fold FROM orders",
    "kfold_assign": "SELECT n_nationkey AS series, f AS fold, CASE WHEN n_nationkey // 5 = f THEN 'test' ELSE 'train' END AS role FROM nation, (SELECT unnest(range(0, 5)) AS f)",
    "loo_assign": "SELECT r_regionkey AS series, f AS fold, CASE WHEN r_regionkey = f THEN 'test' ELSE 'train' END AS role FROM region, (SELECT unnest(range(0, 5)) AS f)",
    "naive_errors": f"WITH {_NE} SELECT episode_id, round(mse, 4) AS mse, round(mae, 6) AS mae FROM er",
    "naive_worst_episodes": f"WITH {_NE} SELECT episode_id, round(mse, 4) AS mse, round(mae, 6) AS mae FROM er ORDER BY er.mse DESC, episode_id LIMIT 5",
    "dataset_error": f"WITH {_NE} SELECT round(avg(mse), 4) AS mse, round(avg(mae), 6) AS mae, count(*) AS n_episodes FROM er",
    "multi_output_error": """SELECT l_orderkey, round(avg((25.0::DOUBLE - l_quantity) ** 2) + avg((4.0::DOUBLE - l_tax * 100) ** 2), 6) AS mse, round(avg(abs(25.0::DOUBLE - l_quantity)) + avg(abs(4.0::DOUBLE - l_tax * 100)), 6) AS mae
    FROM lineitem GROUP BY l_orderkey""",
    "softmax_loss": """WITH x AS (SELECT vec_id, label, k - 1 AS k, CAST(embedding[k] AS DOUBLE) AS s FROM embeddings, (SELECT unnest(range(1, 11)) AS k))
    SELECT vec_id, round(ln(sum(exp(s))) - sum(CASE WHEN k = label % 10 THEN s ELSE 0 END), 5) AS cross_entropy FROM x GROUP BY vec_id""",
    "naive_wins": f"""WITH {_NV} SELECT episode_id, round(avg((value - before) ** 2), 4) AS naive_mse, round(avg((value - 50) ** 2), 4) AS model_mse,
    CASE WHEN avg((value - before) ** 2) < avg((value - 50) ** 2) THEN 'naive' ELSE 'model' END AS winner FROM nv WHERE before IS NOT NULL GROUP BY episode_id""",
    "running_wins": f"""WITH {_NV}, x AS (SELECT episode_id, CASE WHEN avg((value - before) ** 2) < avg((value - 50) ** 2) THEN 'naive' ELSE 'model' END AS winner FROM nv WHERE before IS NOT NULL GROUP BY episode_id)
    SELECT episode_id, winner, CAST(sum((winner = 'naive')::INT) OVER w AS BIGINT) AS naive_wins, CAST(sum((winner = 'model')::INT) OVER w AS BIGINT) AS model_wins FROM x WINDOW w AS (ORDER BY episode_id)""",
    "running_best": f"WITH {_E} SELECT user_id, t, round(min(value) OVER (PARTITION BY user_id ORDER BY t), 6) AS best_so_far FROM e",
    "prediction_frame": f"""WITH {_E}, x AS (SELECT user_id, t, round(value, 6) AS expected, round(lag(value) OVER (PARTITION BY user_id ORDER BY t), 6) AS naive, 50.0::DOUBLE AS predicted FROM e)
    SELECT * FROM x WHERE naive IS NOT NULL""",
    "prediction_by_rank": """WITH x AS (SELECT strftime(ts, '%Y-%m-%d') AS day, value, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY value DESC, event_id) AS k FROM events)
    SELECT day, round(max(value) FILTER (k = 1), 6) AS genome_1, round(max(value) FILTER (k = 2), 6) AS genome_2, round(max(value) FILTER (k = 3), 6) AS genome_3 FROM x GROUP BY day""",
    "multi_offset_alignment": f"WITH {_E} SELECT user_id, t, " + ", ".join(f"round(lag(value, {k}) OVER w, 6) AS ahead_{k}" for k in (1, 2, 4)) + " FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)",
    "delayed_sum": f"WITH {_E} SELECT user_id, t, round(value + 0.5::DOUBLE * coalesce(lag(value, 2) OVER (PARTITION BY user_id ORDER BY t), 0), 6) AS fired FROM e",
    "skip_stats": """WITH g AS (SELECT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, ts FROM events), d AS (SELECT user_id, s - lag(s) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM g)
    SELECT user_id, min(gap) AS min_gap, round(avg(gap), 6) AS avg_gap, max(gap) AS max_gap, round(median(gap), 6) AS median_gap FROM d WHERE gap IS NOT NULL GROUP BY user_id""",
    "merge_runs_clipped": """WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS row_no FROM events), n AS (SELECT min(k) AS k FROM (SELECT max(row_no) AS k FROM x GROUP BY event_type))
    SELECT row_no, round(min(value), 6) AS min_value, round(avg(value), 6) AS avg_value, round(max(value), 6) AS max_value, count(*) AS n_runs FROM x, n WHERE row_no <= k GROUP BY row_no""",
    "population_statistics": """SELECT generation_id, round(avg(CASE WHEN best_validation_error::DOUBLE <> 10000000 THEN best_validation_error::DOUBLE END), 4) AS avg_error, round(min(best_validation_error::DOUBLE), 4) AS min_error,
    round(max(best_validation_error::DOUBLE), 2) AS max_error FROM cnn_genome WHERE best_validation_error IS NOT NULL AND NOT isnan(best_validation_error) GROUP BY generation_id""",
    "domain_heatmap": "WITH x AS (SELECT event_type, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) % 7 AS INT) AS wd, value FROM events) SELECT event_type, "
    + ", ".join(f"round(avg(value) FILTER (wd = {k}), 6) AS d{k}" for k in range(7)) + " FROM x GROUP BY event_type",
}
