"""Errors of forecasts, comparisons of runs, and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galewright.operators.prefix import key_bucket, numbered, running
from galewright.operators.series import neighbours


def episode_errors(df: DataFrame, episode: str, output: str, expected: str, predicted: str) -> DataFrame:
    """Per episode: mse and mae as the sum over outputs of the mean over time."""
    d = F.col(predicted) - F.col(expected)
    per_output = df.groupBy(episode, output).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"))
    return per_output.groupBy(episode).agg(F.sum("mse").alias("mse"), F.sum("mae").alias("mae"))


def dataset_error(errors: DataFrame) -> DataFrame:
    """The mean over episodes."""
    return errors.agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), F.count("*").alias("n_episodes"))


def softmax_cross_entropy(df: DataFrame, at: Sequence[str], score: str, expected: str) -> DataFrame:
    """Cross entropy of softmax scores summed over outputs, per ``at``. Stable: log-sum-exp around the greatest score."""
    top = df.groupBy(*at).agg(F.max(score).alias("__top"))
    j = df.join(top, list(at))
    e = j.groupBy(*at, "__top").agg(
        F.log(F.sum(F.exp(F.col(score) - F.col("__top")))).alias("__lse"), F.sum(F.col(expected) * F.col(score)).alias("__dot"), F.sum(expected).alias("__mass")
    )
    return e.select(*at, (F.col("__mass") * (F.col("__lse") + F.col("__top")) - F.col("__dot")).alias("cross_entropy"))


def naive_comparison(df: DataFrame, group: str, expected: str, before: str, predicted: str) -> DataFrame:
    """Mean squared error of the value before and of a model, over rows that have a value before, and who won."""
    naive, model = F.col(expected) - F.col(before), F.col(expected) - F.col(predicted)
    out = df.where(F.col(before).isNotNull()).groupBy(group).agg(F.avg(naive * naive).alias("naive_mse"), F.avg(model * model).alias("model_mse"))
    return out.withColumn("winner", F.when(F.col("naive_mse") < F.col("model_mse"), "naive").otherwise("model"))


def running_wins(df: DataFrame, generation: str, winner: str = "winner") -> DataFrame:
    """Wins of the naive forecast and of the model up to each generation (one row per generation), counted over buckets of generations."""
    out = df.select(generation, winner).withColumn("__all", F.lit(1))
    for who in ("naive", "model"):
        out = running(out, ["__all"], [generation], key_bucket(df, generation), F.when(F.col(winner) == who, 1).otherwise(0), f"{who}_wins")
    return out.select(generation, winner, *[F.col(f"{who}_wins").cast("bigint").alias(f"{who}_wins") for who in ("naive", "model")])


def running_best(df: DataFrame, group: str, order: Sequence[str], value: str, bucket: Column) -> DataFrame:
    """The least value so far; ``bucket`` rises with the order."""
    return running(df, [group], list(order), bucket, F.col(value), "best_so_far", "min")


def track(df: DataFrame, keys: Sequence[str], values: Sequence[str], against: str | None = None) -> DataFrame:
    """Per key and value: min, avg, max, sample sd, and the correlation with ``against``."""
    parts = []
    for v in values:
        parts += [f(v).alias(f"{n}_{v}") for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max), ("sd", F.stddev_samp))]
        if against and v != against:
            parts.append(F.corr(v, against).alias(f"corr_{v}"))
    return df.groupBy(*keys).agg(*parts)


def deviation_ranks(groups: DataFrame, output: str, run_type: str, value: str) -> DataFrame:
    """Run types ranked by their mean standard score: each output's values are standardised over its run types; equal
    means share a rank."""
    w = Window.partitionBy(output)
    z = (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))
    means = groups.withColumn("__z", z).groupBy(run_type).agg(F.avg("__z").alias("mean_z"))
    # Equal means are counted together; a rank is the count of lower ones and one.
    same = means.groupBy(F.round("mean_z", 9).alias("__m")).agg(F.count("*").alias("__n"))
    cuts = numbered(same, "__m", [], "__k").withColumn("__all", F.lit(1))
    ranks = running(cuts, ["__all"], ["__k"], F.floor(F.col("__k") / 65_536), F.col("__n"), "__upto")
    place = (F.col("__upto") - F.col("__n") + 1).cast("bigint").alias("place")
    return means.join(ranks.select("__m", place), F.round("mean_z", 9).eqNullSafe(F.col("__m"))).drop("__m")


def merge_runs(df: DataFrame, run: str, order: Sequence[str], value: str, bucket: Column) -> DataFrame:
    """Runs laid side by side by row number and clipped to the shortest one: min, avg, max of each row. ``bucket`` rises
    with the order."""
    rows = running(df, [run], list(order), bucket, F.lit(1), "row_no").withColumn("row_no", F.col("row_no").cast("bigint"))
    shortest = df.groupBy(run).agg(F.count("*").alias("__n")).agg(F.min("__n").alias("__n"))
    kept = rows.crossJoin(F.broadcast(shortest)).where(F.col("row_no") <= F.col("__n"))  # one row
    return kept.groupBy("row_no").agg(F.min(value).alias("min_value"), F.avg(value).alias("avg_value"), F.max(value).alias("max_value"), F.count("*").alias("n_runs"))


def skips(df: DataFrame, group: str, t: str, seconds: str) -> DataFrame:
    """Gaps between the times of rows that follow each other by ``t``: min, avg, max and median per group."""
    gaps = neighbours(df.select(group, t, seconds), group, t, {"__before": (seconds, -1)}).withColumn("gap", F.col(seconds) - F.col("__before")).where("gap IS NOT NULL")
    return gaps.groupBy(group).agg(F.min("gap").alias("min_gap"), F.avg("gap").alias("avg_gap"), F.max("gap").alias("max_gap"), F.median("gap").alias("median_gap"))


def without_sentinel(value: str, sentinel: float) -> tuple[Column, Column, Column]:
    """Mean that skips a sentinel, and bounds that don't."""
    return F.avg(F.when(F.col(value) != sentinel, F.col(value))), F.min(value), F.max(value)


def prediction_frame(df: DataFrame, series: str, t: str, expected: str, predicted: str) -> DataFrame:
    """Expected value, naive forecast and prediction from the second row on."""
    out = neighbours(df.select(series, t, expected, predicted), series, t, {"naive": (expected, -1)}).where(F.col("naive").isNotNull())
    return out.select(series, t, F.col(expected).alias("expected"), "naive", F.col(predicted).alias("predicted"))


def wide_by_rank(df: DataFrame, row: str, rank: str, value: str, ranks: Sequence[int], prefix: str = "genome") -> DataFrame:
    """One column per rank; ranks are given, so no pass is spent on finding them."""
    wide = df.groupBy(row).pivot(rank, list(ranks)).agg(F.first(value))
    return wide.select(row, *[F.col(str(r)).alias(f"{prefix}_{r}") for r in ranks])
