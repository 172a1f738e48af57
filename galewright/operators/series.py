"""Time-series operators over a long frame: a series column, an order, and parameter columns.

Order within a series is explicit: `number_rows` gives each row its place ``t``. Neither it nor the operators by
neighbours gather a series into one task: rows are numbered per time bucket and moved by the counts of earlier buckets,
and neighbours are looked up in blocks of ``t`` that share ``k`` rows with the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galewright.operators.prefix import key_bucket, running

BLOCK = 1_000_000
ID_BLOCK = 1024


def number_rows(df: DataFrame, series: str, order: Sequence[str], bucket: Column, t: str = "t") -> DataFrame:
    """``df`` with the row's place in its series, from 0. ``bucket`` must rise with ``order``; ties of ``order`` get an
    arbitrary order, so give columns that make it unique. A column named ``t`` is replaced."""
    counted = running(df.drop(t), [series], list(order), bucket, F.lit(1), t)
    return counted.withColumn(t, (F.col(t) - 1).cast("bigint"))


def neighbours(df: DataFrame, series: str, t: str, columns: dict[str, tuple[str, int]], block: int = BLOCK) -> DataFrame:
    """``df`` with columns ``{name: (source, k)}`` that hold the source k rows later (earlier for negative k), null
    beyond the series' ends."""
    ahead = max([0, *(k for _, k in columns.values())])
    behind = max([0, *(-k for _, k in columns.values())])
    own = F.floor(F.col(t) / block)
    shown = F.array(own, F.when((F.pmod(F.col(t), F.lit(block)) < ahead) & (own > 0), own - 1), F.when(F.pmod(F.col(t), F.lit(block)) >= block - behind, own + 1))
    spread = df.withColumn("__block", F.explode(F.filter(shown, lambda b: b.isNotNull())))
    w = Window.partitionBy(series, "__block").orderBy(t)
    made = {name: F.lead(source, k).over(w) if k >= 0 else F.lag(source, -k).over(w) for name, (source, k) in columns.items()}
    return spread.withColumns(made).where(F.col("__block") == own).drop("__block")


def cut(df: DataFrame, t: str, start: int, stop: int) -> DataFrame:
    """Rows of the half-open range [start, stop) of every series."""
    return df.where((F.col(t) >= start) & (F.col(t) < stop))


def series_stats(df: DataFrame, series: str, t: str, value: str) -> DataFrame:
    """Per series: n, min, max, avg, var (n - 1), sd, and the least and greatest first difference."""
    d = neighbours(df.select(series, t, value), series, t, {"__before": (value, -1)}).withColumn("__d", F.col(value) - F.col("__before"))
    v = F.col(value)
    return d.groupBy(series).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"), F.var_samp(v).alias("var"),
        F.stddev_samp(v).alias("sd"), F.min("__d").alias("min_change"), F.max("__d").alias("max_change"),
    )


def constant_series(stats: DataFrame) -> DataFrame:
    """The series that never change."""
    return stats.where("min_change = 0 AND max_change = 0")


def pooled_stats(stats: DataFrame, group: str | None = None) -> DataFrame:
    """Statistics of several series from their own: mean, ``pooled_var`` = (sum((n-1)var + n(avg-mean)^2))/(N-1), which
    is the variance of the union, and the bounds of all."""
    keys = [group] if group else []
    sums = stats.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.col("avg") * F.col("n")).alias("__s"), F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0)) + F.col("n") * F.col("avg") * F.col("avg")).alias("__q"),
        F.min("min").alias("min"), F.max("max").alias("max"),
    )
    mean = F.col("__s") / F.col("n")
    return sums.select(*keys, "n", "min", "max", mean.alias("avg"), ((F.col("__q") - F.col("n") * mean * mean) / (F.col("n") - 1)).alias("pooled_var"))


def fit_bounds(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), given: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row per key with min_{c}, max_{c}, avg_{c}, var_{c} of each column; bounds that the caller gives win."""
    given = given or {}
    out = []
    for c in columns:
        lo, hi = (F.lit(float(x)) for x in given[c]) if c in given else (F.min(c), F.max(c))
        out += [lo.alias(f"min_{c}"), hi.alias(f"max_{c}"), F.avg(c).alias(f"avg_{c}"), F.var_samp(c).alias(f"var_{c}")]
    return df.groupBy(*keys).agg(*out)


def _scale(c: str, mode: str) -> tuple[Column, Column]:
    """(centre, unit) so that the scaled value is (x - centre) / unit."""
    lo, hi, mean, var = (F.col(f"{k}_{c}") for k in ("min", "max", "avg", "var"))
    if mode == "min_max":
        return lo, hi - lo
    spread = var if mode == "avg_var" else F.sqrt(var)
    reach = F.greatest((lo - mean) / spread, (hi - mean) / spread) if mode == "avg_var" else F.greatest(F.abs(lo - mean), F.abs(hi - mean)) / spread
    return mean, spread * reach


def normalize(df: DataFrame, bounds: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), mode: str = "min_max") -> DataFrame:
    """Scaled columns. ``min_max``: to [0, 1] by the fitted bounds; ``avg_std_dev``: standard scores over the greatest
    absolute one; ``avg_var``: the same with the variance in place of the deviation and the greatest signed score, a
    formula that some published results were made with. A constant column gives null. ``bounds`` is one row per key."""
    joined = df.join(bounds, list(keys)) if keys else df.crossJoin(F.broadcast(bounds))  # one row of bounds
    out = {c: (F.col(c) - a) / F.nullif(u, F.lit(0.0)) for c in columns for a, u in [_scale(c, mode)]}
    return joined.withColumns(out).drop(*[f"{k}_{c}" for c in columns for k in ("min", "max", "avg", "var")])


def denormalize(df: DataFrame, bounds: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), mode: str = "min_max") -> DataFrame:
    """The inverse of `normalize` under the same bounds."""
    joined = df.join(bounds, list(keys)) if keys else df.crossJoin(F.broadcast(bounds))  # one row of bounds
    out = {c: F.col(c) * u + a for c in columns for a, u in [_scale(c, mode)]}
    return joined.withColumns(out).drop(*[f"{k}_{c}" for c in columns for k in ("min", "max", "avg", "var")])


def outside_bounds(df: DataFrame, bounds: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """How many values of each column lie outside of the bounds, per key."""
    joined = df.join(bounds, list(keys)) if keys else df.crossJoin(F.broadcast(bounds))  # one row of bounds
    return joined.groupBy(*keys).agg(*[F.count_if((F.col(c) < F.col(f"min_{c}")) | (F.col(c) > F.col(f"max_{c}"))).alias(c) for c in columns])


def offset_pairs(df: DataFrame, series: str, t: str, inputs: Sequence[str], outputs: Sequence[str], k: int = 1, shifted: Sequence[str] = ()) -> DataFrame:
    """Inputs at t beside outputs at t + k; inputs in ``shifted`` are taken at t + k too. The last k rows go."""
    columns = {f"y_{c}": (c, k) for c in outputs} | {f"x_{c}": (c, k) for c in shifted}
    pairs = neighbours(df, series, t, columns | {"__next": (t, k)}).where(F.col("__next").isNotNull())
    return pairs.select(series, t, *[F.col(f"x_{c}") if c in shifted else F.col(c).alias(f"x_{c}") for c in inputs], *[f"y_{c}" for c in outputs])


def lagged_correlation(df: DataFrame, series: str, t: str, a: str, b: str, lags: Sequence[int]) -> DataFrame:
    """``(series, lag, corr)``: sum((a[t+lag] - mean a)(b[t] - mean b)) / sqrt(var a * var b) / (n - lag), means and
    variances (n - 1) over whole series; 0 where a variance is under 1e-12."""
    stats = df.groupBy(series).agg(*[f(c).alias(f"__{n}{i}") for i, c in enumerate((a, b)) for n, f in (("m", F.avg), ("v", F.var_samp))])
    wide = neighbours(df.select(series, t, a, b), series, t, {f"__a{k}": (a, k) for k in lags}).join(stats, series)
    # Sums of products per lag are partial aggregates over all blocks; centred values keep them small.
    centred = F.col(b) - F.col("__m1")
    sums = [F.sum((F.col(f"__a{k}") - F.col("__m0")) * centred).alias(f"__s{k}") for k in lags] + [F.count(f"__a{k}").alias(f"__n{k}") for k in lags]
    per = wide.groupBy(series, "__v0", "__v1").agg(*sums)
    cells = F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"), F.col(f"__s{k}").alias("__sum"), F.col(f"__n{k}").alias("__n")) for k in lags])
    cell = per.select(series, "__v0", "__v1", F.inline(cells)).where("__n > 0")
    flat = (F.col("__v0") < 1e-12) | (F.col("__v1") < 1e-12)
    return cell.select(series, "lag", F.when(flat, 0.0).otherwise(F.col("__sum") / F.sqrt(F.col("__v0") * F.col("__v1")) / F.col("__n")).alias("corr"))


def episodes(df: DataFrame, series: str, t: str, length: int, episode: str = "episode_id") -> DataFrame:
    """Rows cut into episodes of ``length``; a series' remainder goes. Ids run on over series and slices."""
    sized = df.groupBy(series).agg((F.floor((F.max(t) + 1) / length)).alias("__slices"))
    counted = running(sized.withColumn("__all", F.lit(1)), ["__all"], [series], key_bucket(sized, series), F.col("__slices"), "__first").drop("__all")
    starts = counted.withColumn("__first", F.col("__first") - F.col("__slices"))
    slice_no = F.floor(F.col(t) / length)
    out = df.join(starts, series).where(slice_no < F.col("__slices"))
    return out.withColumn(episode, (F.col("__first") + slice_no).cast("bigint")).withColumn("step", (F.col(t) - slice_no * length).cast("bigint")).drop("__slices", "__first")


def split_slices(df: DataFrame, series: str, t: str, n: int, name: str = "slice_no") -> DataFrame:
    """Each series in ``n`` nearly equal slices; slice i begins at floor(i * rows / n)."""
    sized = df.groupBy(series).agg(F.count("*").alias("__rows"))
    guess = F.floor((F.col(t) + 1) * n / F.col("__rows"))
    begins = lambda i: F.floor(i * F.col("__rows") / n)
    exact = F.when(begins(guess) <= F.col(t), guess).otherwise(guess - 1)
    return df.join(sized, series).withColumn(name, F.least(exact, F.lit(n - 1)).cast("bigint")).drop("__rows")


def availability(episode_ids: DataFrame, generations: DataFrame, train: int, validation: int, episode: str = "episode_id", generation: str = "generation") -> DataFrame:
    """``(generation, episode, role)``: with c = generation + train, episodes before c train, the next ``validation``
    ones validate, the one after tests. A range predicate per generation, over the ids that exist.

    Ids travel as runs without gaps, cut into blocks; a window's rows are made from them last of all, in the partitions of ``generations``, so that nothing
    that grows with the windows is shuffled or sorted. Blocks that repeat from generation to generation keep files small."""
    c = (F.col(generation) + train).cast("bigint")
    runs = episode_ids.select(F.col(episode).cast("bigint").alias("__id")).where("__id >= 0").distinct().withColumn("__block", F.floor(F.col("__id") / ID_BLOCK))
    place = F.row_number().over(Window.partitionBy("__block").orderBy("__id"))
    runs = runs.withColumn("__run", F.col("__id") - place).groupBy("__block", "__run").agg(F.min("__id").alias("first"), F.max("__id").alias("last"))
    row = runs.agg(F.collect_list(F.struct("first", "last")).alias("__runs"))
    parts = generations.select(generation, c.alias("__c")).crossJoin(F.broadcast(row))  # one row
    parts = parts.select(generation, "__c", F.inline(F.filter("__runs", lambda x: x["first"] <= F.col("__c") + validation))).sortWithinPartitions("first", generation)
    wanted = parts.select(generation, "__c", F.explode(F.sequence("first", F.least("last", F.col("__c") + validation))).alias(episode))
    role = F.when(F.col(episode) < F.col("__c"), "train").when(F.col(episode) < F.col("__c") + validation, "validation").otherwise("test")
    return wanted.select(generation, episode, role.alias("role"))


def availability_ranges(generations: DataFrame, train: int, validation: int, generation: str = "generation") -> DataFrame:
    """The same windows as one row per generation: ``train_past`` (episodes from 0 before it train), ``validation_past`` (from there on before it validate) and
    ``test``, the one after. Rows grow with the generations only."""
    c = (F.col(generation) + train).cast("bigint")
    return generations.select(generation, c.alias("train_past"), (c + validation).alias("validation_past"), (c + validation).alias("test"))


def fold_membership(series_ids: DataFrame, series: str, fold_size: int) -> DataFrame:
    """The fold in which each series tests; it trains in all others. One row per series."""
    return series_ids.select(series, F.floor(F.col(series) / fold_size).cast("bigint").alias("test_fold"))


def folds(series_ids: DataFrame, series: str, fold_size: int) -> DataFrame:
    """Fold of each series and its role when each fold in turn is held out. ``fold_size`` 1 leaves one out."""
    own = series_ids.select(series, F.floor(F.col(series) / fold_size).alias("own"))
    n = series_ids.agg(F.ceil((F.max(series) + 1) / fold_size).alias("n"))
    out = own.crossJoin(F.broadcast(n)).select(series, "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("fold"))  # one row
    return out.select(series, "fold", F.when(F.col("own") == F.col("fold"), "test").otherwise("train").alias("role"))
