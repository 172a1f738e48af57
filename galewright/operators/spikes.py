"""Implausible spikes, impossible and stuck values of measurements, per source (problem 1).

Each source's readings are cut into time blocks of bounded size with a margin on both sides, by counts per time bucket, so that a source that
holds a third of all rows is spread like any other. In a block, each field's course is decomposed robustly: running medians give the
trend, medians per hour of the day of what is left give the season. A companion signal that sees the same physics (a second sensor, or
the torque for the power) is one more regressor, wherever it is there and makes the remainder narrower. Remainders beyond generalised extreme studentised
deviate limits, with centre and scale (median and MAD) taken anew at each step, that last no longer than ``longest`` readings are spikes. Constant
runs and physical ranges are checked apart.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galewright.session import cut_lineage


@dataclass(frozen=True)
class Field:
    """How one measurement is checked. ``companion`` names columns, the first one that is there wins; with ``scaled``
    it is brought to the field's unit by their median ratio in the block. ``least`` is the smallest departure that
    counts; with ``relative`` it and the limits are shares of the source's own full range (the 99.9 % point of its scaled
    companion, or of itself where a source has no companion)."""

    name: str
    companion: tuple[str, ...]
    least: float
    low: float
    high: float
    scaled: bool = False
    relative: bool = False


def t_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Student's t quantiles: exact for 1, 2 and 4 degrees of freedom, by the Cornish-Fisher expansion around the normal quantile from 5
    on; 3 takes the geometric mean of 2 and 4."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    z = np.array([NormalDist().inv_cdf(x) for x in p.ravel()]).reshape(p.shape)
    d = np.maximum(df, 5.0)
    g1, g2 = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    out = z + g1 / d + g2 / d**2 + g3 / d**3
    a = 4 * p * (1 - p)
    two = (2 * p - 1) * np.sqrt(2 / a)
    four = np.sign(p - 0.5) * 2 * np.sqrt(np.maximum(0.0, np.cos(np.arccos(np.sqrt(a)) / 3) / np.sqrt(a) - 1))
    for n, value in ((1, np.tan(np.pi * (p - 0.5))), (2, two), (3, np.sign(p - 0.5) * np.sqrt(np.abs(two * four))), (4, four)):
        out = np.where(np.round(df) == n, value, out)
    return out


@functools.lru_cache(maxsize=512)
def gesd_limits(n: int, steps: int, alpha: float) -> np.ndarray:
    """The limit of each step's greatest deviation over its scale, for n values."""
    i = np.arange(1, steps + 1)
    t = t_quantile(1 - alpha / (2 * (n - i + 1)), n - i - 1.0)
    return (n - i) * t / np.sqrt((n - i - 1 + t * t) * (n - i + 1))


def _mad(x: list[float], lo: int, hi: int, centre: float) -> float:
    """The median distance of the sorted values x[lo:hi] from their centre, by bisection over how many of the nearest lie below it."""
    n = hi - lo
    k = (n + 1) // 2
    # The k nearest values are a window of k; it begins where the distances at its two ends balance.
    a, b = lo, hi - k
    while a < b:
        m = (a + b) // 2
        if centre - x[m] > x[m + k] - centre:
            a = m + 1
        else:
            b = m
    return max(centre - x[a], x[a + k - 1] - centre)


def gesd(remainder: np.ndarray, alpha: float = 0.01, floor: float = 1e-9, least: float = 0.0) -> np.ndarray:
    """Marks outliers by the generalised ESD test: at each step the value furthest from the centre is taken off and centre and scale
    are taken anew; the last step whose deviation is beyond its limit tells how many outliers there are. Centre and scale are median and
    MAD, so up to half of the values may be outliers. Fewer than 3 values aren't tested; NaN is never marked.

    The furthest value is an end of the sorted values, so a step costs a bisection. ``floor`` is the least scale; steps end where no value
    is further than ``least`` from the centre, if a departure must be greater than that to count.
    """
    ok = np.nonzero(np.isfinite(remainder))[0]
    n, out = len(ok), np.zeros(len(remainder), bool)
    steps = min(n // 2, n - 2)
    if steps < 1:
        return out
    order = np.argsort(remainder[ok], kind="stable")
    x = remainder[ok][order].tolist()
    limits = gesd_limits(n, steps, alpha)
    lo, hi, last, taken = 0, n, 0, []
    for i in range(steps):
        m = (lo + hi) // 2
        centre = x[m] if (hi - lo) % 2 else (x[m - 1] + x[m]) / 2
        below, above = centre - x[lo], x[hi - 1] - centre
        far = max(below, above)
        if far <= least:
            break
        if far > limits[i] * max(1.4826 * _mad(x, lo, hi, centre), floor):
            last = i + 1
        if below > above:
            taken.append(lo)
            lo += 1
        else:
            hi -= 1
            taken.append(hi)
    out[ok[order[taken[:last]]]] = True
    return out


def running_median(x: np.ndarray, window: int) -> np.ndarray:
    return pd.Series(x).rolling(window, center=True, min_periods=1).median().to_numpy()


def decompose(y: np.ndarray, hour: np.ndarray, window: int, least_season: int = 5) -> np.ndarray:
    """The remainder after a robust trend and a robust daily season; hours of fewer than ``least_season`` values have none."""
    rest = y - running_median(y, window)
    by_hour = pd.Series(rest).groupby(hour)
    season = by_hour.median().where(by_hour.count() >= least_season).reindex(range(24)).fillna(0.0).to_numpy()
    return rest - season[hour]


def spread_of(x: np.ndarray) -> float:
    """The MAD of the finite values; infinite for none."""
    x = x[np.isfinite(x)]
    return float(np.median(np.abs(x - np.median(x)))) if len(x) else np.inf


def constant_runs(x: np.ndarray, timed: np.ndarray, length: int) -> np.ndarray:
    """Marks all but the first of at least ``length`` exactly equal values in a row, not 0. NaN neither ends nor
    lengthens a run; values without a time of their own don't either, and are marked inside a run of their value."""
    at = np.nonzero(timed & ~np.isnan(x))[0]
    out = np.zeros(len(x), bool)
    if not len(at):
        return out
    v = x[at]
    start = np.r_[True, v[1:] != v[:-1]]
    run = np.cumsum(start) - 1
    long = (np.bincount(run)[run] >= length) & (v != 0)
    out[at[long & ~start]] = True
    loose = np.nonzero(~timed & ~np.isnan(x))[0]
    if len(loose) and long.any():
        before = np.searchsorted(at, loose) - 1
        for i, b in zip(loose, before):
            out[i] = any(0 <= k < len(at) and long[k] and v[k] == x[i] for k in (b, b + 1))
    return out


def _run_lengths(mask: np.ndarray) -> np.ndarray:
    """For each marked position the number of marked ones in a row."""
    out = np.zeros(len(mask), int)
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]):
        out[a:b] = b - a
    return out


def check_block(pdf: pd.DataFrame, fields: list[Field], window: int, longest: int, constant: int, alpha: float) -> np.ndarray:
    """A matrix (rows, fields) of marks for one block with columns t, timed, full and the signals; rows in any order."""
    marks = np.zeros((len(pdf), len(fields)), bool)
    minute = (pdf["__t"].to_numpy() // 60).astype(np.int64)
    for j, f in enumerate(fields):
        value = pdf[f.name].to_numpy(float)
        # A repeated reading stands there once: same minute, same value.
        frame = pd.DataFrame({"m": minute, "v": value, "t": pdf["__t"].to_numpy(), "timed": pdf["__timed"].to_numpy(bool)})
        frame = frame.sort_values(["t", "timed"], kind="stable")
        key = frame.groupby(["m", "v"], dropna=False, sort=False).ngroup().to_numpy()
        first = np.r_[np.unique(key, return_index=True)[1]]
        order = frame.index.to_numpy()[first]
        x, t = value[order], pdf["__t"].to_numpy()[order]
        timed = pdf["__timed"].to_numpy(bool)[order]
        companion = np.full(len(x), np.nan)
        for c in f.companion:
            other = pdf[c].to_numpy(float)[order]
            companion = np.where(np.isnan(companion), other, companion)
        unit, ratio = 1.0, 1.0
        if f.scaled:
            strong = np.abs(companion) > 0.05 * np.nanmax(np.abs(companion), initial=0.0)
            ratios = (x / np.where(companion == 0, np.nan, companion))[strong]
            ratios = ratios[np.isfinite(ratios)]
            ratio = float(np.median(ratios)) if len(ratios) else 1.0
            companion = companion * ratio
        if f.relative:  # the companion's full range, or the field's own where the source has no companion
            full = pdf[f"__full_{f.name}"].to_numpy(float)[:1] * ratio
            own = pdf[f"__own_{f.name}"].to_numpy(float)[:1]
            unit = next((abs(float(v)) for v in (*full, *own) if np.isfinite(v) and v != 0), np.inf)
        hour = ((t // 3600) % 24).astype(int)
        rest = decompose(x, hour, window)
        # The companion takes part where it is there, if it explains more than trend and season do.
        beside = ~np.isnan(companion) & ~np.isnan(x)
        if beside.any():
            smooth = running_median(x, window)
            explained = decompose(x - np.where(beside, companion, smooth), hour, window)
            if spread_of(explained[beside]) <= spread_of(rest[beside]):
                rest = np.where(beside, explained, rest)
            else:
                beside[:] = False
        depart, floor = (f.least * unit, f.least * unit / 20) if np.isfinite(unit) else (np.inf, f.least)
        with np.errstate(invalid="ignore"):
            apart = np.abs(rest) > depart
            spike = np.zeros(len(x), bool)
            for part in (beside, ~beside):  # each with its own scale
                if apart[part].any():
                    spike[part] = gesd(rest[part], alpha, floor, depart / 2)
            spike &= apart
            beyond = (x < f.low * unit) | (x > f.high * unit)
            if f.relative:  # the full range is only what was seen: a companion that goes along speaks for the value
                beyond &= ~(np.abs(x - companion) <= f.least * unit)
        spike &= _run_lengths(spike & ~np.isnan(x)) <= longest
        found = (spike | beyond | constant_runs(x, timed, constant)) & ~np.isnan(x)
        marks[frame.index.to_numpy(), j] = found[key]
    return marks


def implausible_values(
    df: DataFrame, row_id: str, source: str, instant: str, fields: list[Field], fallback_instant: str | None = None, block_rows: int = 4000,
    window: int = 11, longest: int = 3, constant: int = 7, alpha: float = 0.01, bucket_s: int = 21_600,
) -> DataFrame:
    """``(row_id, field)`` of every implausible value.

    ``instant`` and ``fallback_instant`` are seconds; a row without ``instant`` is placed by the fallback and can be a
    spike or out of range, but neither ends nor lengthens a constant run. Rows without any time are spread over blocks of their own; rows
    without source form one source. Null and NaN values are never marked. Repeats of a reading (same
    minute and value) count once in the series and are all marked. Sources with fewer than 3 readings get only the
    range and constant-run checks. An empty table gives no rows; further columns are ignored.

    The needed columns are written to the shared folder once. Blocks are about ``block_rows`` rows of a source in the order of time: rows are
    counted per bucket of ``bucket_s`` seconds and lie evenly within it, so one wrong date makes a block of its own and no block longer.
    """
    companions = sorted({c for f in fields for c in f.companion} | {f.name for f in fields})
    own = F.col(instant).cast("bigint")
    at = F.coalesce(own, F.col(fallback_instant).cast("bigint")) if fallback_instant else own
    numbers = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in companions]
    rows = cut_lineage(df.select(F.col(row_id).alias("__id"), F.col(source).alias("__s"), at.alias("__t"), own.isNotNull().alias("__timed"), *numbers))
    rows = rows.withColumn("__bucket", F.floor(F.col("__t") / bucket_s))
    counts = rows.groupBy("__s", "__bucket").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__s").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket of time
    before = F.when(F.col("__bucket").isNotNull(), F.coalesce(F.sum(F.when(F.col("__bucket").isNotNull(), F.col("__n"))).over(earlier), F.lit(0)))
    stats = counts.withColumn("__before", before)
    names = [f.name for f in fields]
    relative = [f for f in fields if f.relative]
    if relative:
        high = lambda c: F.percentile_approx(F.abs(c), F.lit(0.999), F.lit(2000))
        full = [x for f in relative for x in (high(F.coalesce(*f.companion)).alias(f"__full_{f.name}"), high(F.col(f.name)).alias(f"__own_{f.name}"))]
        per_source = rows.groupBy("__s").agg(*full).withColumnRenamed("__s", "__s1")
        stats = stats.join(per_source, F.col("__s").eqNullSafe(F.col("__s1"))).drop("__s1")
    stats = stats.withColumnsRenamed({"__s": "__s2", "__bucket": "__bucket2"})
    joined = rows.join(stats, F.col("__s").eqNullSafe(F.col("__s2")) & F.col("__bucket").eqNullSafe(F.col("__bucket2"))).drop("__s2", "__bucket2")
    within = (F.col("__t") - F.col("__bucket") * bucket_s) / float(bucket_s)
    spread_out = F.pmod(F.xxhash64(F.col("__id").cast("string")), F.ceil(F.col("__n") / block_rows).cast("bigint")) + 0.5
    place = F.coalesce((F.col("__before") + F.col("__n") * within) / float(block_rows), -1.0 - spread_out)
    placed = joined.withColumns({"__p": place, "__t": F.coalesce("__t", F.lit(0).cast("bigint"))}).drop("__n", "__before", "__bucket")
    part, margin = F.col("__p") - F.floor("__p"), 0.05
    shifts = F.filter(F.array(F.lit(0), F.when((part < margin) & (F.col("__p") >= 1), -1), F.when((part >= 1 - margin) & (F.col("__p") >= 0), 1)), lambda k: k.isNotNull())
    spread = placed.select("*", F.explode(shifts).alias("__k")).withColumn("__block", F.floor("__p") + F.col("__k")).drop("__p")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        marks = check_block(pdf, fields, window, longest, constant, alpha) & (pdf["__k"].to_numpy() == 0)[:, None]
        r, c = np.nonzero(marks)
        return pd.DataFrame({row_id: pdf["__id"].to_numpy()[r], "field": np.array(names, dtype=object)[c]})

    kind = dict(rows.dtypes)["__id"]
    return spread.groupBy("__s", "__block").applyInPandas(check, f"`{row_id}` {kind}, field string")
