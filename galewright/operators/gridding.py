"""Irregular readings onto a regular grid (problem 6).

Compact-kernel weighted local polynomial regression: a reading lies within the kernel of a bounded number of grid times
around it, so it is sent to just these slots with its weighted moments. The moments are summed per (source, slot) with
map-side combining, and each slot solves its small system in closed form. The grid itself is made from each
source's first and last filled slot, day by day; no source is ever gathered into one task. Slots are empty where the
kernel has no weight inside them, and estimates are marked missing where their effective support is too small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewright.operators.timestamps import bind


def _intercept(s: list[Column], t: list[Column], degree: int) -> Column:
    """The local polynomial at the grid time from the sums of w x^k (``s``) and w x^k y (``t``): of the given degree, or of a lower one
    where the readings don't determine it: a line needs times that spread over 3 % of the bandwidth, or it would be drawn through noise."""
    w = F.nullif(s[0], F.lit(0.0))
    out = t[0] / w
    if degree >= 1:
        d = s[0] * s[2] - s[1] * s[1]
        out = F.when(d > 1e-3 * s[0] * s[0], (s[2] * t[0] - s[1] * t[1]) / d).otherwise(out)
    if degree >= 2:
        a, b, c = s[2] * s[4] - s[3] * s[3], s[1] * s[4] - s[2] * s[3], s[1] * s[3] - s[2] * s[2]
        d = s[0] * a - s[1] * b + s[2] * c
        out = F.when(d > 1e-6 * s[0] * s[0] * s[0], (a * t[0] - b * t[1] + c * t[2]) / d).otherwise(out)
    return out


def regular_grid(
    df: DataFrame, source: str, instant: str, values: list[str], step: int = 600, bandwidth: int = 1500, min_support: float = 1.5, degree: int = 1
) -> DataFrame:
    """One row per source and slot of ``step`` seconds between the source's first and last filled slot.

    ``slot_s`` is the slot's start (a multiple of ``step``), ``n`` the readings in it, ``support`` the effective number of readings
    (sum of weights squared over sum of squared weights) less than ``bandwidth`` seconds from the slot's middle by tricube weights;
    ``is_empty`` marks slots inside which the kernel has no weight. Each of ``values`` is estimated at the slot's middle by a local polynomial of
    ``degree`` 0, 1 or 2 (lower where the readings don't determine it); ``{value}_support`` is its own effective support,
    ``{value}_missing`` marks values without enough of it: under ``min_support``, unless the slot holds a reading of it. They are null. Rows without
    source or instant don't count, null and NaN values carry no weight. A repeated reading weighs as often as it stands
    there. An empty table gives an empty grid.

    The grid has as many rows as the time between a source's first and last reading has slots: one reading with a wrong
    year lengthens it by that many years, in days that are spread over all tasks.
    """
    if degree not in (0, 1, 2):
        raise ValueError("degree must be 0, 1 or 2")
    half = step // 2
    reach = -(-(bandwidth + half) // step)
    t = F.col("__t")
    rows = df.where(F.col(source).isNotNull() & F.col(instant).isNotNull()).select(
        F.col(source).alias("__s"), F.col(instant).cast("bigint").alias("__t"), *[F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(values)]
    )
    own = (t - F.pmod(t, F.lit(step))).alias("__own")
    spread = rows.select("*", own).select("*", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("__k"))
    placed = spread.select(
        "__s", (F.col("__own") + F.col("__k") * step).cast("bigint").alias("__slot"), (F.col("__k") == 0).alias("__in"),
        ((t - F.col("__own") - F.col("__k") * step - half) / float(bandwidth)).alias("__x"), *[f"__v{i}" for i in range(len(values))],
    ).where((F.abs("__x") < 1) | F.col("__in"))
    x = F.col("__x")
    tricube = F.pow(1 - F.pow(F.least(F.abs(x), F.lit(0.999)), 3), 3)
    sums: dict[str, Column] = {"__n": F.count_if("__in"), "__inside": F.sum(F.when(F.col("__in"), tricube).otherwise(0.0)), "__w": F.sum(tricube), "__ww": F.sum(tricube * tricube)}
    for i in range(len(values)):
        v = F.col(f"__v{i}")
        w = F.when(v.isNotNull() & ~F.isnan(v), tricube)
        sums |= {f"__ww{i}": F.sum(w * w), f"__in{i}": F.count_if(F.col("__in") & w.isNotNull())}
        sums |= {f"__s{i}_{k}": F.sum(w * F.pow(x, F.lit(k)) if k else w) for k in range(2 * degree + 1)}
        sums |= {f"__t{i}_{k}": F.sum(w * F.pow(x, F.lit(k)) * v if k else w * v) for k in range(degree + 1)}
    summed = placed.groupBy("__s", "__slot").agg(*[c.alias(k) for k, c in sums.items()])
    # Worked out once: the grid and the join read the same sums, because nothing is pushed or pruned through the binding.
    slots = bind(summed, **{f"__k{k}": F.col(k) for k in ("__s", "__slot", *sums)}).select(*[F.col(f"__k{k}").alias(k) for k in ("__s", "__slot", *sums)])
    span = slots.where("__inside > 0").groupBy("__s").agg(F.min("__slot").alias("__a"), F.max("__slot").alias("__b"))
    per_day = 86400 - 86400 % step if step <= 86400 else step
    days = span.select("*", F.explode(F.sequence("__a", "__b", F.lit(per_day).cast("bigint"))).alias("__d")).repartition("__s", "__d")
    last = F.least(F.col("__b"), F.col("__d") + per_day - step)
    grid = days.select("__s", F.explode(F.sequence(F.col("__d"), last, F.lit(step).cast("bigint"))).alias("__slot"))
    joined = grid.join(slots, ["__s", "__slot"], "left")
    effective = lambda w, ww: F.coalesce(w * w / F.nullif(ww, F.lit(0.0)), F.lit(0.0))
    n = F.coalesce(F.col("__n"), F.lit(0).cast("bigint"))
    out = [F.col("__s").alias(source), F.col("__slot").alias("slot_s"), n.alias("n"), effective(F.col("__w"), F.col("__ww")).alias("support"), ~F.coalesce(F.col("__inside") > 0, F.lit(False))]
    out[-1] = out[-1].alias("is_empty")
    for i, v in enumerate(values):
        support = effective(F.col(f"__s{i}_0"), F.col(f"__ww{i}"))
        enough = F.coalesce((support >= min_support) | (F.col(f"__in{i}") > 0), F.lit(False))
        value = _intercept([F.col(f"__s{i}_{k}") for k in range(2 * degree + 1)], [F.col(f"__t{i}_{k}") for k in range(degree + 1)], degree)
        out += [F.when(enough, value).alias(v), support.alias(f"{v}_support"), (~enough).alias(f"{v}_missing")]
    return joined.select(*out)
