"""Running aggregates in two levels: over buckets of the order, and within each bucket.

A window over a whole group would gather the group into one task. Here buckets (any value that rises with the order) are
aggregated first, a window over the few bucket rows gives what stands before each bucket, and rows are only ordered within their bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], bucket: Column, value: Column, name: str, how: str = "sum") -> DataFrame:
    """``df`` with the running ``sum`` or ``min`` of ``value`` over each group up to and with the row. Ties of the order are
    taken in an arbitrary order. A column of that name is replaced."""
    agg, both = (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if how == "sum" else (F.min, lambda a, b: F.least(a, b))
    rows = df.drop(name).withColumns({"__bucket": bucket, "__value": value})
    parts = rows.groupBy(*group, "__bucket").agg(agg("__value").alias("__part"))
    earlier = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    renamed = [F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]
    before = parts.select(*renamed, F.col("__bucket").alias("__b"), agg("__part").over(earlier).alias("__before"))
    same = F.col("__bucket").eqNullSafe(F.col("__b"))
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    within = Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(before, same).withColumn(name, both(F.col("__before"), agg("__value").over(within)))
    return out.drop("__bucket", "__value", "__b", "__before", *[f"__g{i}" for i in range(len(group))])


def key_bucket(df: DataFrame, key: str, width: int = 65_536) -> Column:
    """A bucket that rises with a key: ranges of numbers, the first three characters of texts."""
    if dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return F.floor(F.col(key) / width)
    return F.substring(F.col(key).cast("string"), 1, 3)


def numbered(df: DataFrame, value: str, ties: Sequence[str], name: str, descending: bool = False, ranges: int = 256) -> DataFrame:
    """``df`` with each row's place, from 1, in the order of a numeric column and then of ``ties``; nulls and NaN last. Rows are ordered within ranges of
    the value between approximate quantiles (one row of statistics), so that no task holds all."""
    v = F.col(value).cast("double")
    keyed = df.withColumns({"__all": F.lit(1), "__v": F.when(~F.isnan(v), -v if descending else v)})
    cuts = df.select(F.when(~F.isnan(v), -v if descending else v).alias("__v")).agg(F.percentile_approx("__v", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(10 * ranges)).alias("__cuts"))
    placed = keyed.crossJoin(F.broadcast(cuts))  # one row
    bucket = F.coalesce(F.when(F.col("__v").isNotNull(), F.size(F.filter("__cuts", lambda c: c < F.col("__v")))), F.lit(ranges))
    counted = running(placed, ["__all"], [F.col("__v").asc_nulls_last(), *ties], bucket, F.lit(1), name)
    return counted.withColumn(name, F.col(name).cast("bigint")).drop("__all", "__v", "__cuts")
