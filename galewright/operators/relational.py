"""Relational operators of the search tables: merges, semi and anti joins, top rows, sets, upserts, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galewright.operators.prefix import numbered, running


def merge_by_key(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer merge of two lists by key: ``{c}_1``, ``{c}_2`` and ``origin`` (both, first, second)."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_1") for c in columns], F.lit(True).alias("__1"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_2") for c in columns], F.lit(True).alias("__2"))
    origin = F.when(F.col("__1") & F.col("__2"), "both").when(F.col("__1"), "first").otherwise("second")
    return left.join(right, list(keys), "full_outer").withColumn("origin", origin).drop("__1", "__2")


def without_partner(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` without a row of ``other`` of the same key; a null key has none."""
    return df.join(other.select(*on).distinct(), list(on), "left_anti")


def with_partner(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` with a row of ``other`` of the same key, once each."""
    return df.join(other.select(*on), list(on), "left_semi")


def outpaced(df: DataFrame, group: str, row_id: str, cost: str, factor: float = 4.0) -> DataFrame:
    """Rows that cost more than ``factor`` times another row of their group, with the number of such rows. Costs are not negative.

    Not a join of a group with itself: the cheaper rows of a group are a prefix of its costs in order, so each row counts
    them by a running count over the costs and the costs times the factor, in buckets of the logarithm, whatever the unit.
    """
    own = df.where(f"`{group}` IS NOT NULL AND `{cost}` IS NOT NULL").select(group, row_id, F.col(cost).cast("double").alias("__c"))
    none = F.lit(None).cast(dict(own.dtypes)[row_id])
    mark, row = F.struct((F.col("__c") * factor).alias("__at"), F.lit(1).alias("__mark"), none.alias("__id")), F.struct(F.col("__c").alias("__at"), F.lit(0).alias("__mark"), F.col(row_id).alias("__id"))
    both = own.select(group, F.col("__c").alias("__cost"), F.inline(F.array(mark, row)))
    # At equal places rows come before marks, because the cost must be more than the factor's multiple.
    counted = running(both, [group], ["__at", "__mark"], F.floor(F.log1p(F.col("__at")) * 256), F.col("__mark"), "n_cheaper").where("__mark = 0 AND n_cheaper > 0")
    return counted.select(group, F.col("__id").alias(row_id), F.col("__cost").alias(cost), F.col("n_cheaper").cast("bigint").alias("n_cheaper"))


def top_rows(df: DataFrame, group: str, order: Sequence[Column], n: int, rank: str = "place") -> DataFrame:
    """The first ``n`` rows of every group in the order; Spark keeps ``n`` per group before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= n)


def best_per_key(df: DataFrame, keys: Sequence[str], score: str, first: str) -> DataFrame:
    """One row per key: the lowest score, the earliest of equals. A partial aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(F.col(score), F.col(first)))
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, "__b.*")


def bounded_population(df: DataFrame, island: str, structure: str, score: str, arrival: str, size: int) -> DataFrame:
    """The population of each island: one genome per structure (the better; of equals the earlier), and of these the
    ``size`` best, ties in order of arrival. Genomes without a finite score don't enter."""
    finite = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score)) & (F.abs(F.col(score)) < F.lit(float("inf"))))
    return top_rows(best_per_key(finite, [island, structure], score, arrival), island, [F.col(score), F.col(arrival)], size)


def rank_groups(df: DataFrame, group: str, score: str) -> DataFrame:
    """Groups from worst to best by their best score."""
    best = df.groupBy(group).agg(F.min(score).alias("best"))
    return numbered(best, "best", [group], "place", descending=True)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; ``new`` must have a key once."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """``UPDATE ... SET ... WHERE``: new values where the condition holds."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def best_flags(df: DataFrame, columns: Sequence[str], bucket: str) -> DataFrame:
    """Marks each column's least value within a bucket of rows, as reports print it in bold."""
    w = Window.partitionBy(bucket)
    return df.withColumns({f"best_{c}": F.col(c) == F.min(c).over(w) for c in columns})


def reported_range(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """min, avg and max of each expression, in one pass."""
    aggs = [f(F.expr(v)).alias(f"{n}_{i}") for i, v in enumerate(values) for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))]
    return df.groupBy(*keys).agg(*aggs)


def set_distance(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``excess``, ``disjoint`` and ``union`` of two sorted innovation lists: excess are those beyond the other list's
    greatest, disjoint all other unshared ones."""
    x, y = F.col(a), F.col(b)
    only = lambda p, q: F.array_except(p, q)
    beyond = lambda p, q: F.size(F.filter(only(p, q), lambda v: v > F.coalesce(F.array_max(q), F.lit(-1))))
    excess = beyond(x, y) + beyond(y, x)
    return pairs.withColumns({"excess": excess, "disjoint": F.size(only(x, y)) + F.size(only(y, x)) - excess, "n_union": F.size(F.array_union(x, y))})


def shared_fitness(df: DataFrame, group: str, row_id: str, position: str, fitness: str, threshold: float) -> DataFrame:
    """Fitness over the number of the group's members within ``threshold`` of a one-dimensional position, itself included.

    Counted by a range frame over sorted positions; no pairs are made. Positions are cut into buckets as wide as the
    threshold, and a bucket borrows its neighbours' rows, so that a large group is spread over its positions.
    """
    at, span = F.col(position).cast("double"), max(float(threshold), 1e-9)
    rows = df.select(group, row_id, at.alias("__at"), F.col(fitness).alias("fitness"), F.floor(at / span).alias("__own"))
    spread = rows.select("*", F.explode(F.array(F.col("__own") - 1, F.col("__own"), F.col("__own") + 1)).alias("__bucket"))
    frame = f"RANGE BETWEEN {float(threshold)}D PRECEDING AND {float(threshold)}D FOLLOWING"
    near = spread.withColumn("n_near", F.expr(f"count(*) OVER (PARTITION BY `{group}`, __bucket ORDER BY __at {frame})")).where("__bucket = __own")
    return near.select(group, row_id, "fitness", "n_near", (F.col("fitness") / F.col("n_near")).alias("share"))


def agreeing_pairs(df: DataFrame, unit: Sequence[str], error: str, text: Sequence[str], limit: float) -> DataFrame:
    """Per unit, all pairs of its rows (``n_compared``) and those that agree (``n_agree``): the same text, or errors less than ``limit`` apart.

    ``text`` are the columns that make up a row's content, the error among them: rows of the same text have the same error, so
    the text only decides where the error is null or not finite. Units with a null key or with one row have no pairs.

    No pairs are made. Equal errors are counted together and each is compared with the greater ones by a range frame, in
    buckets twice as wide as the limit that borrow the next one's rows. What lies so close to the limit that the
    frame's rounding matters is compared by the difference itself.
    """
    at, wide, near = F.col(error).cast("double"), 2 * float(limit), float(limit) * 1e-5
    finite = at.isNotNull() & ~F.isnan(at) & (F.abs(at) < F.lit(float("inf")))
    known = df.where(" AND ".join(f"`{u}` IS NOT NULL" for u in unit))
    rows = known.groupBy(*unit, F.when(finite, at).alias("__at"), F.when(~finite, F.struct(*text)).alias("__text")).agg(F.count("*").alias("__n"))
    own = F.floor(F.col("__at") / wide)
    spread = rows.drop("__text").select("*", own.alias("__own"), F.explode(F.when(own.isNull(), F.array(own)).otherwise(F.array(own, own - 1))).alias("__bucket"))
    over = f"OVER (PARTITION BY {', '.join(f'`{u}`' for u in unit)}, __bucket ORDER BY __at RANGE BETWEEN"
    counted = spread.withColumn("__sure", F.expr(f"sum(__n) {over} CURRENT ROW AND {limit - near!r}D FOLLOWING)") - F.col("__n"))
    counted = counted.withColumn("__edge", F.expr(f"collect_list(struct(__at, __n)) {over} {limit - near!r}D FOLLOWING AND {limit + near!r}D FOLLOWING)"))
    close = F.filter("__edge", lambda e: (e["__at"] > F.col("__at") + F.lit(limit - near)) & (e["__at"] - F.col("__at") < limit))
    greater = F.col("__sure") + F.aggregate(close, F.lit(0).cast("bigint"), lambda a, e: a + e["__n"])
    same, n = F.expr("__n * (__n - 1) div 2"), F.sum("__n")
    agree = F.sum(same + F.when(F.col("__own").isNull(), F.lit(0)).otherwise(F.col("__n") * greater))
    per = counted.where("__bucket <=> __own").groupBy(*unit).agg(agree.alias("n_agree"), n.alias("__n"))
    return per.where("__n > 1").select(*unit, "n_agree", F.expr("__n * (__n - 1) div 2").alias("n_compared"))


def share_outliers(shared: DataFrame, group: str) -> DataFrame:
    """Members whose share is above mean + 3 * sqrt(sum of squares / (n - 1)) of their group."""
    spread = F.sqrt(F.sum(F.col("share") * F.col("share")) / F.nullif(F.count("*") - 1, F.lit(0)))
    limits = shared.groupBy(group).agg((F.avg("share") + 3 * spread).alias("limit"))
    return shared.join(limits, group).where("share > limit")
