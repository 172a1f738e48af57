"""The N first items of every group under one tie rule (problem 4).

Hot-cold split by exact group counts. Light groups go through an ordinary window. Heavy groups are range-sorted over
(group, score, item), which salts a group over as many tasks as its rows need; each range gives its own first N, and a
window over these few candidates ends the job. Both paths give the same rows for any threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(
    df: DataFrame, group: str, score: str, item: str, n: int = 5, descending: bool = False, heavy_rows: int = 1_000_000
) -> DataFrame:
    """``(group, item, score, rank)`` of the first ``n`` items of each group by ``score``, ties by lower ``item``.

    Rows with a null group, null item, or null or NaN score don't rank. An item that stands in a group several times
    counts once, with its best score. Groups of fewer than ``n`` items are given whole. A group of more than
    ``heavy_rows`` distinct items takes the salted path. Other columns of ``df``, also ones named like those that are
    made here, are left out; an empty table gives an empty result.
    """
    s = F.col(score)
    ranks = F.col(group).isNotNull() & F.col(item).isNotNull() & s.isNotNull()
    if dict(df.dtypes)[score] in ("float", "double"):
        ranks &= ~F.isnan(s)
    best = (F.max if descending else F.min)("__s")
    rows = (
        df.where(ranks)
        .select(F.col(group).alias("__g"), F.col(item).alias("__i"), s.alias("__s"))
        .groupBy("__g", "__i")
        .agg(best.alias("__s"))
    )
    order = [F.col("__s").desc() if descending else F.col("__s").asc(), F.col("__i").asc()]
    heavy = rows.groupBy("__g").agg(F.count("*").alias("__n")).where(F.col("__n") > heavy_rows).select("__g")
    by_group = Window.partitionBy("__g").orderBy(*order)

    light = rows.join(heavy, "__g", "left_anti").withColumn("__r", F.row_number().over(by_group)).where(F.col("__r") <= n)
    ranges = rows.join(heavy, "__g", "left_semi").repartitionByRange(F.col("__g"), *order).withColumn("__range", F.spark_partition_id())
    within = Window.partitionBy("__g", "__range").orderBy(*order)
    candidates = ranges.withColumn("__r", F.row_number().over(within)).where(F.col("__r") <= n).drop("__r", "__range")
    hot = candidates.withColumn("__r", F.row_number().over(by_group)).where(F.col("__r") <= n)
    names = dict(zip(("__g", "__i", "__s", "__r"), (group, item, score, "rank")))
    return light.unionByName(hot).select(*[F.col(k).alias(v) for k, v in names.items()])
