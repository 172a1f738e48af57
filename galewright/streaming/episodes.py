"""Streams: episodes from arriving rows, the episode store, prequential scores, generations as micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def episodes_from_stream(df: DataFrame, series: str, order: str, value: str, length: int) -> DataFrame:
    """``(series, episode_no, first_order, last_order, values)``: every ``length`` rows of a series as they arrive.

    Count windows aren't built in: each series keeps its rows until an episode is full. Rows of a micro-batch are taken in order; a row
    that arrives in a later batch than its successors joins the episode of its arrival. State holds under ``length`` rows per
    series.
    """
    kind = dict(df.dtypes)[series]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, orders, values = state.get if state.exists else (0, [], [])
        orders, values = list(orders), list(values)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        orders += [int(o) for o in rows[order]]
        values += [float(v) for v in rows[value]]
        out = []
        while len(values) >= length:
            out.append({series: key[0], "episode_no": number, "first_order": orders[0], "last_order": orders[length - 1], "values": values[:length]})
            orders, values, number = orders[length:], values[length:], number + 1
        state.update((number, orders, values))
        yield pd.DataFrame(out, columns=[series, "episode_no", "first_order", "last_order", "values"])

    rows = df.select(series, F.col(order).cast("bigint").alias(order), F.col(value).cast("double").alias(value))
    return rows.groupBy(series).applyInPandasWithState(
        step, f"`{series}` {kind}, episode_no long, first_order long, last_order long, values array<double>", "number long, orders array<long>, vals array<double>", "append", GroupStateTimeout.NoTimeout
    )


def naive_scores(episodes: DataFrame) -> DataFrame:
    """Each episode's mean squared error of the value before, for streams and batches."""
    pairs = F.zip_with(F.slice("values", F.lit(2), F.greatest(F.size("values") - 1, F.lit(0))), F.slice("values", 1, F.size("values") - 1), lambda a, b: (a - b) * (a - b))
    return episodes.withColumn("naive_mse", F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(pairs), F.lit(0)))


def windowed_counts(df: DataFrame, ts: str, keys: list[str], value: str, size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and means per event-time window; rows later than ``late`` are dropped by the watermark."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("avg_value"))


def generations(stream: DataFrame, step: Callable[[DataFrame, int], DataFrame], path: str, checkpoint: str):
    """One micro-batch is one generation: ``step`` makes its log rows, which are written under the batch's number, so that
    a repeated batch overwrites its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch, number).write.mode("overwrite").parquet(f"{path}/generation={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
