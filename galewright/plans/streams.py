"""Queries that run a stream to its end and give what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewright.plans.series import r
from galewright.session import shared_folder, table
from galewright.streaming.episodes import episodes_from_stream, generations, naive_scores, windowed_counts


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files; the table may be one file or a folder."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d}/events.parquet*")


def _finish(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there and reads its result from the shared folder."""
    out = shared_folder(spark, "stream")
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def stream_episodes(spark: SparkSession, d: str) -> DataFrame:
    e = _stream(spark, d).withColumn("at", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    done = _finish(spark, episodes_from_stream(e, "user_id", "at", "value", 20))
    return naive_scores(done).select("user_id", "episode_no", "first_order", "last_order", r("naive_mse", 4).alias("naive_mse"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by event type; the stream's last windows stay open until later events arrive."""
    e = _stream(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    w = _finish(spark, windowed_counts(e, "ts", ["event_type"], "value", "1 day", "1 day"))
    return w.select(F.unix_seconds("window.start").alias("start_s"), "event_type", "n", r("avg_value").alias("avg_value"))


def stream_generations(spark: SparkSession, d: str) -> DataFrame:
    """Each micro-batch is a generation that logs its best, mean and worst value per event type."""
    base = shared_folder(spark, "generations")

    def step(batch: DataFrame, number: int) -> DataFrame:
        return batch.groupBy("event_type").agg(F.min("value").alias("best"), F.avg("value").alias("avg"), F.max("value").alias("worst"))

    generations(_stream(spark, d), step, f"{base}/log", f"{base}/state").awaitTermination()
    log = spark.read.parquet(f"{base}/log")
    return log.select("event_type", F.col("generation").cast("bigint").alias("generation"), r("best").alias("best"), r("avg").alias("avg"), r("worst").alias("worst"))


QUERIES = {f.__name__: f for f in (stream_episodes, stream_windows, stream_generations)}

ORACLES = {
    "stream_episodes": """WITH e AS (SELECT user_id, epoch_us(ts) AS u, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events), p AS (SELECT *, t // 20 AS episode_no, lag(value) OVER (PARTITION BY user_id, t // 20 ORDER BY t) AS b FROM e)
    SELECT user_id, episode_no, min(u) AS first_order, max(u) AS last_order, round(avg((value - b) ** 2), 4) AS naive_mse FROM p GROUP BY user_id, episode_no HAVING count(*) = 20""",
    "stream_generations": "SELECT event_type, 0::BIGINT AS generation, round(min(value), 6) AS best, round(avg(value), 6) AS avg, round(max(value), 6) AS worst FROM events GROUP BY event_type",
}
