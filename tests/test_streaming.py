import pandas as pd

from galewright.streaming.episodes import episodes_from_stream, naive_scores


def test_episodes_over_several_batches(spark, tmp_path):
    schema = "s string, at long, v double"
    for k in range(3):
        rows = [("a", k * 7 + i, float(k * 7 + i)) for i in range(7)] + ([("b", k, 1.0)] if k else [])
        spark.createDataFrame(pd.DataFrame(rows, columns=["s", "at", "v"]), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = naive_scores(episodes_from_stream(stream, "s", "at", "v", 5)).writeStream.format("memory").queryName("eps").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["s"], r["episode_no"], r["first_order"], r["last_order"], r["naive_mse"]) for r in spark.table("eps").collect())
    assert [(s, n) for s, n, *_ in got] == [("a", 0), ("a", 1), ("a", 2), ("a", 3)]
    assert all(b - a == 4 for _, _, a, b, _ in got if (a, b) == (a, a + 4)) and len(got) == 4
