import struct

import pytest
from pyspark.sql import functions as F

from galewright.nn.genome import SCHEMA, Genome, seed_genome
from galewright.operators.images import packed_images
from galewright.sources import files
from galewright.spec import SeriesSpec


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_series_by_name(spark, tmp_path):
    a = write(tmp_path / "a.csv", "# a comment\r\nname,p,q\r\nx,1.5,2\r\n\r\n# more\r\nx,,4\r\n")
    b = write(tmp_path / "b.csv", "q,p,other\n5,6,7\n")
    got = files.read_many(spark, [a, b], ["p", "q"]).orderBy("series_idx", "row_no").select("series_idx", "p", "q").collect()
    assert [tuple(r) for r in got] == [(0, 1.5, 2.0), (0, None, 4.0), (1, 6.0, 5.0)]
    spec = SeriesSpec(("p",), ("q",), testing=(1,))
    assert {(r["series_idx"], r["role"]) for r in files.read_run(spark, [a, b], spec).collect()} == {(0, "train"), (1, "test")}
    assert {(r["series_idx"], r["role"]) for r in files.read_run(spark, [a], spec, [b]).collect()} == {(0, "train"), (1, "test")}


def test_bad_series(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_series(spark, write(tmp_path / "a.csv", "p,q\n1,2\n"), ["r"])
    with pytest.raises(ValueError):
        files.read_series(spark, write(tmp_path / "b.csv", ""), ["p"])
    with pytest.raises(Exception):
        files.read_series(spark, write(tmp_path / "c.csv", "p,q\n1\n"), ["p"]).collect()
    with pytest.raises(Exception):
        files.read_series(spark, write(tmp_path / "d.csv", "p,q\nx,1\n"), ["p"]).collect()
    assert files.read_series(spark, write(tmp_path / "e.csv", "p,q\n"), ["p"]).collect() == []


def test_writers(spark, tmp_path):
    a = write(tmp_path / "a.csv", "p,q\n1,10\n3,30\n")
    bounds = files.normalize_files(spark, [a], ["p", "q"], str(tmp_path / "out"))
    assert bounds.collect()[0]["max_q"] == 30.0
    back = spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True).orderBy("p").collect()
    assert [(r["p"], r["q"]) for r in back] == [(0.0, 0.0), (1.0, 1.0)]
    e = spark.createDataFrame([(0, 1, 2.0), (0, 0, 1.0), (1, 0, 5.0)], "episode_id int, step int, x double")
    files.write_episodes(e, str(tmp_path / "ep"), ["x"])
    assert spark.read.csv(str(tmp_path / "ep"), header=True).count() == 3
    log = files.index_log(spark.createDataFrame([(1, [3, 1, 2])], "genome_id int, ids array<int>"), ["genome_id"], "ids")
    files.append_log(log, str(tmp_path / "log"))
    files.append_log(log, str(tmp_path / "log"))
    assert [r["indices"] for r in spark.read.parquet(str(tmp_path / "log")).collect()] == ["3;1;2"] * 2


def test_genomes_round_trip(spark, tmp_path):
    g = seed_genome(["a"], ["y"], "lstm", 2, 1, 2)
    g.fitness = 0.5
    files.write_genomes(spark.createDataFrame([g.to_row()], SCHEMA), str(tmp_path / "g"))
    (row,) = spark.read.parquet(str(tmp_path / "g")).collect()
    assert Genome.from_row(row).to_row() == g.to_row()


def test_text_and_images(spark, tmp_path):
    p = write(tmp_path / "t.txt", "a b\r\nc\n")
    assert [r["text"] for r in files.read_lines(spark, p).orderBy("line_no").collect()] == ["a b", "c"]
    planes = bytes(range(3 * 2 * 2))
    (tmp_path / "i.bin").write_bytes(struct.pack("<4i2i", 2, 1, 2, 2, 1, 2) + planes)
    got = packed_images(spark, str(tmp_path / "i.bin")).orderBy("image").collect()
    assert [(r["image"], r["class"], bytes(r["data"])) for r in got] == [(0, 0, planes[:4]), (1, 1, planes[4:8]), (2, 1, planes[8:])]


def test_search_tables(spark):
    files.create_search_tables(spark, "search_test")
    assert {r["tableName"] for r in spark.sql("SHOW TABLES IN search_test").collect()} == {"exact_search", "cnn_genome", "cnn_node", "cnn_edge"}
    assert spark.table("search_test.cnn_edge").where(F.col("disabled")).count() == 0
    spark.sql("DROP DATABASE search_test CASCADE")
