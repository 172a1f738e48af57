"""Readers and writers: series files, corpora, tables of other systems, run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galewright.session import union_all
from galewright.spec import SeriesSpec


def header_of(spark: SparkSession, path: str, separator: str = ",") -> list[str]:
    """Column names of a CSV file: its first line that is neither blank nor a comment. Carriage returns go."""
    lines = spark.read.text(path).where("length(trim(value)) > 0 AND NOT startswith(value, '#')").limit(1).collect()
    if not lines:
        raise ValueError(f"{path} has no header")
    return [c.strip() for c in lines[0][0].replace("\r", "").split(separator)]


def read_series(spark: SparkSession, path: str, columns: Sequence[str], keep_text: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Named columns of one CSV file as doubles, in the order given, with ``row_no`` of the file from 0.

    Columns go by name. With ``strict`` every line is checked whole; without it unasked columns aren't parsed. Blank lines and lines that start with # are skipped, an empty cell is null, a cell that is no
    number or a line of another length is an error, and so are a missing column and a file without header.
    """
    names = header_of(spark, path)
    if missing := [c for c in [*columns, *keep_text] if c not in names]:
        raise ValueError(f"{path} lacks {missing}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).option("columnPruning", str(not strict).lower()).options(header=True, comment="#", mode="FAILFAST", enforceSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = reader.csv(path)
    clean = lambda c: F.nullif(F.regexp_replace(F.col(f"`{c}`"), "\r", ""), F.lit(""))
    return raw.select(*[clean(c).cast("double").alias(c) for c in columns], *[clean(c).alias(c) for c in keep_text], F.monotonically_increasing_id().alias("row_no"))


def read_many(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], keep_text: Sequence[str] = ()) -> DataFrame:
    """Files as one frame; ``series_idx`` is the file's place in the list."""
    return union_all([read_series(spark, p, columns, keep_text).withColumn("series_idx", F.lit(k)) for k, p in enumerate(paths)])


def read_run(spark: SparkSession, paths: Sequence[str], spec: SeriesSpec, tests: Sequence[str] = ()) -> DataFrame:
    """A run's files with their role: by index lists of the spec, or further files that only test."""
    df = read_many(spark, [*paths, *tests], spec.columns)
    k = F.col("series_idx")
    if tests:
        return df.withColumn("role", F.when(k >= len(paths), "test").otherwise("train"))
    role = F.when(k.isin(list(spec.testing)), "test")
    return df.withColumn("role", role.when(k.isin(list(spec.training)), "train") if spec.training else role.otherwise("train"))


def write_series(df: DataFrame, path: str, series: str = "series_idx", mode: str = "error") -> None:
    """One folder per series, as CSV with header."""
    df.write.mode(mode).partitionBy(series).csv(path, header=True)


def write_episodes(df: DataFrame, path: str, inputs: Sequence[str], episode: str = "episode_id", step: str = "step", mode: str = "error") -> None:
    """One folder per episode with its inputs in the order of time."""
    df.select(episode, step, *inputs).repartition(episode).sortWithinPartitions(episode, step).write.mode(mode).partitionBy(episode).csv(path, header=True)


def normalize_files(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], out: str, mode: str = "min_max") -> DataFrame:
    """Reads, normalises over all files and writes; returns the bounds, which go with a model."""
    from galewright.operators.series import fit_bounds, normalize

    df = read_many(spark, paths, columns)
    bounds = fit_bounds(df, columns)
    write_series(normalize(df, bounds, columns, mode=mode), out, mode="overwrite")
    return bounds


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as (path, line_no, text)."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", "\r", "").alias("text"))


def read_database(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A query of a database by JDBC; the driver must be on the class path. ``partition`` is (column, lowest, highest, parts)."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition is None:
        return reader.option("query", query).load()
    column, low, high, parts = partition
    return reader.option("dbtable", f"({query}) q").options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()


def write_database(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def write_genomes(df: DataFrame, path: str, mode: str = "error") -> None:
    """Genomes as nested Parquet, by island."""
    df.write.mode(mode).partitionBy("island").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows of a run's log: fitness, training, priorities or indices."""
    df.write.mode("append").parquet(path)


def index_log(df: DataFrame, keys: Sequence[str], indices: str) -> DataFrame:
    """Index lists as text ``i;j;k``."""
    return df.select(*keys, F.array_join(F.transform(indices, lambda i: i.cast("string")), ";").alias("indices"))


def create_search_tables(spark: SparkSession, database: str) -> None:
    """The search tables in the catalogue, if they aren't there yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in {
        "exact_search": "id INT, search_name STRING, max_genomes INT, genomes_generated INT, inserted_genomes INT, population_size INT, number_classes INT, crossover_rate FLOAT, inserted_at TIMESTAMP_NTZ, deleted_at TIMESTAMP_NTZ",
        "cnn_genome": "id INT, exact_id INT, generation_id INT, epoch INT, best_epoch INT, best_validation_error FLOAT, best_validation_predictions INT, training_error FLOAT, training_predictions INT, test_error FLOAT, test_predictions INT, stderr_out BINARY, inserted_at TIMESTAMP_NTZ, deleted_at TIMESTAMP_NTZ",
        "cnn_node": "id INT, exact_id INT, genome_id INT, innovation_number INT, depth FLOAT, size_x INT, size_y INT, node_type INT, disabled BOOLEAN, inserted_at TIMESTAMP_NTZ",
        "cnn_edge": "id INT, exact_id INT, genome_id INT, edge_type INT, innovation_number INT, input_node_innovation_number INT, output_node_innovation_number INT, filter_x INT, filter_y INT, disabled BOOLEAN, forward_visited BOOLEAN, reverse_visited BOOLEAN, inserted_at TIMESTAMP_NTZ",
    }.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
