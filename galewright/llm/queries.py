"""Queries of the text problems and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewright.llm.leakage import leaked_spans, removal_spans
from galewright.llm.tokenize import encode_corpus
from galewright.llm.truncation import cut_share, cut_texts


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_read(spark, sf_dir, "documents"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_spans(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leaked, with the number of documents that hold them."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to be removed from each document: merged spans of words, with the number of items in each."""
    return removal_spans(_spans(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_texts(_read(spark, sf_dir, "documents"))


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_share(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p7_ids, p8_found, p8_items, p8_spans, p9_found, p9_share)}
ORACLES: dict[str, str] = {}
