"""Word series: tokens of lines, vocabularies, next-token pairs, fixed-size chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galewright.session import cut_lineage

END = "<eos>"


def clean_spaces(text: Column) -> Column:
    """Without spaces at the ends, and with one in place of several."""
    return F.regexp_replace(F.trim(text), " +", " ")


def tokens(df: DataFrame, line: str, text: str) -> DataFrame:
    """``(line, pos, token)``: the words between spaces of each line, then the mark of its end. A null line gives only the mark."""
    cleaned = clean_spaces(F.coalesce(F.col(text), F.lit("")))
    words = F.filter(F.split(cleaned, " "), lambda w: w != "")
    return df.select(line, F.posexplode(F.concat(words, F.array(F.lit(END)))).alias("pos", "token"))


def vocabulary(tokens_df: DataFrame, token: str = "token") -> DataFrame:
    """``(token, word_id, n)``: ids in the order of the words, from 0. Words of all files share one numbering.

    The distinct words are written range-sorted to the shared folder with the number of their range; ids are the counts of earlier
    ranges plus the place within the range, whatever letters the words begin with."""
    words = tokens_df.groupBy(token).agg(F.count("*").alias("n"))
    words = cut_lineage(words.repartitionByRange(token).withColumn("__b", F.spark_partition_id()))
    counts = words.groupBy("__b").agg(F.count("*").alias("__k"))  # as many rows as ranges
    starts = counts.select("__b", F.coalesce(F.sum("__k").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(token)) - 1
    return words.join(starts, "__b").select(token, (F.col("__s") + place).cast("bigint").alias("word_id"), "n")


def encode_words(tokens_df: DataFrame, vocab: DataFrame, unknown: int = 0, token: str = "token") -> DataFrame:
    """Tokens with their ids; words that the vocabulary doesn't have get ``unknown``."""
    return tokens_df.join(vocab.select(token, "word_id"), token, "left").withColumn("word_id", F.coalesce("word_id", F.lit(unknown).cast("bigint")))


def next_tokens(encoded: DataFrame, line: str, k: int = 1) -> DataFrame:
    """``(line, pos, x, y)``: each word beside the one k places later."""
    w = Window.partitionBy(line).orderBy("pos")
    out = encoded.select(line, "pos", F.col("word_id").alias("x"), F.lead("word_id", k).over(w).alias("y"))
    return out.where("y IS NOT NULL")


def word_frequencies(vocab: DataFrame, token: str = "token") -> DataFrame:
    """The mean of each word's one-hot column."""
    total = vocab.agg(F.sum("n").alias("__n"))
    return vocab.crossJoin(F.broadcast(total)).select(token, "n", (F.col("n") / F.col("__n")).alias("frequency"))  # one row


def chunks(encoded: DataFrame, line: str, size: int = 64, padding: int = -1) -> DataFrame:
    """``(line, chunk, ids)``: word ids in chunks of ``size``, the last one padded."""
    grouped = encoded.groupBy(line, F.floor(F.col("pos") / size).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", "word_id"))).alias("__w"))
    ids = F.transform("__w", lambda x: x["word_id"])
    return grouped.select(line, "chunk", F.concat(ids, F.array_repeat(F.lit(padding).cast("bigint"), F.lit(size) - F.size(ids))).alias("ids"))


def one_hot(encoded: DataFrame, line: str, words: list[int]) -> DataFrame:
    """One 0/1 column per given word id; for small vocabularies that a consumer needs as columns."""
    return encoded.select(line, "pos", *[F.when(F.col("word_id") == w, 1).otherwise(0).alias(f"w{w}") for w in words])
