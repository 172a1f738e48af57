"""Sampling whose randomness is a hash of (seed, key): it doesn't depend on the order or placement of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Three rounds of multiply, add, shift and exclusive or, in 31 bits so that products fit into a signed 64-bit integer.
_BITS = (1 << 31) - 1
_ROUNDS = ((73_244_475, 15), (741_103_597, 13), (1_540_483_477, 16))
_SALTS = (0, 362_437)


def hash_unit(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the lower 62 bits of an integer key: two 31-bit words, each of three multiply and shift rounds
    in integers that any SQL engine can repeat."""
    k, bits = key.cast("bigint"), F.lit(_BITS).cast("bigint")
    low, high = k.bitwiseAND(bits), F.shiftright(k, 31).bitwiseAND(bits)
    words = []
    for salt in _SALTS:
        x = low
        for n, (a, shift) in enumerate(_ROUNDS):
            x = (x * F.lit(a) + F.lit((seed + salt) * 40_014 + 11) + (high * F.lit(69_621) if n == 1 else F.lit(0))).bitwiseAND(bits)
            x = x.bitwiseXOR(F.shiftright(x, shift))
        words.append(x)
    return (words[0] + (words[1] + 0.5) / float(_BITS + 1)) / float(_BITS + 1)


def hash_unit_sql(key: str, seed: int) -> str:
    """The same number as SQL text, for keys that aren't negative."""
    words = []
    for salt in _SALTS:
        x = f"(({key}) & {_BITS})"
        for n, (a, shift) in enumerate(_ROUNDS):
            x = f"(({x} * {a} + {(seed + salt) * 40_014 + 11}" + (f" + ((({key}) >> 31) & {_BITS}) * 69621" if n == 1 else "") + f") & {_BITS})"
            x = f"xor({x}, {x} >> {shift})"
        words.append(x)
    return f"(({words[0]} + ({words[1]} + 0.5::DOUBLE) / {_BITS + 1}) / {_BITS + 1})"


def uniform_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, each with equal chance; the rows of least hash. Fewer if there are fewer."""
    return df.withColumn("__u", hash_unit(F.col(key), seed)).orderBy("__u", key).limit(n).drop("__u")


def weighted_sample(df: DataFrame, key: str, weight: Column, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement with chances in proportion to ``weight`` as in successive draws: the least
    -ln(u) / weight. Rows without a positive weight are never drawn."""
    keyed = df.withColumn("__w", weight).where("__w > 0").withColumn("__k", -F.log(hash_unit(F.col(key), seed)) / F.col("__w"))
    return keyed.orderBy("__k", key).limit(n).drop("__k", "__w")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of every stratum."""
    w = Window.partitionBy(stratum).orderBy("__u", key)
    return df.withColumn("__u", hash_unit(F.col(key), seed)).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__u", "__r")


def permuted(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Each row's place in a random order of all rows, from 0. Places come from hash buckets and the counts of earlier ones."""
    rows = df.withColumn("__u", hash_unit(F.col(key), seed)).withColumn("__b", F.floor(F.col("__u") * 4096))
    counts = rows.groupBy("__b").agg(F.count("*").alias("__n"))  # at most 4096 rows
    starts = counts.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    w = Window.partitionBy("__b").orderBy("__u", key)
    return rows.join(F.broadcast(starts), "__b").withColumn("place", (F.col("__s") + F.row_number().over(w) - 1).cast("bigint")).drop("__u", "__b", "__s")


def normal_pair(key: Column, seed: int, mu: float = 0.0, sigma: float = 1.0) -> tuple[Column, Column]:
    """Two independent normal numbers by the Box-Muller transform."""
    radius = F.sqrt(-2 * F.log(hash_unit(key, seed)))
    angle = 2 * F.pi() * hash_unit(key, seed + 7919)
    return mu + sigma * radius * F.cos(angle), mu + sigma * radius * F.sin(angle)


def gumbel(key: Column, seed: int) -> Column:
    return -F.log(-F.log(hash_unit(key, seed)))


def choose_by_rates(key: Column, seed: int, rates: Sequence[tuple[str, float]]) -> Column:
    """A name with chances in proportion to its rate."""
    total = sum(r for _, r in rates)
    u, out, below = hash_unit(key, seed) * total, F.lit(rates[-1][0]), 0.0
    limits = []
    for name, rate in rates:
        below += rate
        limits.append((name, below))
    for name, limit in reversed(limits[:-1]):
        out = F.when(u < limit, name).otherwise(out)
    return out


def priority(mse: Column, generation: Column, available_from: Column, decay: float = 0.01, epsilon: float = 1e-8) -> Column:
    """1 / (mse + epsilon) * exp(-decay * (generation - available_from))."""
    return F.exp(-F.lit(decay) * (generation - available_from)) / (mse + epsilon)


def updated_priorities(state: DataFrame, generation: int, elite: DataFrame, window: int, episode: str = "episode_id") -> DataFrame:
    """The episodes' errors after a generation: the episode of that number takes the best elite error, the ``window``
    episodes before it 0.7 of their own and 0.3 of the elite's mean; others keep theirs. ``elite`` is one row (best, avg)."""
    s = state.crossJoin(F.broadcast(elite.select(F.col("best").alias("__best"), F.col("avg").alias("__avg"))))
    recent = (F.col(episode) >= generation - window) & (F.col(episode) < generation)
    new = F.when(F.col(episode) == generation, F.col("__best")).when(recent, 0.7 * F.col("mse") + 0.3 * F.col("__avg")).otherwise(F.col("mse"))
    return s.withColumn("mse", F.when(F.col("__best").isNull(), F.col("mse")).otherwise(new)).drop("__best", "__avg")
