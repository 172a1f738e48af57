"""Scalar functions as column expressions: activations, their slopes, clipping, hashes of structures, small text tools."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sigmoid_slope(y: Column) -> Column:
    """Of the output."""
    return y * (1 - y)


def tanh_slope(y: Column) -> Column:
    """Of the output."""
    return 1 - y * y


def swish(x: Column) -> Column:
    return x * sigmoid(x)


def swish_slope(x: Column) -> Column:
    s = sigmoid(x)
    return s + x * s * (1 - s)


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.greatest(x * slope, x)


def clamped_relu(x: Column, low_slope: float = 0.005, top: float = 5.5) -> Column:
    return F.when(x <= 0, x * low_slope).when(x > top, F.lit(top)).otherwise(x)


def bound(x: Column, limit: float = 10.0) -> Column:
    return F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))


def inverse(x: Column) -> Column:
    """1 / x, null at 0."""
    return 1 / F.nullif(x, F.lit(0.0))


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda a, x: a * x)


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))


def bound_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row; inside a lambda an expression would be worked out for each element."""
    return F.transform(F.array(value), use)[0]


def softmax(values: Column) -> Column:
    scaled = lambda e: bound_once(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda v: v / total))
    return bound_once(F.array_max(values), lambda top: bound_once(F.transform(values, lambda v: F.exp(v - top)), scaled))


def argmax(values: Column) -> Column:
    """The first place, from 0, of the greatest value."""
    return F.array_position(values, F.array_max(values)) - 1


def keep_top(probabilities: Column, k: int) -> Column:
    """The k greatest probabilities over their sum; 0 for the others. Ties at the limit go to the earlier places."""

    def kept(p: Column) -> Column:
        ranked = F.slice(F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("a"), i.alias("i")))), 1, k)
        return bound_once(ranked, lambda r: bound_once(F.aggregate(r, F.lit(0.0), lambda a, s: a - s["a"]), lambda total: shares(p, r, total)))

    def shares(p: Column, ranked: Column, total: Column) -> Column:
        return F.transform(p, lambda v, i: F.when(F.exists(ranked, lambda s: s["i"] == i), v / total).otherwise(0.0))

    return bound_once(probabilities, kept)


def clamped_mean_sd(values: Column, limit: float = 10.0) -> Column:
    """struct(mu, sigma): the mean of values clamped to the limit and the sample deviation of the unclamped ones around it; (0, 0.25) for none."""
    n = F.size(values)

    def around(mu: Column) -> Column:
        square = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mu) * (x - mu))
        sigma = F.sqrt(square / F.nullif(n - 1, F.lit(0)))
        return F.struct(F.coalesce(mu, F.lit(0.0)).alias("mu"), F.when(n == 0, 0.25).otherwise(F.coalesce(sigma, F.lit(0.0))).alias("sigma"))

    return bound_once(F.aggregate(values, F.lit(0.0), lambda a, x: a + bound(x, limit)) / F.nullif(n, F.lit(0)), around)


def structural_hash(nodes: Column, edges: Column, recurrent: Column) -> Column:
    """The sums of innovation numbers of nodes, edges and recurrent edges, joined by underscores."""
    return F.concat_ws("_", *[F.coalesce(c, F.lit(0)).cast("bigint").cast("string") for c in (nodes, edges, recurrent)])


def run_label(run_type: Column) -> Column:
    """A run type as reports print it: without ``_norec``, with plus signs for underscores."""
    return F.regexp_replace(F.regexp_replace(run_type, "_norec", ""), "_", "+")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def without_carriage_return(text: Column) -> Column:
    return F.regexp_replace(text, "\r", "")


def percentage(x: Column, n: Column | int, digits: int = 2) -> Column:
    return F.round(100.0 * x / n, digits)


def map_text(m: Column) -> Column:
    """A map as text with its keys in order."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ";")


def map_from_text(text: Column) -> Column:
    return F.when(text == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(text, F.lit(";"), F.lit("=")))


def natural_key(text: Column, width: int = 20) -> Column:
    """A text's key in natural order: digits of each number are filled up with zeros, so that ``run_2`` comes before ``run_10``."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+|[^0-9]+)"), F.lit(1)), lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(p)), "")
