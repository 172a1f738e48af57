"""Recurrent cells as column expressions: a fixed cell runs over an array of inputs inside the JVM, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galewright.functions.scalar import leaky_relu, sigmoid, swish
from galewright.nn.cells import ENARC_GRAPH, ENAS_GRAPH, RANDOM_GRAPH

GRAPHS = {"enarc": ENARC_GRAPH, "enas": ENAS_GRAPH, "random_dag": RANDOM_GRAPH}
_ACT = {"tanh": F.tanh, "leaky": leaky_relu, "swish": swish, "sigmoid": sigmoid}
_PLAIN = {
    "simple": F.tanh, "jordan": F.tanh, "elman": F.tanh, "tanh": F.tanh, "sin": F.sin, "cos": F.cos, "sigmoid": sigmoid, "sum": lambda v: v, "linear": lambda v: v, "multiply": lambda v: v,
    "inverse": lambda v: F.when(v == 0, 0.0).otherwise(1 / v),
}


def _graph_step(graph: list, k: list[Column], x: Column, h: Column) -> Column:
    """A searched cell: its inner nodes hold the activations of weighted sums of earlier ones; those that feed no other one are its output."""
    parts, used = [F.tanh(k[0] * x + k[1] * h)], {0}
    for j, (sources, act) in enumerate(graph):
        total = F.lit(0.0)
        for source in sources if isinstance(sources, tuple) else (sources,):
            used.add(source)
            if source < len(parts):
                total = total + parts[source]
        parts.append(_ACT[act](k[j + 2] * total))
    out = F.lit(0.0)
    for j, part in enumerate(parts):
        if j not in used:
            out = out + part
    return out


def _step(cell: str, w: list[float], x: Column, h: Column, c: Column) -> tuple[Column, Column]:
    """(output, inner state) of one time; ``h`` is the output before, ``c`` the inner state before."""
    k = [F.lit(float(v)) for v in w]
    if cell in _PLAIN:
        return _PLAIN[cell](x + k[0]), c
    if cell in GRAPHS:
        return _graph_step(GRAPHS[cell], k, x, h), c
    if cell in ("lstm", "online_lstm"):
        o, i, f = (sigmoid(k[j] * x + k[j + 1] * c + k[j + 2] + (1.0 if j == 6 else 0.0)) for j in (0, 3, 6))
        new = f * c + i * F.tanh(k[9] * x + k[10])
        return o * new, new
    if cell == "gru":
        z, r = sigmoid(k[2] + k[1] * h + k[0] * x), sigmoid(k[5] + k[3] * x + k[4] * h)
        return z * h + (1 - z) * F.tanh(k[8] + k[6] * x + k[7] * r * h), c
    if cell == "ugrnn":
        g = sigmoid(k[3] * x + k[4] * h + k[5])
        return g * h + (1 - g) * F.tanh(k[0] * x + k[1] * h + k[2]), c
    if cell == "mgu":
        f = sigmoid(k[2] + k[1] * h + k[0] * x)
        return (1 - f) * h + f * F.tanh(k[5] + k[3] * x + k[4] * f * h), c
    if cell == "delta":
        d = k[3] * h
        inner = F.tanh(d * x * (k[0] + 2) + d * (k[1] + 1) + x * (k[2] + 1) + k[5])
        r = sigmoid(x + k[4])
        return F.tanh(inner * (1 - r) + r * h), c
    raise ValueError(f"no expression for the cell {cell}")


def run_cell(cell: str, weights: list[float], xs: Column) -> Column:
    """The cell's outputs over an array of inputs in the order of time."""
    zero = F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("ys"))

    def merge(acc: Column, x: Column) -> Column:
        y, inner = _step(cell, weights, x, acc["h"], acc["c"])
        return F.struct(y.alias("h"), inner.alias("c"), F.concat(acc["ys"], F.array(y)).alias("ys"))

    return F.aggregate(xs, zero, merge, lambda acc: acc["ys"])
