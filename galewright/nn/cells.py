"""Cells: the update rules of a network's nodes, on tape variables or plain arrays.

A cell maps the sum of its inputs and its state to its output and new state; both are the network's values at one time.
Every rule is written once, over operations that keep derivatives.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from galewright.nn import tape as A


@dataclass(frozen=True)
class Cell:
    """``step(weights, x, state) -> (output, state)``; the state before the first time is 0 (None). ``combine`` says how inputs meet."""

    name: str
    weights: tuple[str, ...]
    step: Callable
    combine: str = "sum"


def _plain(name: str, f: Callable, combine: str = "sum") -> Cell:
    return Cell(name, ("bias",), lambda w, x, s: (f(x + w[0]), None), combine)


def _lstm(w, x, c):
    ow, ou, ob, iw, iu, ib, fw, fu, fb, cw, cb = w
    c = 0.0 if c is None else c
    o, i, f = A.sigmoid(ow * x + ou * c + ob), A.sigmoid(iw * x + iu * c + ib), A.sigmoid(fw * x + fu * c + (fb + 1.0))
    c = f * c + i * A.tanh(cw * x + cb)
    return o * c, c


def _gru(w, x, h):
    zw, zu, zb, rw, ru, rb, hw, hu, hb = w
    h = 0.0 if h is None else h
    z, r = A.sigmoid(zb + zu * h + zw * x), A.sigmoid(rb + rw * x + ru * h)
    y = z * h + (1.0 - z) * A.tanh(hb + hw * x + hu * (r * h))
    return y, y


def _ugrnn(w, x, h):
    cw, ch, cb, gw, gh, gb = w
    h = 0.0 if h is None else h
    g = A.sigmoid(gw * x + gh * h + gb)
    y = g * h + (1.0 - g) * A.tanh(cw * x + ch * h + cb)
    return y, y


def _mgu(w, x, h):
    fw, fu, fb, hw, hu, hb = w
    h = 0.0 if h is None else h
    f = A.sigmoid(fb + fu * h + fw * x)
    y = (1.0 - f) * h + f * A.tanh(hb + hw * x + hu * (f * h))
    return y, y


def _delta(w, x, z):
    alpha, b1, b2, v, rb, zb = w
    z = 0.0 if z is None else z
    d = v * z
    inner = A.tanh(d * x * (alpha + 2.0) + d * (b1 + 1.0) + x * (b2 + 1.0) + zb)
    r = A.sigmoid(x + rb)
    y = A.tanh(inner * (1.0 - r) + r * z)
    return y, y


# The graphs of the cells found by architecture searches. Of each inner node its inputs and activation;
# node 0 is the recurrent one, the output is the sum of the leaves.
ENARC_GRAPH = [(0, "tanh"), (1, "tanh"), (1, "leaky"), (2, "leaky"), (3, "swish"), (1, "swish"), (3, "tanh"), (3, "swish")]
ENAS_GRAPH = [(0, "tanh"), (0, "tanh"), (0, "leaky"), (1, "leaky"), (4, "sigmoid"), (2, "swish"), (4, "tanh"), (3, "swish")]
RANDOM_GRAPH = [((), "tanh"), ((), "tanh"), ((), "leaky"), ((), "leaky"), ((1, 1), "sigmoid"), ((1,), "swish"), ((), "tanh")]
_ACT = {"tanh": A.tanh, "leaky": A.leaky_relu, "swish": A.swish, "sigmoid": A.sigmoid, "identity": A.identity}


def _graph(graph, first: str = "tanh") -> Callable:
    def step(w, x, h):
        nodes, used = [_ACT[first](w[0] * x + w[1] * (0.0 if h is None else h))], {0}
        for k, (sources, act) in enumerate(graph):
            sources = sources if isinstance(sources, tuple) else (sources,)
            total = 0.0
            for s in sources:
                # A source that comes later in the list holds nothing yet.
                total = total + (nodes[s] if s < len(nodes) else 0.0)
                used.add(s)
            nodes.append(_ACT[act](w[k + 2] * total))
        y = 0.0
        for k, n in enumerate(nodes):
            if k not in used:
                y = y + n
        return y, y

    return step


def _names(n: int) -> tuple[str, ...]:
    return ("zw", "rw", *(f"w{k}" for k in range(1, n + 1)))


CELLS: dict[str, Cell] = {
    c.name: c
    for c in [
        _plain("simple", A.tanh), _plain("jordan", A.tanh), _plain("elman", A.tanh), _plain("sin", A.sin), _plain("cos", A.cos), _plain("tanh", A.tanh),
        _plain("sigmoid", A.sigmoid), _plain("sum", A.identity), _plain("inverse", A.inverse), _plain("linear", A.identity),
        Cell("multiply", ("bias",), lambda w, x, s: (x + w[0], None), "product"),
        # The genetic-programming variants have no trained bias of their own.
        *[Cell(f"{n}_gp", (), lambda w, x, s, f=f: (f(x), None)) for n, f in (("sin", A.sin), ("cos", A.cos), ("tanh", A.tanh), ("sigmoid", A.sigmoid), ("sum", A.identity), ("inverse", A.inverse))],
        Cell("multiply_gp", (), lambda w, x, s: (x, None), "product"),
        Cell("lstm", ("ow", "ou", "ob", "iw", "iu", "ib", "fw", "fu", "fb", "cw", "cb"), _lstm),
        Cell("online_lstm", ("ow", "ou", "ob", "iw", "iu", "ib", "fw", "fu", "fb", "cw", "cb"), _lstm),
        Cell("gru", ("zw", "zu", "zb", "rw", "ru", "rb", "hw", "hu", "hb"), _gru),
        Cell("ugrnn", ("cw", "ch", "cb", "gw", "gh", "gb"), _ugrnn),
        Cell("mgu", ("fw", "fu", "fb", "hw", "hu", "hb"), _mgu),
        Cell("delta", ("alpha", "beta1", "beta2", "v", "rb", "zb"), _delta),
        Cell("enarc", _names(8), _graph(ENARC_GRAPH)), Cell("enas", _names(8), _graph(ENAS_GRAPH)), Cell("random_dag", _names(8), _graph(RANDOM_GRAPH)),
    ]
}


def mixture_weights(pi, noise, uses: int, keep: int = 0):
    """The shares of a mixture's cells: a Gumbel softmax of the temperature max(1/3, 1/(1 + 0.05 uses)), of which the
    ``keep`` greatest stay if that is over 0. From 1,000 uses on only the cell of greatest pi runs."""
    import numpy as np

    pi = np.asarray(pi, float)
    if uses >= 1000:
        return (np.arange(len(pi)) == int(np.argmax(pi))).astype(float)
    t = max(1 / 3, 1 / (1 + 0.05 * uses))
    x = (np.asarray(noise, float) + np.log(pi)) / t
    z = np.exp(x - x.max())
    z /= z.sum()
    if keep > 0:
        top = np.argsort(-z, kind="stable")[:keep]
        kept = np.zeros_like(z)
        kept[top] = z[top]
        z = kept / kept.sum()
    return z


def mixture_cell(parts: tuple[str, ...], noise=None, uses: int = 0, keep: int = 0) -> Cell:
    """A cell that is the sum of others, each weighted by its share: the first weights are the logarithms of the shares before noise,
    the others are the parts' own. ``noise`` holds one Gumbel draw per part; from 1,000 uses on only the strongest part runs."""
    import numpy as np

    cells = [CELLS[p] for p in parts]
    g = np.zeros(len(parts)) if noise is None else np.asarray(noise, float)
    t = max(1 / 3, 1 / (1 + 0.05 * uses))

    def step(w, x, state):
        logits, own = w[: len(parts)], list(w[len(parts) :])
        state = [None] * len(parts) if state is None else list(state)
        value = np.array([float(A._val(v)) for v in logits])
        chosen = mixture_weights(np.exp(value - value.max()), g, uses, keep) > 0
        # Shares by exponentials of differences, so that derivatives reach the logits.
        scores = [(v + float(n)) * (1 / t) for v, n in zip(logits, g)]
        top = max(float(A._val(s)) for s in scores)
        parts_exp = [A.exp(s - top) if c else 0.0 for s, c in zip(scores, chosen)]
        total = 0.0
        for e in parts_exp:
            total = total + e
        scale = A.inverse(total)
        y = 0.0
        for k, cell in enumerate(cells):
            mine, own = own[: len(cell.weights)], own[len(cell.weights) :]
            if chosen[k]:
                out, state[k] = cell.step(mine, x, state[k])
                y = y + out * (parts_exp[k] * scale)
        return y, tuple(state)

    names = tuple(f"share_{p}" for p in parts) + tuple(f"{p}_{n}" for p, c in zip(parts, cells) for n in c.weights)
    return Cell("dnas", names, step)


CELLS["dnas"] = mixture_cell(("simple", "ugrnn", "mgu", "gru", "delta", "lstm"))
