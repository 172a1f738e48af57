"""Reverse-mode differentiation over NumPy arrays. A batch of episodes is one array, so one tape trains many at once."""

from __future__ import annotations

from functools import wraps

import numpy as np


class Var:
    """A value with what it was made from; `backward` fills ``grad`` of everything below a scalar sum."""

    __slots__ = ("value", "grad", "parents")
    __array_ufunc__ = None  # arrays leave sums and products with variables to the variables

    def __init__(self, value, parents=()):
        self.value, self.grad, self.parents = value, 0.0, parents

    def __add__(self, other):
        if isinstance(other, Var):
            return Var(self.value + other.value, ((self, 1.0), (other, 1.0)))
        return Var(self.value + other, ((self, 1.0),))

    __radd__ = __add__

    def __neg__(self):
        return Var(-self.value, ((self, -1.0),))

    def __sub__(self, other):
        if isinstance(other, Var):
            return Var(self.value - other.value, ((self, 1.0), (other, -1.0)))
        return Var(self.value - other, ((self, 1.0),))

    def __rsub__(self, other):
        return Var(other - self.value, ((self, -1.0),))

    def __mul__(self, other):
        if isinstance(other, Var):
            return Var(self.value * other.value, ((self, other.value), (other, self.value)))
        return Var(self.value * other, ((self, other),))

    __rmul__ = __mul__


class Trace:
    """A value that isn't known yet, at a place of a program. What is done with it is emitted: ``emit(operation, left, right)`` gives the result."""

    __slots__ = ("emit", "place")

    def __init__(self, emit, place):
        self.emit, self.place = emit, place

    def __add__(self, other):
        return self.emit("add", self, other)

    def __radd__(self, other):
        return self.emit("add", other, self)

    def __sub__(self, other):
        return self.emit("sub", self, other)

    def __rsub__(self, other):
        return self.emit("sub", other, self)

    def __mul__(self, other):
        return self.emit("mul", self, other)

    def __rmul__(self, other):
        return self.emit("mul", other, self)


def _traced(f):
    @wraps(f)
    def run(x):
        return x.emit(f.__name__, x) if isinstance(x, Trace) else f(x)

    return run


def _unary(x, y, slope):
    return Var(y, ((x, slope),)) if isinstance(x, Var) else y


def _val(x):
    return x.value if isinstance(x, Var) else x


@_traced
def sigmoid(x):
    y = 1 / (1 + np.exp(-np.clip(_val(x), -60, 60)))
    return _unary(x, y, y * (1 - y))


@_traced
def tanh(x):
    y = np.tanh(_val(x))
    return _unary(x, y, 1 - y * y)


def identity(x):
    return x


@_traced
def leaky_relu(x):
    v = _val(x)
    return _unary(x, np.maximum(0.01 * v, v), np.where(v > 0, 1.0, 0.01))


@_traced
def swish(x):
    v = _val(x)
    s = 1 / (1 + np.exp(-np.clip(v, -60, 60)))
    return _unary(x, v * s, s + v * s * (1 - s))


@_traced
def exp(x):
    y = np.exp(np.minimum(_val(x), 700.0))
    return _unary(x, y, y)


@_traced
def sin(x):
    return _unary(x, np.sin(_val(x)), np.cos(_val(x)))


@_traced
def cos(x):
    return _unary(x, np.cos(_val(x)), -np.sin(_val(x)))


@_traced
def inverse(x):
    """1 / x, 0 where x is 0."""
    v = _val(x)
    safe = np.where(v == 0, 1.0, v)
    y = np.where(v == 0, 0.0, 1 / safe)
    return _unary(x, y, -y * y)


def backward(seeds: list[tuple[Var, np.ndarray]]) -> None:
    """Adds to ``grad`` of every variable the derivative of sum(seed * output). Iterative, so that long series don't
    meet the recursion limit."""
    order, seen, stack = [], set(), [(v, False) for v, _ in seeds]
    while stack:
        v, done = stack.pop()
        if done:
            order.append(v)
        elif id(v) not in seen:
            seen.add(id(v))
            stack.append((v, True))
            stack.extend((p, False) for p, _ in v.parents if id(p) not in seen)
    for v in order:
        v.grad = 0.0
    for v, seed in seeds:
        v.grad = v.grad + (np.sum(seed) if np.ndim(v.value) == 0 else seed)
    for v in reversed(order):
        if v.parents and not (np.isscalar(v.grad) and v.grad == 0.0):
            for p, slope in v.parents:
                g = v.grad * slope
                p.grad = p.grad + (g.sum() if np.ndim(p.value) == 0 and np.ndim(g) else g)
