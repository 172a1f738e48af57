"""Weight rules, optimisers and training loops."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from galewright.nn.genome import Genome
from galewright.nn.network import errors, loss_and_gradient, predict


@dataclass
class Optimizer:
    """One step of a named method; weights stay within +-10."""

    method: str = "adam"
    rate: float = 0.001
    momentum: float = 0.9
    decay: float = 0.9
    beta1: float = 0.9
    beta2: float = 0.99
    epsilon: float = 1e-8
    high: float | None = 1.0
    low: float | None = 0.05
    velocity: np.ndarray | None = field(default=None, repr=False)
    mean: np.ndarray | None = field(default=None, repr=False)
    steps: int = 0

    def scaled(self, gradient: np.ndarray) -> np.ndarray:
        """The gradient with its norm brought down to ``high`` or up to ``low``; a zero gradient stays."""
        norm = float(np.sqrt((gradient**2).sum()))
        if self.high is not None and norm > self.high:
            return gradient * (self.high / norm)
        if self.low is not None and 0 < norm < self.low:
            return gradient * (self.low / norm)
        return gradient

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        g = self.scaled(gradient)
        if self.velocity is None:
            self.velocity, self.mean = np.zeros_like(g), np.zeros_like(g)
        self.steps += 1
        v = self.velocity
        if self.method == "vanilla":
            move = -self.rate * g
        elif self.method == "momentum":
            self.velocity = self.momentum * v - self.rate * g
            move = self.velocity
        elif self.method == "nesterov":
            self.velocity = self.momentum * v - self.rate * g
            move = (1 + self.momentum) * self.velocity - self.momentum * v
        elif self.method in ("adagrad", "rmsprop"):
            self.velocity = v + g * g if self.method == "adagrad" else self.decay * v + (1 - self.decay) * g * g
            move = -self.rate * g / (np.sqrt(self.velocity) + self.epsilon)
        elif self.method in ("adam", "adam-bias"):
            self.mean = self.beta1 * self.mean + (1 - self.beta1) * g
            self.velocity = self.beta2 * v + (1 - self.beta2) * g * g
            m, s = self.mean, self.velocity
            if self.method == "adam-bias":
                m, s = m / (1 - self.beta1**self.steps), s / (1 - self.beta2**self.steps)
            move = -self.rate * m / (np.sqrt(s) + self.epsilon)
        else:
            raise ValueError(f"unknown update method {self.method}")
        return np.clip(weights + move, -10, 10)


def initialize(genome: Genome, rule: str, rng: np.random.Generator) -> None:
    """New weights for all nodes and edges. ``random``: U(-0.5, 0.5); ``xavier``: U(-r, r) with r = sqrt(6 / (in + out));
    ``kaiming``: N(0, sqrt(2 / in)); ``gp``: edges 1, nodes 0."""
    fan_in: dict[int, int] = {}
    fan_out: dict[int, int] = {}
    for e in genome.edges:
        if e.enabled:
            fan_in[e.target] = fan_in.get(e.target, 0) + 1
            fan_out[e.source] = fan_out.get(e.source, 0) + 1

    def draw(node: int, n: int) -> np.ndarray:
        i, o = fan_in.get(node, 0), fan_out.get(node, 0)
        if rule == "random":
            return rng.uniform(-0.5, 0.5, n)
        if rule == "xavier":
            limit = math.sqrt(6 / max(1, i + o))
            return rng.uniform(-limit, limit, n)
        if rule == "kaiming":
            return rng.normal(0, math.sqrt(2 / max(1, i)), n)
        raise ValueError(f"unknown weight rule {rule}")

    for n in genome.nodes:
        n.weights = [0.0] * len(n.weights) if rule == "gp" else [float(v) for v in draw(n.innovation, len(n.weights))]
    for e in genome.edges:
        e.weight = 1.0 if rule == "gp" else float(draw(e.target, 1)[0])


def train(
    genome: Genome, x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray, inputs: list[str], iterations: int = 10, optimizer: Optimizer | None = None,
    batch: int = 1, seed: int = 1, dropout: float = 0.0, loss: str = "mse",
) -> list[dict]:
    """Back-propagation through time, in shuffled batches of episodes (``batch`` 1: after each episode; the number of all:
    full batches). The genome ends with its best validation weights and their mse as fitness; a step that isn't finite
    ends training with a fitness of NaN. Returns the log of each iteration."""
    optimizer, rng = optimizer or Optimizer(), np.random.default_rng(seed)
    weights = genome.get_weights()
    best_weights, log = weights.copy(), []
    best = errors(predict(genome, vx, inputs), vy)[0]
    for it in range(iterations):
        total = 0.0
        order = rng.permutation(len(x))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            value, gradient = loss_and_gradient(genome, x[rows], y[rows], inputs, weights, dropout, rng, loss)
            if not (math.isfinite(value) and np.isfinite(gradient).all()):
                genome.fitness = math.nan
                return log
            weights = optimizer.step(weights, gradient)
            total += value * len(rows)
        genome.set_weights(weights)
        mse, mae = errors(predict(genome, vx, inputs), vy)
        if mse < best:
            best, best_weights = mse, weights.copy()
        log.append({"iteration": it, "train_loss": total / len(x), "validation_mse": mse, "validation_mae": mae, "best_validation_mse": best})
    genome.set_weights(best_weights)
    genome.fitness = best
    return log
