"""Passes of a genome over series: predictions, errors, gradients."""

from __future__ import annotations

import numpy as np

from galewright.nn import tape as A
from galewright.nn.cells import CELLS
from galewright.nn.genome import INPUT, OUTPUT, Genome


def forward(genome: Genome, x: np.ndarray, inputs: list[str], weights=None, dropout: float = 0.0, rng=None):
    """Outputs per time, in the order of the genome's output nodes.

    ``x`` is (batch, time, inputs), or the same as tape variables don't need. ``weights`` are values in the place of the genome's own,
    in the order of its slots; tape variables make the outputs differentiable. Dropout zeroes edges' values in training
    and scales the others up.
    """
    nodes, _ = genome.reachable()
    live = genome.live_edges()
    slots = genome.weight_slots()
    values = list(genome.get_weights() if weights is None else weights)
    own: dict[int, list] = {}
    edge_weight: dict[int, object] = {}
    for (o, k), v in zip(slots, values):
        if isinstance(k, int):
            own.setdefault(o.innovation, []).append(v)
        else:
            edge_weight[id(o)] = v
    order = sorted((n for n in genome.nodes if n.innovation in nodes), key=lambda n: (n.depth, n.innovation))
    into: dict[int, list] = {n.innovation: [] for n in order}
    for e in live:
        into[e.target].append(e)
    place = {p: k for k, p in enumerate(inputs)}
    batch, steps, _ = x.shape
    past: dict[int, list] = {n.innovation: [] for n in order}
    state: dict[int, object] = {}
    outputs = []
    for t in range(steps):
        for n in order:
            cell = CELLS[n.cell]
            if n.layer == INPUT:
                total, any_in = x[:, t, place[n.parameter]], True
            else:
                total, any_in = 0.0, False
            for e in into[n.innovation]:
                if e.delay:
                    if t < e.delay:
                        continue
                    v = past[e.source][t - e.delay]
                else:
                    v = past[e.source][t]
                v = v * edge_weight[id(e)]
                if dropout > 0 and rng is not None:
                    v = v * ((rng.random(batch) >= dropout) / (1 - dropout))
                if cell.combine == "product":
                    total = v if not any_in else total * v
                else:
                    total = v if not any_in else total + v
                any_in = True
            if not any_in:
                total = np.zeros(batch)
            y, state[n.innovation] = cell.step(own.get(n.innovation, [0.0] * len(cell.weights)), total, state.get(n.innovation))
            past[n.innovation].append(y)
        outputs.append([past[n.innovation][t] if n.innovation in past else np.zeros(batch) for n in genome.nodes if n.layer == OUTPUT])
    return outputs


def predict(genome: Genome, x: np.ndarray, inputs: list[str]) -> np.ndarray:
    """(batch, time, outputs)."""
    out = forward(genome, x, inputs)
    return np.stack([np.stack([np.broadcast_to(v, (x.shape[0],)) for v in row], -1) for row in out], 1)


def errors(predicted: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """mse and mae: the sum over outputs of the mean over time, and the mean of that over the batch."""
    d = predicted - y
    return float((d**2).mean(1).sum(-1).mean()), float(np.abs(d).mean(1).sum(-1).mean())


def losses(rows: list[list], y: np.ndarray, loss: str) -> tuple[float, list[list[np.ndarray]]]:
    """The mean loss over the batch of outputs per time, and its derivative by each output.

    ``mse``: the sum over outputs of the mean over time of squared errors; ``mae`` of absolute ones; ``softmax``: the cross
    entropy of the outputs' softmax, summed over time.
    """
    batch, steps = y.shape[0], y.shape[1]
    total, out = 0.0, []
    for t, row in enumerate(rows):
        v = np.stack([np.broadcast_to(x.value if isinstance(x, A.Var) else x, (batch,)) for x in row], -1)
        if loss == "softmax":
            e = np.exp(v - v.max(-1, keepdims=True))
            p = e / e.sum(-1, keepdims=True)
            total += float(-(y[:, t] * np.log(np.maximum(p, 1e-300))).sum()) / batch
            slope = (p * y[:, t].sum(-1, keepdims=True) - y[:, t]) / batch
        elif loss == "mae":
            total += float(np.abs(v - y[:, t]).sum()) / (batch * steps)
            slope = np.sign(v - y[:, t]) / (batch * steps)
        else:
            total += float(((v - y[:, t]) ** 2).sum()) / (batch * steps)
            slope = 2 * (v - y[:, t]) / (batch * steps)
        out.append([slope[:, k] for k in range(v.shape[1])])
    return total, out


def loss_and_gradient(genome: Genome, x: np.ndarray, y: np.ndarray, inputs: list[str], weights=None, dropout: float = 0.0, rng=None, loss: str = "mse") -> tuple[float, np.ndarray]:
    """The mean loss over the batch and its gradient by the weights."""
    values = genome.get_weights() if weights is None else np.asarray(weights, float)
    leaves = [A.Var(np.float64(v)) for v in values]
    out = forward(genome, x, inputs, leaves, dropout, rng)
    total, slopes = losses(out, y, loss)
    A.backward([(v, s) for row, ss in zip(out, slopes) for v, s in zip(row, ss) if isinstance(v, A.Var)])
    return total, np.array([float(np.sum(v.grad)) for v in leaves])


def numeric_gradient(genome: Genome, x: np.ndarray, y: np.ndarray, inputs: list[str], step: float = 1e-5, loss: str = "mse") -> np.ndarray:
    """The gradient by central differences, for tests."""
    values, out = genome.get_weights(), []
    for k in range(len(values)):
        sides = []
        for s in (step, -step):
            w = values.copy()
            w[k] += s
            sides.append(losses(forward(genome, x, inputs, list(w)), y, loss)[0])
        out.append((sides[0] - sides[1]) / (2 * step))
    return np.array(out)
