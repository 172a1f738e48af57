"""Evolved convolutional networks: feature maps joined by filters and pools of whatever size the maps' sizes ask for."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np

from galewright.operators.images import clamped_relu, max_pool, max_pool_gradient, pool_sizes, softmax_rows, velocity_step

INPUT, HIDDEN, OUTPUT = 0, 1, 2
CONV, POOL = 0, 1


@dataclass
class Map:
    """A feature map with its scale and offset after normalisation, and the running moments for tests."""

    innovation: int
    kind: int
    depth: float
    size_y: int
    size_x: int
    gamma: float = 1.0
    beta: float = 0.0
    mean: float = 0.0
    var: float = 1.0
    enabled: bool = True


@dataclass
class Link:
    innovation: int
    source: int
    target: int
    kind: int = CONV
    weights: np.ndarray | None = None
    velocity: np.ndarray | None = None
    enabled: bool = True


@dataclass
class Hyper:
    """Learning hyper-parameters, with their change per epoch."""

    rate: float = 0.01
    rate_change: float = 0.95
    mu: float = 0.9
    mu_change: float = 0.95
    decay: float = 0.0
    decay_change: float = 0.95
    input_dropout: float = 0.0
    hidden_dropout: float = 0.0
    running: float = 0.1
    batch: int = 32


@dataclass
class ConvGenome:
    maps: list[Map]
    links: list[Link]
    hyper: Hyper = field(default_factory=Hyper)
    genome_id: int = 0
    error: float = math.inf
    correct: int = 0

    def copy(self) -> ConvGenome:
        links = [replace(k, weights=None if k.weights is None else k.weights.copy(), velocity=None if k.velocity is None else k.velocity.copy()) for k in self.links]
        return replace(self, maps=[replace(m) for m in self.maps], links=links, hyper=replace(self.hyper))

    def by(self) -> dict[int, Map]:
        return {m.innovation: m for m in self.maps}

    def live(self) -> list[Link]:
        """Enabled links on a path from an input to an output."""
        by = self.by()
        on = [k for k in self.links if k.enabled and by[k.source].enabled and by[k.target].enabled]
        forward = {m.innovation for m in self.maps if m.kind == INPUT and m.enabled}
        for k in sorted(on, key=lambda k: by[k.source].depth):
            if k.source in forward:
                forward.add(k.target)
        backward = {m.innovation for m in self.maps if m.kind == OUTPUT}
        for k in sorted(on, key=lambda k: -by[k.target].depth):
            if k.target in backward:
                backward.add(k.source)
        return [k for k in on if k.source in forward and k.target in backward]

    def shape(self, link: Link) -> tuple[int, int]:
        """The filter's size: with it the source's map becomes the target's."""
        a, b = self.by()[link.source], self.by()[link.target]
        return abs(a.size_y - b.size_y) + 1, abs(a.size_x - b.size_x) + 1

    def initialize(self, rng: np.random.Generator) -> None:
        """Filters from N(0, sqrt(2 / inputs of the target)), pools with weight 1."""
        fan: dict[int, int] = {}
        for k in self.links:
            fan[k.target] = fan.get(k.target, 0) + (int(np.prod(self.shape(k))) if k.kind == CONV else 1)
        for k in self.links:
            size = self.shape(k) if k.kind == CONV else (1, 1)
            if k.weights is None or k.weights.shape != size:
                k.weights = rng.normal(0, math.sqrt(2 / max(1, fan[k.target])), size) if k.kind == CONV else np.ones(size)
                k.velocity = np.zeros(size)


def _pads(a: Map, b: Map, w: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Padding and filter of a link: a direction in which the map grows is padded and its filter runs backwards."""
    grows_y, grows_x = b.size_y > a.size_y, b.size_x > a.size_x
    pad = [(0, 0), (w.shape[0] - 1,) * 2 if grows_y else (0, 0), (w.shape[1] - 1,) * 2 if grows_x else (0, 0)]
    return pad, w[:: -1 if grows_y else 1, :: -1 if grows_x else 1]


def _correlate(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.einsum("byxij,ij->byx", np.lib.stride_tricks.sliding_window_view(x, w.shape, axis=(1, 2)), w)


def run(g: ConvGenome, x: np.ndarray, labels: np.ndarray, training: bool, rng: np.random.Generator) -> tuple[float, int, dict, np.ndarray]:
    """Cross entropy summed over pictures (batch, channels, y, x), right answers, gradients by link and map (in training), class scores."""
    by, live, h = g.by(), g.live(), g.hyper
    order = sorted(g.maps, key=lambda m: (m.depth, m.innovation))
    into: dict[int, list[Link]] = {m.innovation: [] for m in order}
    for k in live:
        into[k.target].append(k)
    inputs = [m for m in order if m.kind == INPUT]
    outputs = [m for m in g.maps if m.kind == OUTPUT]
    value, saved = {}, {}
    n = len(x)
    for c, m in enumerate(inputs):
        v = x[:, c]
        if training and h.input_dropout > 0:
            v = v * (rng.random(v.shape) >= h.input_dropout)
        elif h.input_dropout > 0:
            v = v * (1 - h.input_dropout)
        value[m.innovation] = v
    for m in order:
        if m.kind == INPUT:
            continue
        total = np.zeros((n, m.size_y, m.size_x))
        for k in into[m.innovation]:
            a = value[k.source]
            if k.kind == CONV:
                pad, w = _pads(by[k.source], m, k.weights)
                total += _correlate(np.pad(a, pad), w)
            else:
                ys, xs = pool_sizes(a.shape[1], m.size_y, rng if training else None), pool_sizes(a.shape[2], m.size_x, rng if training else None)
                saved[k.innovation] = (ys, xs)
                total += max_pool(a, ys, xs) * k.weights[0, 0]
        if m.kind == OUTPUT:
            value[m.innovation] = total
            continue
        if training:
            mean, var = float(total.mean()), float(total.var()) + 1e-7
            m.mean, m.var = (1 - h.running) * m.mean + h.running * mean, (1 - h.running) * m.var + h.running * var
        else:
            mean, var = m.mean, m.var
        unit = (total - mean) / math.sqrt(var)
        y, slope = clamped_relu(m.gamma * unit + m.beta)
        if h.hidden_dropout > 0:
            mask = (rng.random(y.shape) >= h.hidden_dropout) if training else 1 - h.hidden_dropout
            y, slope = y * mask, slope * mask
        value[m.innovation], saved[-m.innovation] = y, (unit, slope, math.sqrt(var))
    scores = np.stack([value[m.innovation][:, 0, 0] for m in outputs], 1)
    p = softmax_rows(scores)
    loss = float(-np.log(np.maximum(p[np.arange(n), labels], 1e-12)).sum())
    right = int((scores.argmax(1) == labels).sum())
    if not training:
        return loss, right, {}, scores
    grads: dict = {}
    delta = {m.innovation: np.zeros_like(value[m.innovation]) for m in order}
    target = p.copy()
    target[np.arange(n), labels] -= 1
    for c, m in enumerate(outputs):
        delta[m.innovation][:, 0, 0] = target[:, c]
    for m in reversed(order):
        if m.kind == INPUT:
            continue
        d = delta[m.innovation]
        if m.kind == HIDDEN:
            unit, slope, sd = saved[-m.innovation]
            d = d * slope
            grads["map", m.innovation] = (float((d * unit).sum()), float(d.sum()))
            d = m.gamma / sd * (d - d.mean() - unit * (d * unit).mean())
        for k in into[m.innovation]:
            a = value[k.source]
            if k.kind == CONV:
                pad, w = _pads(by[k.source], m, k.weights)
                padded = np.pad(a, pad)
                windows = np.lib.stride_tricks.sliding_window_view(padded, w.shape, axis=(1, 2))
                gw = np.einsum("byxij,byx->ij", windows, d)
                grads["link", k.innovation] = gw[:: -1 if pad[1][0] else 1, :: -1 if pad[2][0] else 1] if (pad[1][0] or pad[2][0]) else gw
                full = _correlate(np.pad(d, [(0, 0), (w.shape[0] - 1,) * 2, (w.shape[1] - 1,) * 2]), w[::-1, ::-1])
                (py, _), (px, _) = pad[1], pad[2]
                delta[k.source] += full[:, py : py + a.shape[1], px : px + a.shape[2]]
            else:
                ys, xs = saved[k.innovation]
                grads["link", k.innovation] = np.array([[float((max_pool(a, ys, xs) * d).sum())]])
                delta[k.source] += max_pool_gradient(a, ys, xs, d * k.weights[0, 0])
    return loss, right, grads, scores


def evaluate(g: ConvGenome, x: np.ndarray, labels: np.ndarray) -> tuple[float, int]:
    loss, right, _, _ = run(g, x, labels, False, np.random.default_rng(0))
    return loss, right


def train_pictures(g: ConvGenome, x: np.ndarray, labels: np.ndarray, vx: np.ndarray, vlabels: np.ndarray, epochs: int, seed: int = 1) -> list[dict]:
    """Shuffled batches with Nesterov momentum; after each epoch the hyper-parameters change, and weights go back to the best ones where
    the validation error is 2.5 times the best or more. Ends with the best weights and their error."""
    rng, h = np.random.default_rng(seed), replace(g.hyper)
    best, log = g.copy(), []
    best.error, best.correct = evaluate(g, vx, vlabels)
    mapped: dict[int, tuple[np.ndarray, np.ndarray]] = {m.innovation: (np.zeros(1), np.zeros(1)) for m in g.maps}
    for epoch in range(epochs):
        order, total = rng.permutation(len(x)), 0.0
        for a in range(0, len(order), h.batch):
            rows = order[a : a + h.batch]
            loss, _, grads, _ = run(g, x[rows], labels[rows], True, rng)
            total += loss
            for k in g.links:
                if ("link", k.innovation) in grads:
                    k.weights, k.velocity = velocity_step(k.weights, grads["link", k.innovation] / len(rows), k.velocity, h.mu, h.rate, h.decay)
            for m in g.maps:
                if ("map", m.innovation) in grads:
                    dg, db = (np.array([v / len(rows)]) for v in grads["map", m.innovation])
                    vg, vb = mapped[m.innovation]
                    (new_g, vg), (new_b, vb) = velocity_step(np.array([m.gamma]), dg, vg, h.mu, h.rate, 0.0), velocity_step(np.array([m.beta]), db, vb, h.mu, h.rate, 0.0)
                    m.gamma, m.beta, mapped[m.innovation] = float(new_g[0]), float(new_b[0]), (vg, vb)
        error, right = evaluate(g, vx, vlabels)
        log.append({"epoch": epoch, "training_error": total, "validation_error": error, "validation_correct": right})
        if error < best.error:
            best = g.copy()
            best.error, best.correct = error, right
        elif error >= 2.5 * best.error or not math.isfinite(error):
            kept = best.copy()
            g.maps, g.links = kept.maps, kept.links
        h.rate, h.mu, h.decay = h.rate * h.rate_change, 1 - (1 - h.mu) * h.mu_change, h.decay * h.decay_change
    g.maps, g.links, g.error, g.correct = best.maps, best.links, best.error, best.correct
    return log


def seed_convnet(channels: int, size_y: int, size_x: int, classes: int) -> ConvGenome:
    """Inputs joined straight to the outputs."""
    maps = [Map(c + 1, INPUT, 0.0, size_y, size_x) for c in range(channels)] + [Map(channels + c + 1, OUTPUT, 1.0, 1, 1) for c in range(classes)]
    links = [Link(k + 1, s.innovation, t.innovation) for k, (s, t) in enumerate((s, t) for s in maps[:channels] for t in maps[channels:])]
    return ConvGenome(maps, links)


def mutate_convnet(g: ConvGenome, rng: np.random.Generator, counters: list[int], tries: int = 50) -> str | None:
    """One mutation that keeps every output reachable: a link added, disabled, enabled or split by a new map, or a map's size changed.
    ``counters`` are the last map and link numbers."""
    outputs = {m.innovation for m in g.maps if m.kind == OUTPUT}
    for _ in range(tries):
        before, by = g.copy(), g.by()
        op = str(rng.choice(["add_link", "disable_link", "enable_link", "split_link", "change_size", "change_kind"]))
        pick = lambda options: options[int(rng.integers(len(options)))] if options else None
        done = False
        if op == "add_link":
            a, b = pick([m for m in g.maps if m.kind != OUTPUT]), pick([m for m in g.maps if m.kind != INPUT])
            if a and b and a.depth < b.depth and not any((k.source, k.target) == (a.innovation, b.innovation) for k in g.links):
                counters[1] += 1
                g.links.append(Link(counters[1], a.innovation, b.innovation, int(rng.integers(2)) if a.size_y >= b.size_y and a.size_x >= b.size_x else CONV))
                done = True
        elif op in ("disable_link", "enable_link"):
            k = pick([k for k in g.links if k.enabled == (op == "disable_link")])
            if k:
                k.enabled, done = not k.enabled, True
        elif op == "split_link":
            k = pick(g.live())
            if k:
                a, b = by[k.source], by[k.target]
                counters[0] += 1
                m = Map(counters[0], HIDDEN, (a.depth + b.depth) / 2, max(1, round((a.size_y + b.size_y) / 2)), max(1, round((a.size_x + b.size_x) / 2)))
                g.maps.append(m)
                for s, t in ((a, m), (m, b)):
                    counters[1] += 1
                    g.links.append(Link(counters[1], s.innovation, t.innovation))
                k.enabled, done = False, True
        elif op == "change_size":
            m = pick([m for m in g.maps if m.kind == HIDDEN])
            if m:
                m.size_y, m.size_x, done = max(1, m.size_y + int(rng.integers(-2, 3))), max(1, m.size_x + int(rng.integers(-2, 3))), True
        else:
            k = pick([k for k in g.links if k.enabled])
            if k:
                k.kind, done = 1 - k.kind, True
        by = g.by()
        bad_pool = any(k.kind == POOL and (by[k.source].size_y < by[k.target].size_y or by[k.source].size_x < by[k.target].size_x) for k in g.links)
        if done and not bad_pool and outputs <= {k.target for k in g.live()}:
            g.initialize(rng)
            g.error = math.inf
            return op
        g.maps, g.links = before.maps, before.links
    return None


def cross_convnets(better: ConvGenome, worse: ConvGenome, rng: np.random.Generator, keep: float = 0.5) -> ConvGenome:
    """The better genome's maps and links, and with a chance those that only the worse one has; shared filters are the better's."""
    child = better.copy()
    have = {m.innovation for m in child.maps}
    taken = {(k.source, k.target) for k in child.links}
    for k in worse.links:
        if (k.source, k.target) in taken or rng.random() >= keep:
            continue
        for end in (k.source, k.target):
            if end not in have:
                child.maps.append(replace(worse.by()[end]))
                have.add(end)
        child.links.append(replace(k, weights=None, velocity=None))
        taken.add((k.source, k.target))
    by = child.by()
    child.links = [k for k in child.links if by[k.source].depth < by[k.target].depth and (k.kind == CONV or (by[k.source].size_y >= by[k.target].size_y and by[k.source].size_x >= by[k.target].size_x))]
    child.initialize(rng)
    child.error = math.inf
    return child
