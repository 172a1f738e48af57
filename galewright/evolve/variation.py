"""Variation of genomes: mutations, crossover, transfer. Genomes are small; every function works on one worker."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from galewright.nn.cells import CELLS
from galewright.nn.genome import HIDDEN, INPUT, OUTPUT, Edge, Genome, Node
from galewright.nn.training import initialize


def moments(weights) -> tuple[float, float]:
    """Mean of the weights clipped to +-10, and their deviation around it; (0, 0.25) for none."""
    w = np.asarray(weights, float)
    if not len(w):
        return 0.0, 0.25
    mu = float(np.clip(w, -10, 10).mean())
    return mu, float(math.sqrt(((w - mu) ** 2).sum() / max(1, len(w) - 1)))


@dataclass
class Innovations:
    """Numbers that no earlier node or edge of the run has."""

    node: int
    edge: int

    def next_node(self) -> int:
        self.node += 1
        return self.node

    def next_edge(self) -> int:
        self.edge += 1
        return self.edge


# How often each mutation is drawn, in shares of their sum.
RATES = {
    "clone": 1.0, "add_edge": 1.0, "add_recurrent_edge": 1.0, "enable_edge": 1.0, "disable_edge": 1.0, "split_edge": 0.0,
    "add_node": 1.0, "enable_node": 1.0, "disable_node": 1.0, "split_node": 1.0, "merge_node": 1.0,
}


class Live:
    """The weights of a genome's reachable parts while edges are added to it; all is looked up again only when an edge makes other parts reachable."""

    def __init__(self, genome: Genome):
        self.genome, self.forward = genome, None

    def weights(self) -> list[float]:
        if self.forward is None:
            self.forward, self.backward, live = self.genome.ends()
            nodes = self.forward & self.backward
            live = [e for e in live if e.source in nodes and e.target in nodes]
            self.own = [w for n in self.genome.nodes if n.innovation in nodes for w in n.weights]
            self.now, self.later = [e.weight for e in live if not e.delay], [e.weight for e in live if e.delay]
        return self.own + self.now + self.later

    def add(self, e: Edge) -> None:
        """An edge that was added at the end, between nodes that are on."""
        if self.forward is None:
            return
        ahead, back = (e.source in self.forward, e.target in self.forward), (e.source in self.backward, e.target in self.backward)
        if ahead == (True, False) or back == (False, True):
            self.forward = None
        elif all(ahead) and all(back):
            (self.later if e.delay else self.now).append(e.weight)


@dataclass
class Mutator:
    """Draws mutations by rate until ``count`` of them succeed."""

    rng: np.random.Generator
    innovations: Innovations
    cells: tuple[str, ...] = ("simple", "ugrnn", "mgu", "gru", "delta", "lstm")
    min_delay: int = 1
    max_delay: int = 10
    weights: str = "lamarckian"
    rates: dict[str, float] = field(default_factory=lambda: dict(RATES))

    def mutate(self, genome: Genome, count: int = 1) -> list[str]:
        names, p = list(self.rates), np.array(list(self.rates.values()))
        done: list[str] = []
        for _ in range(100 * count):
            if len(done) >= count:
                break
            name = names[int(self.rng.choice(len(names), p=p / p.sum()))]
            before = genome.copy()
            if name == "clone" or getattr(self, name)(genome):
                if genome.outputs_unreachable():
                    genome.restore(before)
                    continue
                done.append(name)
        genome.fitness = math.inf
        return done

    def _weights(self, genome: Genome, n: int, live: Live | None = None) -> list[float]:
        """A new part's weights: normal draws with the moments of the genome's own, or by the named rule."""
        if self.weights == "gp":
            return [1.0] * n
        if self.weights == "random":
            return [float(self.rng.uniform(-0.5, 0.5)) for _ in range(n)]
        if self.weights in ("xavier", "kaiming"):
            fan_in, fan_out = self._averages(genome)
            draw = (lambda: self.rng.uniform(-1, 1) * math.sqrt(6 / (fan_in + fan_out))) if self.weights == "xavier" else (lambda: self.rng.normal(0, math.sqrt(2 / fan_in)))
            return [float(draw()) for _ in range(n)]
        mu, sigma = moments((live or Live(genome)).weights())
        return [min(max(float(self.rng.normal(mu, sigma)), -10.0), 10.0) for _ in range(n)]

    def _pick(self, options: list):
        return options[int(self.rng.integers(len(options)))] if options else None

    def _alive(self, genome: Genome) -> list[Node]:
        nodes, _ = genome.reachable()
        return [n for n in genome.nodes if n.innovation in nodes]

    def _connect(self, genome: Genome, source: Node, target: Node, delay: int, live: Live | None = None) -> bool:
        """A new edge, or an old disabled one enabled; False if an enabled one is there. ``live`` is kept between the edges of one mutation."""
        a, b, live = source.innovation, target.innovation, live or Live(genome)
        for e in genome.edges:
            if e.source == a and e.target == b and e.delay == delay:
                if e.enabled:
                    return False
                e.enabled, live.forward = True, None
                return True
        genome.edges.append(Edge(self.innovations.next_edge(), a, b, delay, self._weights(genome, 1, live)[0]))
        if source.enabled and target.enabled:
            live.add(genome.edges[-1])
        return True

    def add_edge(self, genome: Genome) -> bool:
        alive = self._alive(genome)
        a = self._pick(alive)
        b = self._pick([n for n in alive if a and n.depth != a.depth])
        if not a or not b:
            return False
        low, high = (a, b) if a.depth < b.depth else (b, a)
        return self._connect(genome, low, high, 0)

    def add_recurrent_edge(self, genome: Genome) -> bool:
        alive = self._alive(genome)
        a, b = self._pick(alive), self._pick([n for n in alive if n.layer != INPUT])
        return bool(a and b) and self._connect(genome, a, b, int(self.rng.integers(self.min_delay, self.max_delay + 1)))

    def enable_edge(self, genome: Genome) -> bool:
        e = self._pick([e for e in genome.edges if not e.enabled])
        if e:
            e.enabled = True
        return e is not None

    def disable_edge(self, genome: Genome) -> bool:
        e = self._pick([e for e in genome.edges if e.enabled])
        if e:
            e.enabled = False
        return e is not None

    def _new_node(self, genome: Genome, depth: float) -> Node:
        cell = str(self._pick(list(self.cells)))
        node = Node(self.innovations.next_node(), HIDDEN, cell, depth, None, True, self._weights(genome, len(CELLS[cell].weights)))
        genome.nodes.append(node)
        return node

    def split_edge(self, genome: Genome) -> bool:
        e = self._pick([e for e in genome.live_edges() if not e.delay])
        if not e:
            return False
        by = {n.innovation: n for n in genome.nodes}
        e.enabled = False
        node = self._new_node(genome, (by[e.source].depth + by[e.target].depth) / 2)
        return self._connect(genome, by[e.source], node, 0) and self._connect(genome, node, by[e.target], 0)

    def _averages(self, genome: Genome) -> tuple[float, float]:
        """Edges into and out of a node, on average over those that have some; 1 at least."""
        live = [e for e in genome.edges if e.enabled]
        return tuple(max(1.0, len(live) / max(1, len({getattr(e, side) for e in live}))) for side in ("target", "source"))

    def _fan(self, genome: Genome) -> tuple[int, int]:
        """How many edges a new node takes in and gives out: 2 and a normal draw around the hidden nodes' averages."""
        live = genome.live_edges()
        out = []
        for side in ("target", "source"):
            counts: dict[int, int] = {}
            for e in live:
                counts[getattr(e, side)] = counts.get(getattr(e, side), 0) + 1
            c = np.array(list(counts.values()) or [1.0], float)
            out.append(2 + max(0, int(self.rng.normal(c.mean(), c.std()))))
        return out[0], out[1]

    def add_node(self, genome: Genome) -> bool:
        depth = float(self.rng.uniform(0, 1))
        alive = self._alive(genome)
        before, after = [n for n in alive if n.depth < depth], [n for n in alive if n.depth > depth]
        if not before or not after or depth <= 0:
            return False
        fan_in, fan_out = self._fan(genome)
        node, kept = self._new_node(genome, depth), Live(genome)
        for n in self.rng.permutation(len(before))[:fan_in]:
            self._connect(genome, before[int(n)], node, 0, kept)
        for n in self.rng.permutation(len(after))[:fan_out]:
            self._connect(genome, node, after[int(n)], 0, kept)
        return True

    def enable_node(self, genome: Genome) -> bool:
        n = self._pick([n for n in genome.nodes if not n.enabled])
        if n:
            n.enabled = True
        return n is not None

    def disable_node(self, genome: Genome) -> bool:
        n = self._pick([n for n in genome.nodes if n.enabled and n.layer == HIDDEN])
        if n:
            n.enabled = False
        return n is not None

    def split_node(self, genome: Genome) -> bool:
        """A hidden node becomes two; each of its edges goes to one or both halves, none stays without."""
        n = self._pick([n for n in self._alive(genome) if n.layer == HIDDEN])
        if not n:
            return False
        by = {m.innovation: m for m in genome.nodes}
        live = genome.live_edges()
        into, out = [e for e in live if e.target == n.innovation and e.source != n.innovation], [e for e in live if e.source == n.innovation and e.target != n.innovation]
        if not into or not out:
            return False
        halves, kept = [self._new_node(genome, n.depth) for _ in range(2)], Live(genome)
        for side, is_in in ((into, True), (out, False)):
            taken = self.rng.random((2, len(side))) < 0.5
            for h in range(2):
                if not taken[h].any():
                    taken[h, int(self.rng.integers(len(side)))] = True
            for k, e in enumerate(side):
                if not taken[:, k].any():
                    taken[int(self.rng.integers(2)), k] = True
                for h in range(2):
                    if taken[h, k]:
                        self._connect(genome, by[e.source] if is_in else halves[h], halves[h] if is_in else by[e.target], e.delay, kept)
        n.enabled = False
        return True

    def merge_node(self, genome: Genome) -> bool:
        """Two hidden nodes become one at their mean depth that has the edges of both."""
        hidden = [n for n in self._alive(genome) if n.layer == HIDDEN]
        if len(hidden) < 2:
            return False
        a, b = (hidden[int(k)] for k in self.rng.permutation(len(hidden))[:2])
        live, by = genome.live_edges(), {m.innovation: m for m in genome.nodes}
        node, kept = self._new_node(genome, (a.depth + b.depth) / 2), Live(genome)
        pair = {a.innovation, b.innovation}
        for e in live:
            if e.target in pair and e.source not in pair and (e.delay or by[e.source].depth < node.depth):
                self._connect(genome, by[e.source], node, e.delay, kept)
            if e.source in pair and e.target not in pair and (e.delay or by[e.target].depth > node.depth):
                self._connect(genome, node, by[e.target], e.delay, kept)
        a.enabled = b.enabled = False
        return True


def crossover(better: Genome, worse: Genome, rng: np.random.Generator, keep_worse: float = 0.5, rule: str = "lamarckian") -> Genome:
    """A child of both parents' edges, matched by innovation number. Edges in both are enabled and have weights w1 + r (w1 - w2) with
    r from U(-0.5, 1.5); with a rule other than ``lamarckian`` all of the child's weights are drawn by it. Edges of the better parent alone are enabled if they are reachable there, of the worse alone
    with chance ``keep_worse`` and if reachable. Each node and each (source, target, delay) comes once."""
    alive = {id(e) for g in (better, worse) for e in g.live_edges()}
    first, second = {e.innovation: e for e in better.edges}, {e.innovation: e for e in worse.edges}
    mix = lambda a, b: min(max(float(a + rng.uniform(-0.5, 1.5) * (a - b)), -10.0), 10.0)
    nodes: dict[int, Node] = {}
    others = {n.innovation: n for n in worse.nodes}
    for k, n in enumerate([*better.nodes, *worse.nodes]):
        if n.innovation in nodes:
            continue
        twin = others.get(n.innovation)
        both = k < len(better.nodes) and twin is not None and twin.cell == n.cell
        weights = [mix(a, b) for a, b in zip(n.weights, twin.weights)] if both else list(n.weights)
        nodes[n.innovation] = Node(n.innovation, n.layer, n.cell, n.depth, n.parameter, n.enabled, weights)
    edges: list[Edge] = []
    taken: set[tuple[int, int, int]] = set()
    for k in sorted(first.keys() | second.keys()):
        a, b = first.get(k), second.get(k)
        e = a or b
        if (e.source, e.target, e.delay) in taken or e.source not in nodes or e.target not in nodes:
            continue
        taken.add((e.source, e.target, e.delay))
        if a and b:
            edges.append(Edge(k, e.source, e.target, e.delay, mix(a.weight, b.weight), True))
        else:
            enabled = id(e) in alive and (a is not None or rng.random() < keep_worse)
            edges.append(Edge(k, e.source, e.target, e.delay, e.weight, enabled))
    child = Genome(sorted(nodes.values(), key=lambda n: (n.depth, n.innovation)), edges)
    if rule != "lamarckian":
        initialize(child, rule, rng)
    return child


def distance(a: Genome, b: Genome, c1: float = 1.0, c2: float = 1.0, c3: float = 0.4) -> float:
    """c1 * excess / N + c2 * disjoint / N + c3 * |difference of mean weights|, N the number of innovations of the union."""
    x, y = {e.innovation for e in a.edges}, {e.innovation for e in b.edges}
    union = len(x | y)
    if not union:
        return 0.0
    excess = sum(v > max(y, default=-1) for v in x - y) + sum(v > max(x, default=-1) for v in y - x)
    disjoint = len(x ^ y) - excess
    return c1 * excess / union + c2 * disjoint / union + c3 * abs(a.average_weight() - b.average_weight())


def transfer(genome: Genome, inputs: list[str], outputs: list[str], mutator: Mutator, versions: tuple[int, ...] = (1,)) -> Genome:
    """The genome with other input and output columns. Columns of the same name stay, missing ones go with their edges.
    New ones are connected: version 1 to all outputs (all inputs, for an output), version 2 to random hidden nodes as
    many as the average has, version 3 to all hidden nodes."""
    out = genome.copy()
    wanted = {INPUT: inputs, OUTPUT: outputs}
    gone = {n.innovation for n in out.nodes if n.layer in wanted and n.parameter not in wanted[n.layer]}
    out.nodes = [n for n in out.nodes if n.innovation not in gone]
    out.edges = [e for e in out.edges if e.source not in gone and e.target not in gone]
    hidden = [n for n in out.nodes if n.layer == HIDDEN]
    for layer, names in wanted.items():
        have = {n.parameter for n in out.nodes if n.layer == layer}
        for name in names:
            if name in have:
                continue
            node = Node(mutator.innovations.next_node(), layer, "linear", float(layer == OUTPUT), name, True, [0.0])
            out.nodes.append(node)
            partners: list[Node] = []
            if 1 in versions:
                partners += [n for n in out.nodes if n.layer == (OUTPUT if layer == INPUT else INPUT)]
            if 2 in versions and hidden:
                k = mutator._fan(out)[layer == INPUT]
                partners += [hidden[int(i)] for i in mutator.rng.permutation(len(hidden))[:k]]
            if 3 in versions:
                partners += hidden
            for p in dict.fromkeys(n.innovation for n in partners):
                other = next(n for n in out.nodes if n.innovation == p)
                mutator._connect(out, node if layer == INPUT else other, other if layer == INPUT else node, 0)
    order = {name: k for k, name in enumerate(outputs)}
    out.nodes.sort(key=lambda n: (n.layer == OUTPUT, order.get(n.parameter, 0) if n.layer == OUTPUT else 0, n.depth, n.innovation))
    out.fitness = math.inf
    return out


def simplex_step(best: dict[str, float], others: list[dict[str, float]], bounds: dict[str, tuple[float, float]], rng: np.random.Generator) -> dict[str, float]:
    """New hyper-parameters on the line from the mean of some genomes' through the best one's: mean + r (best - mean) with r
    from U(-0.5, 1.5), within bounds."""
    r = rng.uniform(-0.5, 1.5)
    out = {}
    for k, (low, high) in bounds.items():
        mean = float(np.mean([o[k] for o in others]))
        out[k] = float(np.clip(mean + r * (best[k] - mean), low, high))
    return out
