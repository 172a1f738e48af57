"""Variation of genomes that are kept as arrays (`nn/packed.py`): the rules of `variation.py`, with the same draws in the same order."""

from __future__ import annotations

import numpy as np

from galewright.evolve.populations import Islands
from galewright.evolve.variation import Mutator, moments
from galewright.nn.cells import CELLS
from galewright.nn.genome import HIDDEN, INPUT, Genome
from galewright.nn.packed import NUMBERS, Packed
from galewright.nn.training import initialize
from galewright.spec import RunConfig


def weight(rng: np.random.Generator, mu: float, sigma: float) -> float:
    return min(max(float(rng.normal(mu, sigma)), -10.0), 10.0)


class Growth:
    """Edges that one mutation adds from or to its new nodes. The weights that the draws follow are looked up again only when an edge makes other parts reachable."""

    def __init__(self, mutator: PackedMutator, genome: Packed):
        self.mutator, self.genome, self.rows, self.seen, self.forward = mutator, genome, [], set(), None

    def moments(self) -> tuple[float, float]:
        if self.forward is None:
            self.flush()
            g = self.genome
            self.forward, self.backward, *_ = g.ends()
            own, now, later = g.slots()
            self.before, self.after, self.now, self.later = np.concatenate((g.node_weights[own], g.weight[now])), g.weight[later], [], []
            self.known = None
        if self.known is None:
            self.known = moments(np.concatenate((self.before, self.now, self.after, self.later)))
        return self.known

    def connect(self, source: int, target: int, delay: int) -> bool:
        if (source, target, delay) in self.seen:
            return False
        self.seen.add((source, target, delay))
        number = self.mutator.innovations.next_edge()
        w = weight(self.mutator.rng, *self.moments())
        self.rows.append((number, source, target, delay, w))
        ahead, back = (self.forward[source], self.forward[target]), (self.backward[source], self.backward[target])
        if (ahead[0] and not ahead[1]) or (back[1] and not back[0]):
            self.forward = None
        elif all(ahead) and all(back):
            (self.later if delay else self.now).append(w)
            self.known = None
        return True

    def flush(self) -> None:
        self.genome.append_edges(self.rows)
        self.rows = []


class PackedMutator(Mutator):
    """Lamarckian weights only."""

    def _place(self, options: np.ndarray) -> int | None:
        return int(options[int(self.rng.integers(len(options)))]) if len(options) else None

    def _alive(self, genome: Packed) -> np.ndarray:
        return np.flatnonzero(genome.ends()[2])

    def _connect(self, genome: Packed, source: int, target: int, delay: int) -> bool:
        there = np.flatnonzero((genome.source == source) & (genome.target == target) & (genome.delay == delay))
        if len(there):
            k = int(there[0])
            if genome.edge_on[k]:
                return False
            genome.switch_edge(k, True)
            return True
        number = self.innovations.next_edge()
        genome.append_edges([(number, source, target, delay, weight(self.rng, *moments(genome.get_weights())))])
        return True

    def add_edge(self, genome: Packed) -> bool:
        alive, depth = self._alive(genome), genome.depth
        a = self._place(alive)
        b = None if a is None else self._place(alive[depth[alive] != depth[a]])
        if b is None:
            return False
        low, high = (a, b) if depth[a] < depth[b] else (b, a)
        return self._connect(genome, low, high, 0)

    def add_recurrent_edge(self, genome: Packed) -> bool:
        alive = self._alive(genome)
        a, b = self._place(alive), self._place(alive[genome.layer[alive] != INPUT])
        return a is not None and b is not None and self._connect(genome, a, b, int(self.rng.integers(self.min_delay, self.max_delay + 1)))

    def _switch_edge(self, genome: Packed, on: bool) -> bool:
        k = self._place(np.flatnonzero(genome.edge_on != on))
        if k is not None:
            genome.switch_edge(k, on)
        return k is not None

    def enable_edge(self, genome: Packed) -> bool:
        return self._switch_edge(genome, True)

    def disable_edge(self, genome: Packed) -> bool:
        return self._switch_edge(genome, False)

    def _switch_node(self, genome: Packed, options: np.ndarray, on: bool) -> bool:
        k = self._place(np.flatnonzero(options))
        if k is not None:
            genome.switch_nodes([k], on)
        return k is not None

    def enable_node(self, genome: Packed) -> bool:
        return self._switch_node(genome, ~genome.on, True)

    def disable_node(self, genome: Packed) -> bool:
        return self._switch_node(genome, genome.on & (genome.layer == HIDDEN), False)

    def _new_node(self, genome: Packed, depth: float) -> int:
        cell = str(self._pick(list(self.cells)))
        number, (mu, sigma) = self.innovations.next_node(), moments(genome.get_weights())
        return genome.append_node(number, HIDDEN, NUMBERS[cell], depth, [weight(self.rng, mu, sigma) for _ in CELLS[cell].weights])

    def split_edge(self, genome: Packed) -> bool:
        edges = genome.ends()[3]
        k = self._place(edges[genome.delay[edges] == 0])
        if k is None:
            return False
        source, target = int(genome.source[k]), int(genome.target[k])
        genome.switch_edge(k, False)
        node = self._new_node(genome, float((genome.depth[source] + genome.depth[target]) / 2))
        return self._connect(genome, source, node, 0) and self._connect(genome, node, target, 0)

    def _fan(self, genome: Packed) -> tuple[int, int]:
        edges, out = genome.ends()[3], []
        for side in (genome.target, genome.source):
            _, first, counts = np.unique(side[edges], return_index=True, return_counts=True)
            c = counts[np.argsort(first)].astype(float) if len(edges) else np.ones(1)  # in order of appearance: sums of floats depend on it
            out.append(2 + max(0, int(self.rng.normal(c.mean(), c.std()))))
        return out[0], out[1]

    def add_node(self, genome: Packed) -> bool:
        depth = float(self.rng.uniform(0, 1))
        alive = self._alive(genome)
        before, after = alive[genome.depth[alive] < depth], alive[genome.depth[alive] > depth]
        if not len(before) or not len(after) or depth <= 0:
            return False
        fan_in, fan_out = self._fan(genome)
        node = self._new_node(genome, depth)
        growth = Growth(self, genome)
        for n in before[self.rng.permutation(len(before))[:fan_in]].tolist():
            growth.connect(n, node, 0)
        for n in after[self.rng.permutation(len(after))[:fan_out]].tolist():
            growth.connect(node, n, 0)
        growth.flush()
        return True

    def split_node(self, genome: Packed) -> bool:
        alive = self._alive(genome)
        n = self._place(alive[genome.layer[alive] == HIDDEN])
        if n is None:
            return False
        edges = genome.ends()[3]
        source, target = genome.source[edges], genome.target[edges]
        into, out = edges[(target == n) & (source != n)], edges[(source == n) & (target != n)]
        if not len(into) or not len(out):
            return False
        ends = genome.source[into].tolist(), genome.target[out].tolist()
        delays = genome.delay[into].tolist(), genome.delay[out].tolist()
        halves = [self._new_node(genome, float(genome.depth[n])) for _ in range(2)]
        growth = Growth(self, genome)
        for is_out, (others, delay) in enumerate(zip(ends, delays)):
            taken = self.rng.random((2, len(others))) < 0.5
            for h in range(2):
                if not taken[h].any():
                    taken[h, int(self.rng.integers(len(others)))] = True
            for k, other in enumerate(others):
                if not taken[:, k].any():
                    taken[int(self.rng.integers(2)), k] = True
                for h in range(2):
                    if taken[h, k]:
                        growth.connect(*((halves[h], other) if is_out else (other, halves[h])), delay[k])
        growth.flush()
        genome.switch_nodes([n], False)
        return True

    def merge_node(self, genome: Packed) -> bool:
        alive = self._alive(genome)
        hidden = alive[genome.layer[alive] == HIDDEN]
        if len(hidden) < 2:
            return False
        a, b = (int(hidden[int(k)]) for k in self.rng.permutation(len(hidden))[:2])
        edges, depth = genome.ends()[3], float((genome.depth[a] + genome.depth[b]) / 2)
        source, target, delay = genome.source[edges], genome.target[edges], genome.delay[edges]
        from_pair, to_pair = (source == a) | (source == b), (target == a) | (target == b)
        into = to_pair & ~from_pair & ((delay > 0) | (genome.depth[source] < depth))
        out = from_pair & ~to_pair & ((delay > 0) | (genome.depth[target] > depth))
        wanted = np.flatnonzero(into | out)
        node = self._new_node(genome, depth)
        growth = Growth(self, genome)
        for is_in, s, t, d in zip(into[wanted].tolist(), source[wanted].tolist(), target[wanted].tolist(), delay[wanted].tolist()):
            growth.connect(*((s, node) if is_in else (node, t)), d)
        growth.flush()
        genome.switch_nodes([a, b], False)
        return True


def crossover(better: Packed, worse: Packed, rng: np.random.Generator, keep_worse: float = 0.5) -> Packed:
    """`variation.crossover` with Lamarckian weights."""
    order = np.argsort(worse.number)
    place = np.minimum(np.searchsorted(worse.number[order], better.number), len(order) - 1)
    twin = order[place]
    both = (worse.number[twin] == better.number) & (worse.cell[twin] == better.cell)
    alone = ~np.isin(worse.number, better.number)
    mixed = np.flatnonzero(np.repeat(both, better.sizes))
    sizes = worse.sizes[twin[both]]
    begins = (np.cumsum(worse.sizes) - worse.sizes)[twin[both]]
    paired = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())

    joined = lambda k: np.concatenate((getattr(better, k), getattr(worse, k)))
    edge, first = np.unique(joined("edge"), return_index=True)
    ends = np.concatenate((better.number[better.source], worse.number[worse.source]))[first], np.concatenate((better.number[better.target], worse.number[worse.target]))[first]
    delay, values = joined("delay")[first], joined("weight")[first]
    alive = np.zeros(len(better.edge) + len(worse.edge), bool)
    alive[better.ends()[3]] = True
    alive[worse.ends()[3] + len(better.edge)] = True
    alive = alive[first]
    kept = np.zeros(len(edge), bool)
    most = max(better.number.max(), worse.number.max()) + 1
    kept[np.unique((ends[0] * most + ends[1]) * (delay.max(initial=0) + 1) + delay, return_index=True)[1]] = True
    in_better = first < len(better.edge)
    order = np.argsort(worse.edge)
    place = order[np.minimum(np.searchsorted(worse.edge[order], edge), len(order) - 1)] if len(order) else np.zeros(len(edge), np.int64)
    in_both = in_better & (worse.edge[place] == edge) if len(order) else np.zeros(len(edge), bool)

    asked = kept & (in_both | (~in_better & alive))
    drawn = rng.random(len(mixed) + np.count_nonzero(asked))
    mix = lambda a, b, u: np.minimum(np.maximum(a + (-0.5 + 2.0 * u) * (a - b), -10.0), 10.0)
    u = np.zeros(len(edge))
    u[asked] = drawn[len(mixed) :]
    values, on = values.copy(), alive.copy()
    values[in_both] = mix(values[in_both], worse.weight[place[in_both]], u[in_both])
    on[in_both] = True
    on &= in_better | (u < keep_worse)

    own = better.node_weights.copy()
    own[mixed] = mix(own[mixed], worse.node_weights[paired], drawn[: len(mixed)])
    nodes = {k: np.concatenate((getattr(better, k), getattr(worse, k)[alone])) for k in ("number", "layer", "cell", "depth", "on", "sizes")}
    weights = np.concatenate((own, worse.node_weights[np.repeat(alone, worse.sizes)]))
    order = np.lexsort((nodes["number"], nodes["depth"]))
    begins = (np.cumsum(nodes["sizes"]) - nodes["sizes"])[order]
    nodes = {k: v[order] for k, v in nodes.items()}
    sizes = nodes["sizes"]
    weights = weights[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    parameter = [*better.parameter, *(p for p, a in zip(worse.parameter, alone) if a)]
    by_number = np.argsort(nodes["number"])
    source, target = (by_number[np.searchsorted(nodes["number"][by_number], v[kept])] for v in ends)
    return Packed(**nodes, node_weights=weights, parameter=[parameter[k] for k in order.tolist()], edge=edge[kept], source=source, target=target, delay=delay[kept], weight=values[kept], edge_on=on[kept])


class PackedIslands(Islands):
    """Islands of packed genomes."""

    def __init__(self, config: RunConfig, seed: Genome):
        super().__init__(config, seed)
        m = self.mutator
        self.mutator = PackedMutator(self.rng, m.innovations, max_delay=m.max_delay, weights=m.weights)

    def _fresh(self) -> Packed:
        g = self.seed.copy()
        initialize(g, self.config.weight_rule, self.rng)
        packed = Packed.of(g)
        self.mutator.mutate(packed, self.config.mutations)
        return packed

    def _cross(self, better: Packed, worse: Packed) -> Packed:
        return crossover(better, worse, self.rng)


def islands(config: RunConfig, seed: Genome) -> Islands:
    """Packed where the weights of new parts follow the parents' own."""
    return (PackedIslands if config.crossover_weights == config.mutation_weights == "lamarckian" else Islands)(config, seed)
