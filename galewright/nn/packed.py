"""Genomes as arrays, for searches of thousands of generations: copies share their arrays, structure is looked up once per change.

A change never writes into an array that another genome may hold; it puts a new one in its place. `Genome` stays the form that is
written, drawn and sent; both have the same structure, order of weights and shape.
"""

from __future__ import annotations

import math

import numpy as np

from galewright.nn.cells import CELLS
from galewright.nn.genome import INPUT, OUTPUT, Edge, Genome, Node

NAMES = tuple(CELLS)
NUMBERS = {name: k for k, name in enumerate(NAMES)}
_NODES, _EDGES = ("number", "layer", "cell", "depth", "parameter", "on", "sizes", "node_weights"), ("edge", "source", "target", "delay", "weight", "edge_on")


class Packed:
    """Nodes and edges in the order of a `Genome`. Edges name nodes by place; ``sizes`` are the nodes' numbers of weights, which stand in ``node_weights`` one after the other."""

    __slots__ = (*_NODES, *_EDGES, "genome_id", "island", "generation", "fitness", "_ends", "_slots")

    def __init__(self, **parts):
        for k, v in parts.items():
            setattr(self, k, v)
        self.genome_id = self.island = self.generation = 0
        self.fitness = math.inf
        self.changed()

    @classmethod
    def of(cls, g: Genome | Packed) -> Packed:
        if isinstance(g, Packed):
            return g
        place = {n.innovation: k for k, n in enumerate(g.nodes)}
        column = lambda items, f, kind: np.array([f(v) for v in items], kind)
        out = cls(
            number=column(g.nodes, lambda n: n.innovation, np.int64), layer=column(g.nodes, lambda n: n.layer, np.int64), cell=column(g.nodes, lambda n: NUMBERS[n.cell], np.int64),
            depth=column(g.nodes, lambda n: n.depth, float), parameter=[n.parameter for n in g.nodes], on=column(g.nodes, lambda n: n.enabled, bool),
            sizes=column(g.nodes, lambda n: len(n.weights), np.int64), node_weights=np.array([w for n in g.nodes for w in n.weights], float),
            edge=column(g.edges, lambda e: e.innovation, np.int64), source=column(g.edges, lambda e: place[e.source], np.int64), target=column(g.edges, lambda e: place[e.target], np.int64),
            delay=column(g.edges, lambda e: e.delay, np.int64), weight=column(g.edges, lambda e: e.weight, float), edge_on=column(g.edges, lambda e: e.enabled, bool),
        )
        out.genome_id, out.island, out.generation, out.fitness = g.genome_id, g.island, g.generation, g.fitness
        return out

    def genome(self) -> Genome:
        weights = [w.tolist() for w in np.split(self.node_weights, np.cumsum(self.sizes)[:-1])]
        nodes = [Node(i, layer, NAMES[c], d, p, on, w) for i, layer, c, d, p, on, w in zip(self.number.tolist(), self.layer.tolist(), self.cell.tolist(), self.depth.tolist(), self.parameter, self.on.tolist(), weights)]
        edges = [Edge(*v) for v in zip(self.edge.tolist(), self.number[self.source].tolist(), self.number[self.target].tolist(), self.delay.tolist(), self.weight.tolist(), self.edge_on.tolist())]
        return Genome(nodes, edges, self.genome_id, self.island, self.generation, self.fitness)

    def to_row(self) -> dict:
        return self.genome().to_row()

    def copy(self) -> Packed:
        out = object.__new__(Packed)
        for k in Packed.__slots__:
            setattr(out, k, getattr(self, k))
        return out

    def restore(self, before: Packed) -> None:
        """The structure and weights of an earlier copy."""
        for k in (*_NODES, *_EDGES, "_ends", "_slots"):
            setattr(self, k, getattr(before, k))

    # Changes

    def changed(self) -> None:
        self._ends = self._slots = None

    def switch_edge(self, k: int, on: bool) -> None:
        self.edge_on = self.edge_on.copy()
        self.edge_on[k] = on
        self.changed()

    def switch_nodes(self, places: list[int], on: bool) -> None:
        self.on = self.on.copy()
        self.on[places] = on
        self.changed()

    def append_node(self, number: int, layer: int, cell: int, depth: float, weights: list[float]) -> int:
        for k, v in (("number", number), ("layer", layer), ("cell", cell), ("depth", depth), ("on", True), ("sizes", len(weights)), ("node_weights", weights)):
            setattr(self, k, np.append(getattr(self, k), v))
        self.parameter = [*self.parameter, None]
        self.changed()
        return len(self.number) - 1

    def append_edges(self, rows: list[tuple[int, int, int, int, float]]) -> None:
        """Enabled edges: number, places of source and target, delay, weight."""
        if rows:
            for k, v in zip(_EDGES, zip(*rows)):
                setattr(self, k, np.concatenate((getattr(self, k), np.array(v))))
            self.edge_on = np.concatenate((self.edge_on, np.ones(len(rows), bool)))
            self.changed()

    # Structure

    def ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which nodes an enabled input reaches, which reach an enabled output, which do both; places of the edges that are on between the last ones."""
        if self._ends is None:
            live = np.flatnonzero(self.edge_on & self.on[self.source] & self.on[self.target])
            s, t = self.source[live], self.target[live]

            def spread(seen: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
                n = -1
                while n != (n := np.count_nonzero(seen)):
                    seen[b[seen[a]]] = True
                return seen

            forward, backward = spread(self.on & (self.layer == INPUT), s, t), spread(self.on & (self.layer == OUTPUT), t, s)
            both = forward & backward
            self._ends = forward, backward, both, live[both[s] & both[t]]
        return self._ends

    def outputs_unreachable(self) -> bool:
        both = self.ends()[2]
        return not both[self.layer == OUTPUT].all()

    def shape(self) -> tuple[bytes, bytes, bytes]:
        _, _, nodes, edges = self.ends()
        edges = edges[np.argsort(self.edge[edges])]
        return np.sort(self.number[nodes]).tobytes(), self.edge[edges].tobytes(), self.delay[edges].tobytes()

    # Weights

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the trained weights: nodes', feed-forward edges', recurrent edges'."""
        if self._slots is None:
            _, _, nodes, edges = self.ends()
            later = self.delay[edges] > 0
            self._slots = np.flatnonzero(np.repeat(nodes, self.sizes)), edges[~later], edges[later]
        return self._slots

    def get_weights(self) -> np.ndarray:
        own, now, later = self.slots()
        return np.concatenate((self.node_weights[own], self.weight[now], self.weight[later]))

    def set_weights(self, values: np.ndarray) -> None:
        own, now, later = self.slots()
        self.node_weights, self.weight = self.node_weights.copy(), self.weight.copy()
        self.node_weights[own], self.weight[now], self.weight[later] = np.split(values, [len(own), len(own) + len(now)])
