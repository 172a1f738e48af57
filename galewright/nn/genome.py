"""Genomes: networks as data. A genome is one row of nested arrays in a table; here it is a small object on one worker."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import types as T

from galewright.nn.cells import CELLS

INPUT, HIDDEN, OUTPUT = 0, 1, 2

SCHEMA = T.StructType(
    [
        T.StructField("genome_id", T.LongType()), T.StructField("island", T.IntegerType()), T.StructField("generation", T.IntegerType()), T.StructField("fitness", T.DoubleType()),
        T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("innovation", T.IntegerType()), T.StructField("layer", T.IntegerType()), T.StructField("cell", T.StringType()), T.StructField("depth", T.DoubleType()),
            T.StructField("parameter", T.StringType()), T.StructField("enabled", T.BooleanType()), T.StructField("weights", T.ArrayType(T.DoubleType()))]))),
        T.StructField("edges", T.ArrayType(T.StructType([T.StructField("innovation", T.IntegerType()), T.StructField("source", T.IntegerType()), T.StructField("target", T.IntegerType()), T.StructField("delay", T.IntegerType()),
            T.StructField("weight", T.DoubleType()), T.StructField("enabled", T.BooleanType())]))),
    ]
)


@dataclass
class Node:
    innovation: int
    layer: int
    cell: str
    depth: float
    parameter: str | None = None
    enabled: bool = True
    weights: list[float] = field(default_factory=list)


@dataclass
class Edge:
    """A connection; a delay of 0 is feed-forward, of k lets the value of time t reach time t + k."""

    innovation: int
    source: int
    target: int
    delay: int = 0
    weight: float = 0.0
    enabled: bool = True


@dataclass
class Genome:
    nodes: list[Node]
    edges: list[Edge]
    genome_id: int = 0
    island: int = 0
    generation: int = 0
    fitness: float = math.inf

    def copy(self) -> Genome:
        nodes = [Node(n.innovation, n.layer, n.cell, n.depth, n.parameter, n.enabled, n.weights[:]) for n in self.nodes]
        edges = [Edge(e.innovation, e.source, e.target, e.delay, e.weight, e.enabled) for e in self.edges]
        return replace(self, nodes=nodes, edges=edges)

    def restore(self, before: Genome) -> None:
        """The structure and weights of an earlier copy."""
        self.nodes, self.edges = before.nodes, before.edges

    # Rows

    def to_row(self) -> dict:
        return {
            "genome_id": self.genome_id, "island": self.island, "generation": self.generation, "fitness": float(self.fitness),
            "nodes": [vars(n) | {"weights": [float(x) for x in n.weights]} for n in self.nodes], "edges": [dict(vars(e)) for e in self.edges],
        }

    @classmethod
    def from_row(cls, row) -> Genome:
        get = (lambda r, k: r[k]) if not hasattr(row, "asDict") else (lambda r, k: r[k])
        as_dict = lambda r: r.asDict() if hasattr(r, "asDict") else dict(r)
        nodes = [Node(**(as_dict(n) | {"weights": [float(x) for x in as_dict(n)["weights"]]})) for n in get(row, "nodes")]
        edges = [Edge(**as_dict(e)) for e in get(row, "edges")]
        for n in nodes:
            n.innovation, n.layer, n.enabled, n.depth = int(n.innovation), int(n.layer), bool(n.enabled), float(n.depth)
        for e in edges:
            e.innovation, e.source, e.target, e.delay, e.enabled = int(e.innovation), int(e.source), int(e.target), int(e.delay), bool(e.enabled)
        return cls(nodes, edges, int(get(row, "genome_id")), int(get(row, "island")), int(get(row, "generation")), float(get(row, "fitness")))

    # Structure

    def ends(self) -> tuple[set[int], set[int], list[Edge]]:
        """Nodes that an enabled input reaches, nodes that reach an enabled output, and the edges that are on between nodes that are."""
        on = {n.innovation for n in self.nodes if n.enabled}
        live = [e for e in self.edges if e.enabled and e.source in on and e.target in on]

        def spread(start: set[int], step) -> set[int]:
            seen, todo = set(start), list(start)
            while todo:
                new = step[todo.pop()] - seen
                seen |= new
                todo += new
            return seen

        ahead: dict[int, set[int]] = defaultdict(set)
        back: dict[int, set[int]] = defaultdict(set)
        for e in live:
            ahead[e.source].add(e.target)
            back[e.target].add(e.source)
        forward = spread({n.innovation for n in self.nodes if n.enabled and n.layer == INPUT}, ahead)
        backward = spread({n.innovation for n in self.nodes if n.enabled and n.layer == OUTPUT}, back)
        return forward, backward, live

    def reachable(self) -> tuple[set[int], set[int]]:
        """Nodes and edges (by innovation, delayed ones included) on a path from an enabled input to an enabled output."""
        forward, backward, live = self.ends()
        nodes = forward & backward
        return nodes, {id(e) for e in live if e.source in nodes and e.target in nodes}

    def live_edges(self) -> list[Edge]:
        _, edges = self.reachable()
        return [e for e in self.edges if id(e) in edges]

    def outputs_unreachable(self) -> bool:
        forward, backward, _ = self.ends()
        return any(n.innovation not in forward or n.innovation not in backward for n in self.nodes if n.layer == OUTPUT)

    def structural_hash(self) -> str:
        nodes, edges = self.reachable()
        live = [e for e in self.edges if id(e) in edges]
        return "_".join(str(s) for s in (sum(nodes), sum(e.innovation for e in live if not e.delay), sum(e.innovation for e in live if e.delay)))

    def shape(self) -> tuple[list[int], list[tuple[int, int]]]:
        nodes, edges = self.reachable()
        return sorted(nodes), sorted((e.innovation, e.delay) for e in self.edges if id(e) in edges)

    def same_structure(self, other: Genome) -> bool:
        return self.shape() == other.shape()

    def max_innovations(self) -> tuple[int, int]:
        return max([0, *(n.innovation for n in self.nodes)]), max([0, *(e.innovation for e in self.edges)])

    def counts(self) -> dict[str, int]:
        on = [n for n in self.nodes if n.enabled]
        return {"nodes": len(on), "edges": sum(e.enabled and not e.delay for e in self.edges), "recurrent_edges": sum(e.enabled and e.delay > 0 for e in self.edges)} | {
            c: sum(n.cell == c for n in on) for c in sorted({n.cell for n in on})
        }

    def average_weight(self) -> float:
        return sum(e.weight for e in self.edges if e.enabled) / len(self.edges) if self.edges else 0.0

    def average_delay(self) -> float:
        d = [e.delay for e in self.live_edges() if e.delay]
        return sum(d) / len(d) if d else 0.0

    # Weights

    def weight_slots(self, reachable: tuple[set[int], set[int]] | None = None) -> list[tuple[object, int | str]]:
        """Where the trained weights are: nodes', then feed-forward edges', then recurrent edges'; only reachable ones."""
        nodes, edges = reachable or self.reachable()
        out: list[tuple[object, int | str]] = [(n, k) for n in self.nodes if n.innovation in nodes for k in range(len(n.weights))]
        live = [e for e in self.edges if id(e) in edges]
        return out + [(e, "weight") for e in live if not e.delay] + [(e, "weight") for e in live if e.delay]

    def get_weights(self) -> np.ndarray:
        return np.array([o.weights[k] if isinstance(k, int) else o.weight for o, k in self.weight_slots()], float)

    def set_weights(self, values) -> None:
        for (o, k), v in zip(self.weight_slots(), values, strict=True):
            if isinstance(k, int):
                o.weights[k] = float(v)
            else:
                o.weight = float(v)

    # Texts

    def to_graphviz(self) -> str:
        """The network as a dot graph; disabled and unreachable parts are dashed."""
        nodes, edges = self.reachable()
        lines = ["digraph genome {", "  rankdir=LR;"]
        for n in self.nodes:
            style = "solid" if n.innovation in nodes else "dashed"
            lines.append(f'  n{n.innovation} [label="{n.parameter or n.cell} {n.innovation}", style={style}];')
        for e in self.edges:
            style = "solid" if id(e) in edges else "dashed"
            tag = f"{e.weight:.3f}" + (f" t-{e.delay}" if e.delay else "")
            lines.append(f'  n{e.source} -> n{e.target} [label="{tag}", style={style}, color="{weight_color(e.weight)}"];')
        return "\n".join([*lines, "}"])

    def to_equations(self) -> list[str]:
        """One equation per reachable node, in order of depth. Weights of 1 are left out, of 0 drop their term."""
        nodes, _ = self.reachable()
        live, by = self.live_edges(), {n.innovation: n for n in self.nodes}
        name = lambda n: n.parameter if n.layer != HIDDEN and n.parameter else f"h{n.innovation}"
        out = []
        for n in sorted((n for n in self.nodes if n.innovation in nodes), key=lambda n: (n.depth, n.innovation)):
            if n.layer == INPUT:
                continue
            terms = []
            for e in live:
                if e.target == n.innovation and e.weight != 0:
                    source = f"{name(by[e.source])}[t{f'-{e.delay}' if e.delay else ''}]"
                    terms.append(source if e.weight == 1 else f"{e.weight:g}*{source}")
            joined = (" * " if CELLS[n.cell].combine == "product" else " + ").join(terms) or "0"
            own = ", ".join(f"{k}={v:g}" for k, v in zip(CELLS[n.cell].weights, n.weights))
            out.append(f"{name(n)}[t] = {n.cell}({joined}{'; ' + own if own else ''})")
        return out


def weight_color(weight: float) -> str:
    """From blue over grey to red as a weight goes from -10 to 10, steepest around 0."""
    x = math.tanh(weight)
    red, blue = round(127 + 128 * max(0.0, x)), round(127 + 128 * max(0.0, -x))
    return f"#{red:02x}{round(127 * (1 - abs(x))):02x}{blue:02x}"


def seed_genome(inputs: list[str], outputs: list[str], cell: str | None = None, hidden: int = 0, layers: int = 0, max_delay: int = 0) -> Genome:
    """Inputs fully connected to outputs, or to ``layers`` layers of ``hidden`` cells between; with ``max_delay``, recurrent
    edges of each delay from every hidden and output node to those at its depth and before."""
    nodes = [Node(k + 1, INPUT, "linear", 0.0, p, True, [0.0]) for k, p in enumerate(inputs)]
    rows = [list(nodes)]
    for layer in range(layers):
        made = [Node(len(nodes) + k + 1, HIDDEN, cell or "simple", (layer + 1) / (layers + 1), None, True, [0.0] * len(CELLS[cell or "simple"].weights)) for k in range(hidden)]
        nodes += made
        rows.append(made)
    ends = [Node(len(nodes) + k + 1, OUTPUT, "linear", 1.0, p, True, [0.0]) for k, p in enumerate(outputs)]
    nodes += ends
    rows.append(ends)
    edges: list[Edge] = []
    for a, b in zip(rows[:-1], rows[1:]):
        edges += [Edge(len(edges) + k + 1, s.innovation, t.innovation) for k, (s, t) in enumerate((s, t) for t in b for s in a)]
    later = [n for n in nodes if n.layer != INPUT]
    for delay in range(1, max_delay + 1):
        for s in later:
            for t in later:
                if t.depth <= s.depth:
                    edges.append(Edge(len(edges) + 1, s.innovation, t.innovation, delay))
    return Genome(nodes, edges)
