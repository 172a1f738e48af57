"""Training in the driver's JVM, for generations whose work is less than what a Spark job costs.

A genome becomes a program: the operations of one time, in order of depth. Cells' rules are traced from their one definition
(`nn/cells.py`), so both ways follow the same rules; they differ in the last bits only. A small Java class, which the JVM's own
compiler (the one that Spark compiles queries with) makes once, runs programs forwards and backwards over batches of episodes.
"""

from __future__ import annotations

import os
import tempfile
from functools import cache

import numpy as np

from galewright.nn import tape as A
from galewright.nn.cells import CELLS
from galewright.nn.genome import INPUT, OUTPUT, Genome
from galewright.nn.packed import NAMES, NUMBERS, Packed
from galewright.nn.training import Optimizer

METHODS = ("vanilla", "momentum", "nesterov", "adagrad", "rmsprop", "adam", "adam-bias")
CODES = {name: k for k, name in enumerate(("input", "zero", "edge", "weight", "constant", "before", "add", "sub", "mul", "sigmoid", "tanh", "leaky_relu", "swish", "exp", "sin", "cos", "inverse"))}
#: Columns of a program: the operation, its place, its operands (places, an input's column, an edge's source and delay), the weight's slot.
CODE, PLACE, LEFT, RIGHT, SLOT = range(5)

SOURCE = r"""
import java.io.RandomAccessFile;
import java.nio.*;

public class Trainer {
    static class Net {
        int places, outs, slots, steps, columns, width, iterations, batch, method, count;
        int[] cell, column, first, base, begin, source, delay, slot, out, order, held, shown;
        double[] weights, x, y, hyper, result, view;
        double[][] v, g;
        Throwable failed;

        // Reads the nodes: of each its cell, input column or -1, first slot, number of edges; of each edge its source, delay, slot.
        void expand(int[] nodes, int[] edges, int[] ends) {
            int many = nodes.length / 4;
            cell = new int[many]; column = new int[many]; first = new int[many]; base = new int[many]; begin = new int[many + 1];
            for (int i = 0; i < many; i++) {
                cell[i] = nodes[4 * i]; column[i] = nodes[4 * i + 1]; first[i] = nodes[4 * i + 2];
                begin[i + 1] = begin[i] + nodes[4 * i + 3];
                base[i] = places;
                places += ends[2 * cell[i] + 1];
            }
            source = new int[edges.length / 3]; delay = new int[source.length]; slot = new int[source.length];
            for (int e = 0; e < source.length; e++) {
                int from = edges[3 * e];
                source[e] = base[from] + ends[2 * cell[from]]; delay[e] = edges[3 * e + 1]; slot[e] = edges[3 * e + 2];
            }
            for (int i = 0; i < outs; i++) if (out[i] >= 0) out[i] = base[out[i]] + ends[2 * cell[out[i]]];
        }

        // Fills v with the values of all places for these rows, side by side.
        void forward(double[] w, int[] rows, int b) {
            for (int t = 0; t < steps; t++) {
                double[] now = v[t], before = t > 0 ? v[t - 1] : null;
                for (int i = 0; i < cell.length; i++) {
                    int o = base[i] * b;
                    for (int j = 0; j < b; j++) now[o + j] = column[i] < 0 ? 0 : x[(rows[j] * steps + t) * columns + column[i]];
                    for (int lane = 0; lane < b; lane += 8) Trainer.sum(v, t, b, lane, o, source, delay, slot, begin[i], begin[i + 1], w);
                    Trainer.step(cell[i], now, before, base[i], b, w, first[i]);
                }
            }
        }

        double expected(int row, int t, int k) {
            return y[(row * steps + t) * outs + k];
        }

        double value(int t, int k, int j, int b) {
            return out[k] < 0 ? 0 : v[t][out[k] * b + j];
        }

        // The gradient of the first m of b rows, whose values are there.
        double gradient(double[] w, int[] rows, int m, int b, double[] sums) {
            double total = 0;
            for (int t = 0; t < steps; t++) {
                java.util.Arrays.fill(g[t], 0, places * b, 0);
                for (int k = 0; k < outs; k++)
                    for (int j = 0; j < m; j++) {
                        double d = value(t, k, j, b) - expected(rows[j], t, k);
                        total += d * d;
                        if (out[k] >= 0) g[t][out[k] * b + j] += 2 * d / (m * steps);
                    }
            }
            java.util.Arrays.fill(sums, 0);
            for (int t = steps - 1; t >= 0; t--) {
                double[] now = v[t], up = g[t], earlier = t > 0 ? g[t - 1] : null;
                for (int i = cell.length - 1; i >= 0; i--) {
                    Trainer.back(cell[i], now, up, earlier, base[i], b, m, w, first[i], sums);
                    for (int lane = 0; lane < m; lane += 8) Trainer.spread(v, g, t, b, lane, m, base[i] * b, source, delay, slot, begin[i], begin[i + 1], w, sums);
                }
            }
            return total / (m * steps);
        }

        // Operations on numbers, about.
        double work() {
            return (3.0 * iterations * count + (iterations + 1) * held.length + shown.length) * steps * (places + source.length);
        }

        double squares(int row, int j, int b) {
            double total = 0;
            for (int k = 0; k < outs; k++) {
                double s = 0;
                for (int t = 0; t < steps; t++) {
                    double d = value(t, k, j, b) - expected(row, t, k);
                    s += d * d;
                }
                total += s / steps;
            }
            return total;
        }

        // The mean error of the held rows; view gets the outputs for the shown ones.
        double error(double[] w, int[] held) {
            double total = 0;
            int n = held.length + shown.length, at = 0;
            view = new double[shown.length * steps * outs];
            for (int from = 0; from < n; from += width) {
                int b = Math.min(width, n - from);
                int[] rows = new int[b];
                for (int j = 0; j < b; j++) rows[j] = from + j < held.length ? held[from + j] : shown[from + j - held.length];
                forward(w, rows, b);
                for (int j = 0; j < b; j++) {
                    if (from + j < held.length) total += squares(rows[j], j, b);
                    else
                        for (int t = 0; t < steps; t++)
                            for (int k = 0; k < outs; k++) view[at++] = value(t, k, j, b);
                }
            }
            return total / held.length;
        }

        void step(double[] w, double[] s, double[] velocity, double[] mean, int steps) {
            double rate = hyper[0], momentum = hyper[1], decay = hyper[2], beta1 = hyper[3], beta2 = hyper[4], epsilon = hyper[5], high = hyper[6], low = hyper[7], norm = 0;
            for (int k = 0; k < slots; k++) norm += s[k] * s[k];
            norm = Math.sqrt(norm);
            double scale = norm > high ? high / norm : norm > 0 && norm < low ? low / norm : 1;
            for (int k = 0; k < slots; k++) {
                double d = s[k] * scale, move, old = velocity[k];
                if (method == 0) move = -rate * d;
                else if (method == 1) move = velocity[k] = momentum * old - rate * d;
                else if (method == 2) {
                    velocity[k] = momentum * old - rate * d;
                    move = (1 + momentum) * velocity[k] - momentum * old;
                } else if (method < 5) {
                    velocity[k] = method == 3 ? old + d * d : decay * old + (1 - decay) * d * d;
                    move = -rate * d / (Math.sqrt(velocity[k]) + epsilon);
                } else {
                    mean[k] = beta1 * mean[k] + (1 - beta1) * d;
                    velocity[k] = beta2 * old + (1 - beta2) * d * d;
                    double m = mean[k], q = velocity[k];
                    if (method == 6) {
                        m /= 1 - Math.pow(beta1, steps);
                        q /= 1 - Math.pow(beta2, steps);
                    }
                    move = -rate * m / (Math.sqrt(q) + epsilon);
                }
                w[k] = Math.max(-10, Math.min(10, w[k] + move));
            }
        }

        public void run() {
            try {
                int part = Math.min(batch, count);
                boolean joined = part > 0 && iterations > 0 && part + held.length <= 8;  // the first rows and the held ones have the same weights
                width = Math.max(1, Math.max(joined ? part + held.length : part, Math.min(8, held.length + shown.length)));
                v = new double[steps][places * width];
                double[] w = (double[]) weights.clone(), kept = (double[]) weights.clone(), set = kept, seen = null;
                double best = 0;
                if (!joined) {
                    best = error(w, held);
                    seen = view;
                }
                if (count > 0) {
                    g = new double[steps][places * width];
                    double[] sums = new double[slots], velocity = new double[slots], mean = new double[slots];
                    int done = 0;
                    for (int i = 0; i < iterations; i++) {
                        for (int from = 0; from < count; from += batch) {
                            int m = Math.min(batch, count - from), b = joined && done == 0 ? m + held.length : m;
                            int[] rows = new int[b];
                            for (int j = 0; j < b; j++) rows[j] = j < m ? order[i * count + from + j] : held[j - m];
                            forward(w, rows, b);
                            if (b > m) {
                                for (int j = m; j < b; j++) best += squares(rows[j], j, b);
                                best /= held.length;
                            }
                            double loss = gradient(w, rows, m, b, sums);
                            for (int k = 0; k < slots; k++) loss += 0 * sums[k];
                            if (Double.isNaN(loss) || Double.isInfinite(loss)) {
                                finish(Double.NaN, set, null);
                                return;
                            }
                            step(w, sums, velocity, mean, ++done);
                        }
                        set = (double[]) w.clone();
                        double mse = error(w, held);
                        if (mse < best) {
                            best = mse;
                            kept = set;
                            seen = view;
                        }
                    }
                }
                finish(best, kept, seen);
            } catch (Throwable e) {
                failed = e;
            }
        }

        void finish(double fitness, double[] w, double[] seen) {
            if (seen == null) {
                error(w, new int[0]);
                seen = view;
            }
            int kept = count > 0 ? slots : 0;
            result = new double[1 + kept + seen.length];
            result[0] = fitness;
            System.arraycopy(w, 0, result, 1, kept);
            System.arraycopy(seen, 0, result, 1 + kept, seen.length);
            v = g = null;
        }
    }

    static double sigmoid(double a) {
        return 1 / (1 + StrictMath.exp(-Math.max(-60, Math.min(60, a))));
    }

    // Takes networks as long as there are some.
    static class Worker extends Thread {
        Net[] nets;
        int[] next;

        Worker(Net[] nets, int[] next) {
            this.nets = nets;
            this.next = next;
        }

        public void run() {
            for (;;) {
                int i;
                synchronized (next) { i = next[0]++; }
                if (i >= nets.length) return;
                nets[i].run();
            }
        }
    }

    static final double WORTH = 2000000;  // operations that another thread is worth

    //RULES

    static int[] ints(IntBuffer from, int n) {
        int[] out = new int[n];
        from.get(out);
        return out;
    }

    static double[] doubles(DoubleBuffer from, int n) {
        double[] out = new double[n];
        from.get(out);
        return out;
    }

    // The file holds so many real and whole numbers; the results take their place.
    public static void run(String path, int reals, int wholes) throws Throwable {
        byte[] data = new byte[8 * reals + 4 * wholes];
        RandomAccessFile file = new RandomAccessFile(path, "rw");
        file.readFully(data);
        DoubleBuffer d = ByteBuffer.wrap(data, 0, 8 * reals).order(ByteOrder.LITTLE_ENDIAN).asDoubleBuffer();
        IntBuffer a = ByteBuffer.wrap(data, 8 * reals, 4 * wholes).order(ByteOrder.LITTLE_ENDIAN).asIntBuffer();
        int[] head = ints(a, 11);
        int jobs = head[0], episodes = head[1], steps = head[2], columns = head[3], outs = head[4];
        int[] held = ints(a, head[8]), shown = ints(a, head[9]), ends = ints(a, 2 * head[10]);
        double[] hyper = doubles(d, 8), x = doubles(d, episodes * steps * columns), y = doubles(d, episodes * steps * outs);
        final Net[] nets = new Net[jobs];
        int size = 0;
        for (int i = 0; i < jobs; i++) {
            Net m = nets[i] = new Net();
            int[] own = ints(a, 4);
            m.slots = own[2]; m.count = own[3];
            m.steps = steps; m.columns = columns; m.outs = outs; m.iterations = head[5]; m.batch = head[6]; m.method = head[7];
            m.held = held; m.shown = shown; m.hyper = hyper; m.x = x; m.y = y;
            int[] nodes = ints(a, 4 * own[0]), edges = ints(a, 3 * own[1]);
            m.out = ints(a, outs); m.order = ints(a, m.count * m.iterations);
            m.weights = doubles(d, m.slots);
            m.expand(nodes, edges, ends);
            size += 1 + (m.count > 0 ? m.slots : 0) + shown.length * steps * outs;
        }
        double work = 0;
        for (int i = 0; i < jobs; i++) work += nets[i].work();
        Worker[] more = new Worker[(int) Math.min(Math.min(jobs, Runtime.getRuntime().availableProcessors()) - 1, work / WORTH)];
        int[] next = new int[1];
        for (int i = 0; i < more.length; i++) {
            more[i] = new Worker(nets, next);
            more[i].start();
        }
        new Worker(nets, next).run();
        for (int i = 0; i < more.length; i++) more[i].join();
        ByteBuffer out = ByteBuffer.allocate(8 * size).order(ByteOrder.LITTLE_ENDIAN);
        for (int i = 0; i < jobs; i++) {
            if (nets[i].failed != null) throw nets[i].failed;
            for (int k = 0; k < nets[i].result.length; k++) out.putDouble(nets[i].result[k]);
        }
        file.seek(0);
        file.write(out.array());
        file.close();
    }
}
"""


@cache
def _cell(name: str) -> tuple[np.ndarray, np.ndarray, int, int] | None:
    """A cell's program with its constants, its output's place and its number of places. Place 0 is the sum of its inputs."""
    cell = CELLS[name]
    if cell.combine != "sum":
        return None
    ops: list[list[float]] = []

    def emit(operation: str, left=0, right=0, slot: int = 0, constant: float = 0.0) -> A.Trace:
        place = lambda v: v.place if isinstance(v, A.Trace) else emit("constant", constant=float(v)).place if operation in ("add", "sub", "mul") else v
        left, right = place(left), place(right)
        ops.append([CODES[operation], len(ops) + 1, left, right, slot, constant])
        return A.Trace(emit, len(ops))

    before = emit("before")
    try:
        y, state = cell.step([emit("weight", slot=k) for k in range(len(cell.weights))], A.Trace(emit, 0), before)
    except TypeError:  # a rule that looks at values
        return None
    if isinstance(state, A.Trace):
        ops[before.place - 1][LEFT] = state.place
    else:
        ops[before.place - 1][CODE] = CODES["zero"]
    table = np.array(ops)
    return table[:, :5].astype(np.int32), table[:, 5], y.place, len(ops) + 1


class Program:
    """What the JVM needs of a genome: its live nodes in order of depth, the edges into each, its weights and where they are kept."""

    def __init__(self, genome: Genome | Packed, inputs: list[str]):
        self.genome, g = genome, Packed.of(genome)
        self.weights, self.shown = g.get_weights(), None
        _, _, live, edges = g.ends()
        order = np.flatnonzero(live)
        order = order[np.lexsort((g.number[order], g.depth[order]))]
        place = np.full(len(g.number), -1)
        place[order] = np.arange(len(order))
        own, now, later = g.slots()
        slot = np.zeros(len(g.edge), np.int64)
        slot[now], slot[later] = len(own) + np.arange(len(now)), len(own) + len(now) + np.arange(len(later))
        sizes = np.where(live, g.sizes, 0)
        first = np.where(sizes, np.cumsum(sizes) - sizes, 0)
        column = {p: k for k, p in enumerate(inputs)}
        taken = [column[g.parameter[k]] if g.layer[k] == INPUT else -1 for k in order.tolist()]
        into = edges[np.argsort(place[g.target[edges]], kind="stable")]
        many = np.bincount(place[g.target[edges]], minlength=len(order))
        self.nodes = np.stack((g.cell[order], np.array(taken, np.int64), first[order], many), 1).ravel()
        self.edges = np.stack((place[g.source[into]], g.delay[into], slot[into]), 1).ravel()
        self.outputs = place[g.layer == OUTPUT]

    def store(self, values: np.ndarray) -> None:
        self.weights = values
        self.genome.set_weights(values)


def _sizes(genome: Genome | Packed) -> tuple[np.ndarray, np.ndarray, int]:
    """Cells and numbers of weights of all nodes, and the number of edges."""
    if isinstance(genome, Packed):
        return genome.cell, genome.sizes, len(genome.edge)
    return np.array([NUMBERS[n.cell] for n in genome.nodes], np.int64), np.array([len(n.weights) for n in genome.nodes], np.int64), len(genome.edges)


@cache
def _lengths() -> tuple[np.ndarray, np.ndarray]:
    """Of each cell the number of weights, -1 if its rule can't be traced, and of operations."""
    cells = [_cell(c) for c in NAMES]
    return np.array([-1 if c is None else len(CELLS[k].weights) for k, c in zip(NAMES, cells)]), np.array([0 if c is None else len(c[0]) for c in cells])


def fits(genomes: list[Genome | Packed]) -> bool:
    """Whether all cells' rules can be traced."""
    return all((_lengths()[0][cells] == sizes).all() for cells, sizes, _ in map(_sizes, genomes))


@cache
def _ends() -> np.ndarray:
    """Of each cell its output's place and its number of places."""
    return np.array([(0, 0) if c is None else c[2:] for c in map(_cell, NAMES)]).ravel()


def operations(genome: Genome | Packed) -> int:
    """How many operations one time of one episode takes at most."""
    cells, _, edges = _sizes(genome)
    return edges + int(_lengths()[1][cells].sum())


def _method(name: str, table: np.ndarray, constants: np.ndarray, y: int) -> str:
    """Java of a cell: one time forwards (its values are kept for the way back) and backwards. Places are variables, so that the compiler sees the whole rule."""
    names = {v: k for k, v in CODES.items()}
    ops = [(names[c], p, a, b, s, k) for (c, p, a, b, s), k in zip(table.tolist(), constants.tolist())]
    fixed = {p: "0.0" if o == "zero" else f"w{s}" if o == "weight" else repr(k) for o, p, _, _, s, k in ops if o in ("weight", "constant", "zero")}
    read = {y, *(a for o, _, a, *_ in ops if o == "before")}  # by edges and by the next time
    value = lambda p: fixed.get(p, f"p{p}")
    at = lambda p: f"o + {p} * b"
    weights = [f"double w{s} = w[slot + {s}], s{s} = 0;" for o, _, _, _, s, _ in ops if o == "weight"]
    ahead, load, back = [f"double p0 = now[{at(0)}];"], [f"double p0 = now[{at(0)}];"], []
    for o, p, a, b, s, _ in ops:
        x, z = value(a), value(b)
        if p not in fixed:
            rule = {
                "before": f"before == null ? 0 : before[{at(a)}]", "add": f"{x} + {z}", "sub": f"{x} - {z}", "mul": f"{x} * {z}", "sigmoid": f"sigmoid({x})", "tanh": f"StrictMath.tanh({x})", "leaky_relu": f"Math.max(0.01 * {x}, {x})",
                "swish": f"{x} * sigmoid({x})", "exp": f"StrictMath.exp(Math.min({x}, 700))", "sin": f"StrictMath.sin({x})", "cos": f"StrictMath.cos({x})", "inverse": f"{x} == 0 ? 0 : 1 / {x}",
            }[o]
            ahead += [f"double p{p} = {rule};", f"now[{at(p)}] = p{p};"]
            load.append(f"double p{p} = now[{at(p)}];")
        elif p in read:
            ahead.append(f"now[{at(p)}] = {fixed[p]};")
        u, v = f"q{p}", f"p{p}"
        slopes = {
            "add": [(a, u), (b, u)], "sub": [(a, u), (b, f"-{u}")], "mul": [(a, f"{u} * {z}"), (b, f"{u} * {x}")], "sigmoid": [(a, f"{u} * ({v} * (1 - {v}))")], "tanh": [(a, f"{u} * (1 - {v} * {v})")],
            "leaky_relu": [(a, f"{u} * ({x} > 0 ? 1 : 0.01)")], "swish": [(a, f"{u} * (sigmoid({x}) + {x} * sigmoid({x}) * (1 - sigmoid({x})))")], "exp": [(a, f"{u} * {v}")], "sin": [(a, f"{u} * StrictMath.cos({x})")],
            "cos": [(a, f"-({u} * StrictMath.sin({x}))")], "inverse": [(a, f"-({u} * {v} * {v})")],
        }.get(o, [])
        more = {"weight": [f"s{s} += {u};"], "before": [f"if (back != null) back[{at(a)}] += {u};"]}.get(o, [])
        back = [*more, *(f"q{k} += {slope};" for k, slope in slopes if k not in fixed or fixed[k][0] == "w"), *back]
    grads = [f"double q{p} = {f'up[{at(p)}]' if p in read else '0'};" for p in range(len(ops) + 1)]
    k = NUMBERS[name]
    begin = "for (int j = 0; j < m; j++) { int o = from * b + j;"
    return "\n".join([
        f"static void f{k}(double[] now, double[] before, int from, int b, int m, double[] w, int slot) {{", *weights, begin, *ahead, "} }",
        f"static void b{k}(double[] now, double[] up, double[] back, int from, int b, int m, double[] w, int slot, double[] sums) {{", *weights, begin, *load, *grads, *back, f"up[{at(0)}] = q0; }}",
        *(f"sums[slot + {s}] += s{s};" for o, _, _, _, s, _ in ops if o == "weight"), "}",
    ])


def _edges(n: int) -> str:
    """Java of the edges into a node for n rows side by side, forwards and backwards."""
    each = lambda text, sep=" ": sep.join(text.format(i=i) for i in range(n))
    begin = "int d = delay[e]; if (t < d) continue; double[] then = v[t - d]; int l = source[e] * b + lane; double k = w[slot[e]];"
    return "\n".join([
        f"static void sum{n}(double[][] v, int t, int b, int lane, int o, int[] source, int[] delay, int[] slot, int from, int to, double[] w) {{ double[] now = v[t]; o += lane;", each("double a{i} = now[o + {i}];"),
        f"for (int e = from; e < to; e++) {{ {begin}", each("a{i} += then[l + {i}] * k;"), "}", each("now[o + {i}] = a{i};"), "}",
        f"static void spread{n}(double[][] v, double[][] g, int t, int b, int lane, int o, int[] source, int[] delay, int[] slot, int from, int to, double[] w, double[] sums) {{ double[] up = g[t]; o += lane;", each("double u{i} = up[o + {i}];"),
        f"for (int e = to - 1; e >= from; e--) {{ {begin} double[] back = g[t - d];", f"sums[slot[e]] += {each('u{i} * then[l + {i}]', ' + ')};", each("back[l + {i}] += u{i} * k;"), "} }",
    ])


def _rules() -> str:
    """Java of all cells that can be traced and of the edges."""
    cells = {NUMBERS[c]: _method(c, *_cell(c)[:3]) for c in NAMES if _cell(c)}
    which = lambda call: " ".join(f"case {k}: {call.format(k=k)}; break;" for k in cells)
    wide = lambda call: " ".join(f"case {n}: {call.format(n=n)}; break;" for n in range(1, 9))
    return "\n".join([
        *cells.values(), *map(_edges, range(1, 9)),
        f"static void step(int cell, double[] now, double[] before, int from, int b, double[] w, int slot) {{ switch (cell) {{ {which('f{k}(now, before, from, b, b, w, slot)')} }} }}",
        f"static void back(int cell, double[] now, double[] up, double[] back, int from, int b, int m, double[] w, int slot, double[] sums) {{ switch (cell) {{ {which('b{k}(now, up, back, from, b, m, w, slot, sums)')} }} }}",
        f"static void sum(double[][] v, int t, int b, int lane, int o, int[] source, int[] delay, int[] slot, int from, int to, double[] w) {{ switch (Math.min(8, b - lane)) {{ {wide('sum{n}(v, t, b, lane, o, source, delay, slot, from, to, w)')} }} }}",
        f"static void spread(double[][] v, double[][] g, int t, int b, int lane, int m, int o, int[] source, int[] delay, int[] slot, int from, int to, double[] w, double[] sums) {{ switch (Math.min(8, m - lane)) {{ {wide('spread{n}(v, g, t, b, lane, o, source, delay, slot, from, to, w, sums)')} }} }}",
    ])


def trainer(spark):
    """The compiled class and the file by which numbers go to it and come back, one per context. Through the gateway they would go as text, in parts."""
    sc = spark.sparkContext
    if not hasattr(sc, "_galewright_trainer"):
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(SOURCE.replace("//RULES", _rules()))
        handle, path = tempfile.mkstemp(prefix="galewright-")
        sc._jvm.java.io.File(path).deleteOnExit()
        sc._galewright_trainer = compiler.getClassLoader().loadClass("Trainer").newInstance(), path, os.fdopen(handle, "r+b", 0)
    return sc._galewright_trainer


def _run(spark, programs: list[Program], places: list[list[int]], x: np.ndarray, y: np.ndarray, held: list[int], iterations: int, o: Optimizer, batch: int, seeds: list[int], shown: list[int]) -> list[np.ndarray]:
    """Of each program its fitness, its weights if it was trained and its outputs for the episodes at the places ``shown``."""
    whole = [[len(programs), len(x), x.shape[1], x.shape[2], y.shape[2], iterations, batch, METHODS.index(o.method), len(held), len(shown), len(NAMES)], held, shown, _ends()]
    limits = [np.inf if o.high is None else o.high, -np.inf if o.low is None else o.low]
    real = [[o.rate, o.momentum, o.decay, o.beta1, o.beta2, o.epsilon, *limits], x.ravel(), y.ravel()]
    for p, own, seed in zip(programs, places, seeds):
        rng = np.random.default_rng(seed) if own else None
        order = [np.array(own)[rng.permutation(len(own))] for _ in range(iterations)] if own else []
        whole += [[len(p.nodes) // 4, len(p.edges) // 3, len(p.weights), len(own)], p.nodes, p.edges, p.outputs, *order]
        real.append(p.weights)
    pack = lambda parts, kind: np.concatenate([np.asarray(v, kind) for v in parts])
    whole, real = pack(whole, "<i4"), pack(real, "<f8")
    java, path, file = trainer(spark)
    file.seek(0)
    file.write(real.tobytes() + whole.tobytes())
    java.run(path, len(real), len(whole))
    more = len(shown) * x.shape[1] * y.shape[2]
    ends = np.cumsum([1 + (len(p.weights) if own else 0) + more for p, own in zip(programs, places)])
    file.seek(0)
    return np.split(np.frombuffer(file.read(8 * int(ends[-1])), "<f8"), ends[:-1])


def train_all(
    spark, work: list[tuple[Genome, list[int]]], x: np.ndarray, y: np.ndarray, held: list[int], inputs: list[str], iterations: int, optimizer: Optimizer, batch: int, seeds: list[int],
    known: dict[int, Program] | None = None, shown: int | None = None,
) -> None:
    """`nn.training.train` of several genomes at once, each on the episodes at its places; one without places is only validated. The genomes end with
    their best weights and fitness. ``known`` holds programs by genome id, of genomes that nobody changes, and gets the new ones; with ``shown`` each gets
    its outputs for the episode at that place."""
    known = {} if known is None else known
    programs = [known.get(g.genome_id) if not places else None for g, places in work]
    programs = [p or Program(g, inputs) for p, (g, _) in zip(programs, work)]
    results = _run(spark, programs, [places for _, places in work], x, y, held, iterations, optimizer, batch, seeds, [] if shown is None else [shown])
    for p, (g, places), result in zip(programs, work, results):
        g.fitness = float(result[0])
        if places:
            p.store(result[1 : 1 + len(p.weights)].copy())
        p.shown = None if shown is None else result[len(result) - x.shape[1] * y.shape[2] :].reshape(x.shape[1], y.shape[2])
        known[g.genome_id] = p


def predict(spark, program: Program, x: np.ndarray) -> np.ndarray:
    """(batch, time, outputs), as `nn.network.predict`."""
    y = np.zeros((*x.shape[:2], len(program.outputs)))
    every = list(range(len(x)))
    (result,) = _run(spark, [program], [[]], x, y, every, 0, Optimizer(), 1, [0], every)
    return result[1:].reshape(y.shape)
