import math

import numpy as np
import pytest

from galewright.evolve.populations import Island, Islands, Species, SteadyIslands, filled_with_mutants, insert_bounded
from galewright.evolve.variation import Innovations, Mutator, crossover, distance, moments, simplex_step, transfer
from galewright.nn.cells import CELLS, mixture_cell, mixture_weights
from galewright.nn.genome import Edge, Genome, Node, seed_genome
from galewright.nn.network import errors, forward, loss_and_gradient, numeric_gradient, predict
from galewright.nn.training import Optimizer, initialize, train
from galewright.operators import images as I
from galewright.spec import RunConfig

IN = ["a", "b"]


def made(cell="gru", hidden=2, layers=1, delay=2, seed=0, rule="random"):
    g = seed_genome(IN, ["y"], cell, hidden, layers, delay)
    initialize(g, rule, np.random.default_rng(seed))
    return g


def data(n=4, steps=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-0.5, 0.5, (n, steps, 2))
    return x, np.roll(x[:, :, :1], 1, 1)


@pytest.mark.parametrize("cell", [c for c in CELLS if not c.startswith("inverse")])
@pytest.mark.parametrize("shape", [(1, 1, 0), (2, 2, 3)])
def test_gradient_equals_central_differences(cell, shape):
    g = made(cell, *shape)
    x, y = data(3, 6)
    _, a = loss_and_gradient(g, x, y, IN)
    assert np.abs(a - numeric_gradient(g, x, y, IN)).max() < 1e-6


@pytest.mark.parametrize("loss", ["mse", "mae", "softmax"])
def test_losses(loss):
    g = seed_genome(IN, ["y", "z"], "gru", 2, 1, 1)
    initialize(g, "random", np.random.default_rng(4))
    x, y = data(3, 5)
    y = np.concatenate([(y > 0), (y <= 0)], -1).astype(float) if loss == "softmax" else np.concatenate([y, -y], -1)
    _, a = loss_and_gradient(g, x, y, IN, loss=loss)
    assert np.abs(a - numeric_gradient(g, x, y, IN, loss=loss)).max() < 1e-6


def test_mixture_cell():
    cell = mixture_cell(("simple", "mgu"), [0.3, -0.2], 4)
    w = np.random.default_rng(1).normal(0, 0.5, len(cell.weights))
    z = mixture_weights(np.exp(w[:2]), [0.3, -0.2], 4)
    a, _ = CELLS["simple"].step(w[2:3], 0.7, None)
    b, _ = CELLS["mgu"].step(w[3:], 0.7, None)
    y, state = cell.step(list(w), 0.7, None)
    assert abs(float(y) - (z[0] * a + z[1] * b)) < 1e-12 and len(state) == 2
    only, _ = mixture_cell(("simple", "mgu"), None, 1000).step([0.0, 1.0, *w[2:]], 0.7, None)
    assert abs(float(only) - b) < 1e-12


def test_inverse_gradient_away_from_zero():
    g = made("inverse", 1, 1, 0)
    x, y = data(2, 4)
    g.set_weights(np.abs(g.get_weights()) + 2.0)
    _, a = loss_and_gradient(g, np.abs(x) + 1, y, IN)
    assert np.allclose(a, numeric_gradient(g, np.abs(x) + 1, y, IN), rtol=1e-5, atol=1e-7)


def test_lstm_by_hand():
    w = [0.3, 0.1, 0.0, 0.5, -0.2, 0.1, 0.2, 0.4, 0.0, 0.9, 0.05]
    s = lambda v: 1 / (1 + math.exp(-v))
    c = h = 0.0
    state = None
    for x in (0.5, -1.0, 2.0):
        o, i, f = s(w[0] * x + w[1] * c + w[2]), s(w[3] * x + w[4] * c + w[5]), s(w[6] * x + w[7] * c + w[8] + 1)
        c = f * c + i * math.tanh(w[9] * x + w[10])
        h = o * c
        y, state = CELLS["lstm"].step(w, x, state)
        assert abs(float(y) - h) < 1e-12


def test_delays_and_products():
    nodes = [Node(1, 0, "linear", 0.0, "a", True, [0.0]), Node(2, 0, "linear", 0.0, "b", True, [0.0]), Node(3, 2, "multiply", 1.0, "y", True, [1.0])]
    g = Genome(nodes, [Edge(1, 1, 3, 0, 2.0), Edge(2, 2, 3, 2, 3.0)])
    x, _ = data(2, 5)
    p = predict(g, x, IN)[:, :, 0]
    want = 2 * x[:, :, 0] * np.concatenate([np.full((2, 2), np.nan), 3 * x[:, :-2, 1]], 1) + 1
    assert np.allclose(p[:, 2:], want[:, 2:]) and np.allclose(p[:, :2], 2 * x[:, :2, 0] + 1)


def test_dropout_only_in_training():
    g, (x, y) = made(), data()
    a = predict(g, x, IN)
    assert np.array_equal(a, predict(g, x, IN))
    out = forward(g, x, IN, dropout=0.9, rng=np.random.default_rng(0))
    assert not np.allclose(a[:, -1, 0], out[-1][0])


def test_training_lowers_the_error_and_keeps_the_best():
    g, (x, y) = made("mgu", 2, 1, 1, rule="xavier"), data(12, 10)
    before = errors(predict(g, x, IN), y)[0]
    log = train(g, x, y, x, y, IN, 6, Optimizer(rate=0.01), batch=3)
    assert g.fitness < before and g.fitness == min(r["best_validation_mse"] for r in log)
    assert abs(errors(predict(g, x, IN), y)[0] - g.fitness) < 1e-12


@pytest.mark.parametrize("method", ["vanilla", "momentum", "nesterov", "adagrad", "rmsprop", "adam", "adam-bias"])
def test_optimizers_descend(method):
    w, o = np.array([3.0, -2.0]), Optimizer(method, 0.5 if method == "adagrad" else 0.05)  # its steps shrink
    for _ in range(300):
        w = o.step(w, 2 * w)
    assert np.abs(w).max() < 0.5


def test_gradient_scaling():
    o = Optimizer()
    assert np.allclose(np.linalg.norm(o.scaled(np.array([30.0, 40.0]))), 1.0)
    assert np.allclose(np.linalg.norm(o.scaled(np.array([0.003, 0.004]))), 0.05)
    assert not o.scaled(np.zeros(3)).any()
    with pytest.raises(ValueError):
        Optimizer("adam_bias").step(np.zeros(1), np.zeros(1))


def test_reachability_hash_texts_and_rows():
    g = made()
    hidden = next(n for n in g.nodes if n.layer == 1)
    full = g.structural_hash()
    hidden.enabled = False
    assert g.structural_hash() != full and hidden.innovation not in g.reachable()[0] and not g.outputs_unreachable()
    for n in g.nodes:
        n.enabled = n.layer != 1
    assert g.outputs_unreachable() and len(g.get_weights()) == 0
    assert Genome.from_row(g.to_row()).to_row() == g.to_row()
    assert "digraph" in g.to_graphviz() and made().to_equations()[-1].startswith("y[t] = linear(")


def test_mutations_keep_genomes_valid():
    rng = np.random.default_rng(5)
    g = made("simple", 2, 1, 1)
    m = Mutator(rng, Innovations(*g.max_innovations()), max_delay=3, rates=dict.fromkeys(Mutator(rng, Innovations(0, 0)).rates, 1.0))
    seen = set()
    for _ in range(150):
        seen |= set(m.mutate(g, 1))
        assert not g.outputs_unreachable()
        assert len({n.innovation for n in g.nodes}) == len(g.nodes) and len({e.innovation for e in g.edges}) == len(g.edges)
        assert len({(e.source, e.target, e.delay) for e in g.edges}) == len(g.edges)
        depth = {n.innovation: n.depth for n in g.nodes}
        assert all(e.delay or depth[e.source] < depth[e.target] for e in g.live_edges())
        if len(g.nodes) > 25:
            g = made("simple", 2, 1, 1)
            m.innovations = Innovations(1000 + m.innovations.node, 1000 + m.innovations.edge)
    assert seen == set(m.rates)


def test_crossover_covers_the_union():
    rng = np.random.default_rng(2)
    a = made("simple", 1, 1, 1)
    b = a.copy()
    m = Mutator(rng, Innovations(*a.max_innovations()), max_delay=3)
    m.mutate(b, 4)
    child = crossover(a, b, rng)
    assert {e.innovation for e in child.edges} == {e.innovation for e in a.edges} | {e.innovation for e in b.edges}
    assert {n.innovation for n in child.nodes} == {n.innovation for n in a.nodes} | {n.innovation for n in b.nodes}
    assert distance(a, a) == 0 and distance(a, b) == pytest.approx(distance(b, a))


def test_transfer_to_other_columns():
    g = made("simple", 2, 1, 1)
    rng = np.random.default_rng(1)
    for versions in ((1,), (2,), (3,), (1, 2), (1, 3)):
        t = transfer(g, ["b", "c"], ["y", "z"], Mutator(rng, Innovations(*g.max_innovations())), versions)
        assert {n.parameter for n in t.nodes if n.layer == 0} == {"b", "c"} and [n.parameter for n in t.nodes if n.layer == 2] == ["y", "z"]
        x, _ = data()
        assert predict(t, x, ["b", "c"]).shape == (4, 8, 2)


def test_bounded_population():
    pop = []
    for k, f in enumerate((3.0, 1.0, 2.0, math.nan, math.inf, 1.0)):
        g = made(hidden=k + 1)
        g.fitness, g.genome_id = f, k
        insert_bounded(pop, g, 3)
    assert [g.genome_id for g in pop] == [1, 5, 2]
    twin = made(hidden=2)
    twin.fitness, twin.genome_id = 1.0, 9
    assert insert_bounded(pop, twin, 3) == -1
    twin.fitness = 0.5
    assert insert_bounded(pop, twin, 3) == 0 and len(pop) == 3 and pop[0].genome_id == 9


def run_islands(seed):
    i = Islands(RunConfig(islands=3, island_size=3, generated=2, repopulate_every=2, seed=seed, repopulation="random_parents"), seed_genome(IN, ["y"]))
    x, y = data(6, 8)
    for g in range(7):
        fresh = i.generate(g)
        for k in fresh:
            train(k, x, y, x, y, IN, 1, batch=6)
        i.finish(g, fresh)
        i.repopulate(g)
    return i


def test_islands_are_repeatable_and_erase():
    a, b = run_islands(3), run_islands(3)
    assert a.best().to_row() == b.best().to_row()
    assert any(i.immune or i.status == "repopulating" for i in a.islands)
    for k in range(12):
        a.compare(k, 2.0, 1.0)
    assert a.shrunk and a.size == 1 and all(len(i.elite) <= 1 for i in a.islands)


def test_steady_islands_and_species():
    s = SteadyIslands(RunConfig(islands=2, island_size=2), seed_genome(IN, ["y"]))
    while (g := s.generate_one(12)) is not None:
        g.fitness = 1.0 / g.genome_id
        s.insert(g, 6)
    assert s.evaluated == 13 and s.best() is not None
    sp = Species(RunConfig(), seed_genome(IN, ["y"]), threshold=0.3, stagnation=5)
    for k in range(40):
        g = sp.generate()
        g.fitness = 1.0 + k % 7
        sp.insert(g)
    assert sp.best.fitness == 1.0 and sp.check() and len(sp.species) <= 2
    assert all(sp.share(k) >= 0 for k in range(len(sp.species)))
    seed = made("simple", 1, 1, 1)
    before = seed.to_row()
    m = Mutator(np.random.default_rng(0), Innovations(*seed.max_innovations()))
    assert len(filled_with_mutants(seed, 3, 1, m)) == 3 and seed.to_row() == before
    assert Island(0).best() == math.inf


def test_moments_and_mixtures():
    assert moments([]) == (0.0, 0.25)
    assert moments([20.0, 0.0])[0] == 5.0
    z = mixture_weights([0.2, 0.5, 0.3], [0, 0, 0], 0)
    assert np.allclose(z, [0.2, 0.5, 0.3]) and np.allclose(mixture_weights([0.2, 0.5, 0.3], [0, 0, 0], 0, 2), [0, 0.625, 0.375])
    assert list(mixture_weights([0.2, 0.5, 0.3], [9, 0, 0], 1000)) == [0, 1, 0]


def test_image_kernels():
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(2, 6, 7)), rng.normal(size=(3, 2))
    y = I.convolve(x, w)
    assert y.shape == (2, 4, 6) and np.isclose(y[1, 2, 3], (x[1, 2:5, 3:5] * w).sum())
    gx, gw = I.convolve_gradients(x, w, np.ones_like(y))
    e = 1e-6
    x2, w2 = x.copy(), w.copy()
    x2[0, 3, 3] += e
    w2[1, 1] += e
    assert np.isclose(gx[0, 3, 3], (I.convolve(x2, w).sum() - y.sum()) / e, atol=1e-4) and np.isclose(gw[1, 1], (I.convolve(x, w2).sum() - y.sum()) / e, atol=1e-4)
    ys, xs = I.pool_sizes(6, 4), I.pool_sizes(7, 3)
    assert list(ys) == [2, 2, 1, 1] and list(xs) == [3, 2, 2]
    p = I.max_pool(x, ys, xs)
    assert p.shape == (2, 4, 3) and p[0, 0, 0] == x[0, :2, :3].max()
    assert np.isclose(I.max_pool_gradient(x, ys, xs, np.ones_like(p)).sum(), p.size)
    assert I.averaged_pool(x, 4, 3, 5, rng).shape == (2, 4, 3)
    v, slope = I.clamped_relu(np.array([-1.0, 2.0, 9.0]))
    assert list(v) == [-0.005, 2.0, 5.5] and list(slope) == [0.005, 1.0, 0.0]
    n, mean, var = I.batch_norm(x, 1.0, 0.0)
    assert abs(n.mean()) < 1e-9 and np.isclose(var, x.var(ddof=1)) and np.allclose(I.batch_norm(x, 1.0, 0.0, (mean, var))[0], n)
    w3, _ = I.velocity_step(np.array([60.0]), np.array([0.0]), np.array([0.0]), 0.5, 0.1, 0.0)
    assert w3[0] == 50 and np.allclose(I.softmax_rows(np.array([[1000.0, 1000.0]])), 0.5)


def test_simplex():
    rng = np.random.default_rng(0)
    for _ in range(20):
        out = simplex_step({"a": 2.0, "b": 0.0}, [{"a": 1.0, "b": 1.0}, {"a": 0.0, "b": 0.0}], {"a": (0.0, 2.5), "b": (-1.0, 1.0)}, rng)
        assert 0 <= out["a"] <= 2.5 and -1 <= out["b"] <= 1
        assert out["a"] == 2.5 or out["a"] == 0 or np.isclose((out["a"] - 0.5) / 1.5, (out["b"] - 0.5) / -0.5)


def test_several_islands_are_erased_and_some_spared():
    def filled(**more):
        i = Islands(RunConfig(islands=4, island_size=2, generated=1, repopulate_every=2, **more), seed_genome(IN, ["y"]))
        for k, island in enumerate(i.islands):
            g = made(seed=k)
            g.fitness = float(k)
            island.elite = [g]
        return i

    i = filled(erased_islands=2)
    assert i.repopulate(4) == [] and i.repopulate(5) == [] and i.repopulate(6) == [3, 2]
    for k in (2, 3):
        i.islands[k].elite = [made(seed=9)]
        i.islands[k].elite[0].fitness = 9.0
    assert i.repopulate(8) == [1, 0]  # 2 and 3 are spared
    again = filled(erased_islands=1, repeat_extinction=True)
    assert again.repopulate(6) == [3]
    again.islands[3].elite = [made(seed=9)]
    again.islands[3].elite[0].fitness = 9.0
    assert again.repopulate(8) == [3]


def test_edges_of_both_parents_are_enabled():
    a, b = made(seed=1), made(seed=2)
    a.edges[0].enabled = b.edges[0].enabled = False
    a.fitness, b.fitness = 0.1, 0.2
    child = crossover(a, b, np.random.default_rng(3))
    assert next(e for e in child.edges if e.innovation == a.edges[0].innovation).enabled
    drawn = crossover(a, b, np.random.default_rng(3), rule="gp")
    assert all(e.weight == 1.0 for e in drawn.edges)
