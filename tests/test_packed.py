"""Genomes as arrays follow the same rules, with the same draws, as genomes of objects."""

import numpy as np
import pandas as pd
import pytest

from galewright import online
from galewright.evolve.packed import PackedIslands, PackedMutator
from galewright.evolve.packed import crossover as packed_crossover
from galewright.evolve.populations import Islands
from galewright.evolve.variation import RATES, Innovations, Mutator, crossover
from galewright.nn.genome import Genome, seed_genome
from galewright.nn.packed import Packed
from galewright.nn.training import initialize
from galewright.spec import RunConfig, SeriesSpec


def grown(seed, mutations):
    rng = np.random.default_rng(seed)
    g = seed_genome(["a", "b"], ["a", "c"], "gru", 2, 1, 2)
    initialize(g, "random", rng)
    Mutator(rng, Innovations(100 * seed, 1000 * seed)).mutate(g, mutations)
    return g


def test_packed_genomes_have_the_same_structure():
    for seed in range(1, 8):
        g = grown(seed, 6 * seed)
        p = Packed.of(g)
        nodes, edges = g.reachable()
        assert p.to_row() == g.to_row() and p.outputs_unreachable() == g.outputs_unreachable()
        assert set(p.number[p.ends()[2]].tolist()) == nodes and {id(g.edges[k]) for k in p.ends()[3]} == edges
        assert p.get_weights().tolist() == g.get_weights().tolist()
        assert p.copy().weight is p.weight  # copies cost nothing that grows with the genome
        p.copy().set_weights(np.zeros(len(p.get_weights())))
        assert p.to_row() == g.to_row()


@pytest.mark.parametrize("name", [*RATES, None])
def test_mutations_draw_the_same(name):
    rates = RATES | {"split_edge": 1.0} if name is None else dict.fromkeys(RATES, 0.0) | {name: 1.0}
    for seed in range(1, 7):
        g, p = grown(seed, 12), Packed.of(grown(seed, 12))
        objects, packed = (kind(np.random.default_rng(seed), Innovations(90_000, 900_000), rates=rates) for kind in (Mutator, PackedMutator))
        count = 40 if name is None else 3
        assert objects.mutate(g, count) == packed.mutate(p, count)
        assert p.to_row() == g.to_row() and objects.innovations == packed.innovations
        assert objects.rng.random() == packed.rng.random()


def test_crossover_draws_the_same():
    for seed in range(1, 12):
        a, rng = grown(seed, 10), np.random.default_rng(seed)
        b, m = a.copy(), Mutator(rng, Innovations(90_000, 900_000))
        m.mutate(a, 8)
        m.mutate(b, 8)
        for better, worse in ((a, b), (b, a), (a, grown(seed + 20, 3))):
            first, second = np.random.default_rng(seed), np.random.default_rng(seed)
            child = packed_crossover(Packed.of(better), Packed.of(worse), second)
            assert child.to_row() == crossover(better, worse, first).to_row() and first.random() == second.random()


def test_runs_of_both_kinds_are_equal(spark, monkeypatch):
    t = np.arange(1500)
    df = spark.createDataFrame(pd.DataFrame({"s": 0, "t": t, "v": np.sin(t / 3) + t % 7 / 5}), "s int, t long, v double")
    spec = SeriesSpec(("v",), ("v",), offset=1, length=8)
    config = RunConfig(islands=3, island_size=3, generated=2, generations=150, iterations=1, training_episodes=6, validation_episodes=2, repopulate_every=9, repopulation="random_parents", seed=5)
    runs = []
    for kind in (PackedIslands, Islands):
        monkeypatch.setattr(online, "islands", kind)
        runs.append(online.OnlineRun(spark, online.prepare_episodes(df, "s", "t", spec), spec, config, batch=3))
        runs[-1].run()
    assert len(runs[0].log) == 150 and [str(r) for r in runs[0].log] == [str(r) for r in runs[1].log]
    assert isinstance(runs[0].best, Packed) and isinstance(runs[1].best, Genome) and runs[0].best.to_row() == runs[1].best.to_row()


def test_large_packed_generations_go_to_the_cluster(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(6, 8, 2)), rng.normal(size=(6, 8, 2))
    spec, config = SeriesSpec(("a", "b"), ("a", "c"), length=8), RunConfig(iterations=1)
    done = []
    for bound in (0, online.DRIVER_OPERATIONS):
        monkeypatch.setattr(online, "DRIVER_OPERATIONS", bound)
        done.append(online.train_genomes(spark, [(Packed.of(grown(1, 4)), [0, 1, 2])], x, y, [4, 5], spec, config, 2, {}, 3)[0])
    assert all(isinstance(g, Packed) for g in done) and np.isclose(done[0].fitness, done[1].fitness, rtol=1e-9)
    assert np.allclose(done[0].get_weights(), done[1].get_weights(), rtol=0, atol=1e-9)
