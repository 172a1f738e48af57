import numpy as np
import pandas as pd
import pytest

from galewright import online
from galewright.evolve.variation import Innovations, Live, Mutator
from galewright.nn import jvm
from galewright.nn.cells import CELLS
from galewright.nn.genome import Edge, seed_genome
from galewright.nn.network import errors, predict
from galewright.nn.training import Optimizer, initialize, train
from galewright.spec import RunConfig, SeriesSpec

# A product and a mixture stay with the cluster; 1 / x is too steep around 0 to be compared.
TRACED = [c for c in CELLS if c not in ("multiply", "multiply_gp", "dnas", "inverse", "inverse_gp")]


def networks(cells):
    rng = np.random.default_rng(4)
    for k, c in enumerate(cells):
        g = seed_genome(["a", "b"], ["a"], c, 2, 2, 2)
        g.genome_id = k
        initialize(g, "random", rng)
        Mutator(rng, Innovations(100, 1000)).mutate(g, 3)
        yield g


@pytest.mark.parametrize("method", ["adam", "adam-bias", "nesterov", "rmsprop"])
def test_training_equals_the_tape(spark, method):
    """All cells' rules, uneven batches, episodes of which one genome sees others than the next."""
    rng = np.random.default_rng(1)
    x, y, held = rng.normal(size=(9, 8, 2)), rng.normal(size=(9, 8, 1)), [7, 8]
    work = [(g, [int(k) for k in rng.permutation(7)[:5]]) for g in networks(TRACED)]
    work.append((work[0][0].copy(), []))
    assert jvm.fits([g for g, _ in work])
    want = [(g.copy(), p) for g, p in work]
    jvm.train_all(spark, work, x, y, held, ["a", "b"], 2, Optimizer(method, 0.01), 2, [6] * len(work))
    for (got, _), (g, places) in zip(work, want):
        if places:
            train(g, x[places], y[places], x[held], y[held], ["a", "b"], 2, Optimizer(method, 0.01), 2, seed=6)
        else:
            g.fitness = errors(predict(g, x[held], ["a", "b"]), y[held])[0]
        assert np.isclose(got.fitness, g.fitness, rtol=1e-9) and np.allclose(got.get_weights(), g.get_weights(), rtol=0, atol=1e-9)
        assert np.allclose(jvm.predict(spark, jvm.Program(got, ["a", "b"]), x), predict(got, x, ["a", "b"]))


def test_training_that_is_not_finite_has_no_fitness(spark):
    (g,) = networks(["lstm"])
    x = np.full((3, 8, 2), np.inf)
    jvm.train_all(spark, [(g, [0, 1])], x, np.zeros((3, 8, 1)), [2], ["a", "b"], 1, Optimizer(), 1, [1])
    assert np.isnan(g.fitness)
    assert not jvm.fits(list(networks(["multiply"]))) and not jvm.fits(list(networks(["dnas"])))


def test_generations_start_no_jobs(spark):
    t = np.arange(400)
    df = spark.createDataFrame(pd.DataFrame({"s": 0, "t": t, "v": np.sin(t / 3)}), "s int, t long, v double")
    spec = SeriesSpec(("v",), ("v",), offset=1, length=8)
    config = RunConfig(islands=2, island_size=2, generated=1, generations=9, iterations=1, training_episodes=6, validation_episodes=2, seed=5)
    run = online.OnlineRun(spark, online.prepare_episodes(df, "s", "t", spec), spec, config, batch=3)
    run.step(0)  # fetches the episodes
    spark.sparkContext.setJobGroup("generations", "")
    for k in range(1, 9):
        run.step(k)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("generations") and len(run.log) == 9


def test_large_generations_go_to_the_cluster(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(6, 8, 2)), rng.normal(size=(6, 8, 1))
    spec, config = SeriesSpec(("a", "b"), ("a",), length=8), RunConfig(iterations=1)
    done = []
    for bound in (0, online.DRIVER_OPERATIONS):
        monkeypatch.setattr(online, "DRIVER_OPERATIONS", bound)
        known = {}
        done.append(online.train_genomes(spark, [(g, [0, 1, 2]) for g in networks(["gru", "delta"])], x, y, [4, 5], spec, config, 2, known))
        assert bool(known) == bool(bound)
    assert all(np.isclose(done[0][k].fitness, done[1][k].fitness, rtol=1e-9) for k in (0, 1))


def test_live_weights_follow_the_edges():
    rng = np.random.default_rng(7)
    for (g, *_) in [list(networks(["gru"])) for _ in range(3)]:
        m, live = Mutator(rng, Innovations(500, 5000)), Live(g)
        live.weights()
        for k in range(12):
            if k % 4 == 0:
                m._new_node(g, 0.5)
            a, b = (g.nodes[int(i)] for i in rng.permutation(len(g.nodes))[:2])
            g.edges.append(Edge(9000 + k, a.innovation, b.innovation, k % 3, float(k)))
            if a.enabled and b.enabled:
                live.add(g.edges[-1])
            assert live.weights() == list(g.get_weights())
