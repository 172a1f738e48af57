import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from galewright import online
from galewright.nn.genome import seed_genome
from galewright.nn.network import loss_and_gradient
from galewright.nn.training import initialize
from galewright.spec import RunConfig, SeriesSpec

SPEC = SeriesSpec(("v",), ("v",), offset=1, length=8)


def episodes(spark):
    t = np.arange(260)
    df = spark.createDataFrame(pd.DataFrame({"s": 0, "t": t, "v": np.sin(t / 3)}), "s int, t long, v double")
    return online.prepare_episodes(df, "s", "t", SPEC)


def test_distributed_gradient_equals_local(spark):
    e = episodes(spark).withColumn("held", F.col("episode_id") % 4 == 0).persist()
    g = seed_genome(["v"], ["v"], "gru", 2, 1, 1)
    initialize(g, "xavier", np.random.default_rng(1))
    gradient, mse, mae, held_mse, held_mae, n, m = online._gradients(e.repartition(5), [g], SPEC)[0]
    x, y = online._arrays(e.where("NOT held").toPandas())
    loss, want = loss_and_gradient(g, x, y, ["v"])
    assert np.allclose(gradient, want) and np.isclose(mse, loss) and (n, m) == (e.where("NOT held").count(), e.where("held").count())


def test_grid_and_folds(spark):
    e = episodes(spark)
    jobs = [{"job": k, "cell": c, "hidden": 1, "layers": 1, "seed": 2} for k, c in enumerate(("simple", "mgu"))]
    out = online.train_grid(spark, e.withColumn("held", F.col("episode_id") % 4 == 0), SPEC, jobs, 3).collect()
    assert [r["cell"] for r in out] == ["simple", "mgu"] and all(r["validation_mse"] > 0 for r in out)
    assert online.kfold_sweep(spark, e, SPEC, ["simple"], 2, 1, 1, 1).count() == 2


def test_run_is_repeatable(spark):
    config = RunConfig(islands=2, island_size=2, generated=1, generations=2, iterations=1, training_episodes=6, validation_episodes=2, seed=5)
    runs = [online.OnlineRun(spark, episodes(spark), SPEC, config, batch=3) for _ in range(2)]
    logs = [r.run().collect() for r in runs]
    assert logs[0] == logs[1] and len(logs[0]) == 2
    assert {r["generation"] for r in runs[0].priority_log} == {0, 1} and len(runs[0].training_log) == 4
    scored = online.score(spark, runs[0].best, episodes(spark), SPEC)
    assert scored.count() == episodes(spark).count() * SPEC.length
    assert online.sampled_ids(episodes(spark), 5, 1).count() == 5


def test_a_saved_run_goes_on_as_if_unbroken(spark, tmp_path):
    config = RunConfig(islands=2, island_size=2, generated=2, generations=3, iterations=1, training_episodes=5, validation_episodes=2, seed=8)
    whole = online.OnlineRun(spark, episodes(spark), SPEC, config, batch=5)
    whole.run()
    first = online.OnlineRun(spark, episodes(spark), SPEC, config, batch=5)
    first.step(0)
    first.save(str(tmp_path / "state"))
    second = online.OnlineRun(spark, episodes(spark), SPEC, config, batch=5)
    second.resume(str(tmp_path / "state"))
    second.run()
    assert [r["best_validation_mse"] for r in second.log] == [r["best_validation_mse"] for r in whole.log]


def small(**more):
    return RunConfig(**(dict(islands=2, island_size=3, generated=2, generations=3, iterations=1, training_episodes=5, validation_episodes=2, seed=4, max_recurrent_depth=3) | more))


def test_the_strategy_names_the_run(spark):
    e = episodes(spark)
    runs = {s: online.search(spark, e, SPEC, small(strategy=s), batch=5) for s in ("online", "island", "neat")}
    logs = {s: r.run() for s, r in runs.items()}
    assert isinstance(runs["online"], online.OnlineRun) and "naive_mse" in logs["online"].columns
    for s in ("island", "neat"):
        rows = logs[s].orderBy("evaluated").collect()
        assert len(rows) == 6 and all(a["best"] >= b["best"] for a, b in zip(rows, rows[1:])) and rows[-1]["groups"] >= 1
        again = online.search(spark, e, SPEC, small(strategy=s), batch=5).run().orderBy("evaluated").collect()
        assert again == rows
    assert type(runs["island"].population).__name__ == "SteadyIslands" and type(runs["neat"].population).__name__ == "Species"


def test_each_field_of_the_configuration_changes_the_run(spark):
    """What is checked is used: weight rules and numbers of mutations lead to other networks."""
    e = episodes(spark).persist()
    fit = lambda **more: [r["best_validation_mse"] for r in online.OnlineRun(spark, e, SPEC, small(generations=5, **more), batch=5).run().orderBy("generation").collect()]
    base = fit()
    for more in ({"mutations": 3}, {"mutation_weights": "xavier"}, {"crossover_weights": "xavier"}, {"weight_rule": "random"}, {"prioritized": False}, {"learning_rate": 0.1}):
        assert fit(**more) != base, more


def test_few_episodes_stay_on_the_driver(spark):
    """A run that may hold fewer episodes than it draws fetches more often and gives the same."""
    logs = [online.OnlineRun(spark, episodes(spark), SPEC, small(), batch=5, held_episodes=n).run().collect() for n in (1, 4096)]
    assert logs[0] == logs[1]
