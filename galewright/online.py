"""Online forecasting: episodes of series, networks trained in parallel, a population that evolves from generation to
generation.

A generation whose work is a few seconds of one core trains in the driver's JVM (`nn/jvm.py`). A larger one is one Spark job: genomes are rows, each is
trained by one task (`mapInPandas` over genome numbers) on the episodes that were drawn for it. Episodes stay on the cluster: the driver knows their ids, holds a bounded number of those used last, and ships those of one generation, whose
number the configuration bounds (training + validation + test). Decisions about tens of genomes stay on the driver.
"""

from __future__ import annotations

import json
import logging
import math
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewright.evolve.packed import PackedIslands, islands
from galewright.evolve.populations import Species, SteadyIslands
from galewright.nn import jvm
from galewright.nn.genome import Genome, seed_genome
from galewright.nn.network import errors, loss_and_gradient, predict
from galewright.nn.packed import Packed
from galewright.nn.training import Optimizer, initialize, train
from galewright.operators import series as S
from galewright.operators.sampling import hash_unit
from galewright.spec import RunConfig, SeriesSpec

logger = logging.getLogger(__name__)

#: Operations on numbers up to which a generation is trained on the driver: a few seconds of one core.
DRIVER_OPERATIONS = 1_000_000_000


def prepare_episodes(df: DataFrame, series: str, t: str, spec: SeriesSpec) -> DataFrame:
    """``(episode_id, x, y)``: normalised inputs and outputs of each episode as arrays (time, columns)."""
    bounds = S.fit_bounds(df, spec.columns, given=spec.bounds)
    scaled = df if spec.normalization == "none" else S.normalize(df, bounds, spec.columns, mode=spec.normalization)
    pairs = S.offset_pairs(scaled, series, t, list(spec.inputs), list(spec.outputs), spec.offset, list(spec.shifted))
    cut = S.episodes(pairs, series, t, spec.length)
    row = F.struct("step", F.array(*[f"x_{c}" for c in spec.inputs]).alias("x"), F.array(*[f"y_{c}" for c in spec.outputs]).alias("y"))
    return cut.groupBy("episode_id").agg(F.array_sort(F.collect_list(row)).alias("r")).select("episode_id", F.col("r.x").alias("x"), F.col("r.y").alias("y"))


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("episode_id")
    stack = lambda c: np.stack([np.stack([np.asarray(v, float) for v in row]) for row in pdf[c]]) if len(pdf) else np.zeros((0, 1, 1))
    return stack("x"), stack("y")


def _gradients(data: DataFrame, genomes: list[Genome], spec: SeriesSpec, column: str = "held") -> dict[int, tuple[np.ndarray, float, float, float, float, int, int]]:
    """Per genome, summed over all episodes of any number: gradient, squared and absolute errors of training and held-out
    episodes, and their numbers. Episodes stay where they are; partial sums of a few numbers travel."""
    texts, inputs = [json.dumps(g.to_row()) for g in genomes], list(spec.inputs)

    def run(batches):
        gs = [Genome.from_row(json.loads(t)) for t in texts]
        sums = [np.zeros(len(g.get_weights()) + 6) for g in gs]
        for b in batches:
            for is_held in (False, True):
                part = b[b[column].astype(bool) == is_held]
                if not len(part):
                    continue
                x, y = _arrays(part)
                for g, s in zip(gs, sums):
                    mse, mae = errors(predict(g, x, inputs), y)
                    s[-6 + 3 * is_held : (-3 + 3 * is_held) or None] += np.array([mse * len(x), mae * len(x), len(x)])
                    if not is_held:
                        s[:-6] += loss_and_gradient(g, x, y, inputs)[1] * len(x)
        yield pd.DataFrame([{"job": k, "place": j, "v": float(v)} for k, s in enumerate(sums) for j, v in enumerate(s)])

    parts = data.select("episode_id", "x", "y", column).mapInPandas(run, "job int, place int, v double")
    rows = parts.groupBy("job", "place").agg(F.sum("v").alias("v")).collect()  # as many as the genomes have weights
    out = {}
    for k in range(len(genomes)):
        v = np.array([r["v"] for r in sorted((r for r in rows if r["job"] == k), key=lambda r: r["place"])])
        n, m = max(1, v[-4]), max(1, v[-1])
        out[k] = (v[:-6] / n, v[-6] / n, v[-5] / n, v[-3] / m, v[-2] / m, int(v[-4]), int(v[-1]))
    return out


def train_grid(spark: SparkSession, data: DataFrame, spec: SeriesSpec, jobs: list[dict], iterations: int = 10, rate: float = 0.01) -> DataFrame:
    """Full-batch training of several networks (``job, cell, hidden, layers, seed``) at once over any number of episodes.

    ``data`` has a boolean column ``held``: held-out episodes only validate. Each iteration is one pass over the episodes.
    One row per job: its best validation errors and the training errors beside them.
    """
    data = data.persist()
    genomes = []
    for job in jobs:
        g = seed_genome(list(spec.inputs), list(spec.outputs), job["cell"], int(job["hidden"]), int(job["layers"]), 1)
        initialize(g, "xavier", np.random.default_rng(int(job["seed"])))
        genomes.append(g)
    optimizers = [Optimizer(rate=rate) for _ in genomes]
    best: dict[int, dict] = {}
    for it in range(iterations + 1):
        for k, (gradient, mse, mae, held_mse, held_mae, n, m) in _gradients(data, genomes, spec).items():
            if k not in best or held_mse < best[k]["validation_mse"]:
                best[k] = dict(jobs[k], train_mse=mse, train_mae=mae, validation_mse=held_mse, validation_mae=held_mae, n_training=n, n_validation=m, genome=json.dumps(genomes[k].to_row()))
            if it < iterations and np.isfinite(gradient).all():
                genomes[k].set_weights(optimizers[k].step(genomes[k].get_weights(), gradient))
    data.unpersist()
    return spark.createDataFrame(pd.DataFrame([best[k] for k in sorted(best)]))


def kfold_sweep(spark: SparkSession, data: DataFrame, spec: SeriesSpec, cells: list[str], folds: int = 5, repeats: int = 1, iterations: int = 10, hidden: int = 2) -> DataFrame:
    """Architectures x folds x repeats over all episodes, each fold held out in turn: ``(cell, fold, repeat, train_*, test_*)``.
    Folds go by a hash of the episode id."""
    fold = F.floor(hash_unit(F.col("episode_id"), 17) * folds)
    out = None
    for f in range(folds):
        jobs = [{"job": k, "cell": c, "hidden": hidden, "layers": 1, "seed": r, "fold": f, "repeat": r} for k, (c, r) in enumerate((c, r) for c in cells for r in range(repeats))]
        part = train_grid(spark, data.withColumn("held", fold == f), spec, jobs, iterations)
        part = part.select("cell", "fold", "repeat", "train_mse", "train_mae", F.col("validation_mse").alias("test_mse"), F.col("validation_mae").alias("test_mae"))
        out = part if out is None else out.unionByName(part)
    return out


def train_genomes(spark: SparkSession, work: list[tuple[Genome, list[int]]], x: np.ndarray, y: np.ndarray, held: list[int], spec: SeriesSpec, config: RunConfig, batch: int = 1, known: dict | None = None, shown: int | None = None) -> dict[int, Genome]:
    """Trains genomes on the cluster, a task each, and gives them back by id with their validation error as fitness. Each comes with the places of
    its training episodes in ``x`` and ``y``; one without is only validated, on the episodes at the places ``held``. Where a job would cost more than
    the work, the driver's JVM does it and leaves its programs of the genomes in ``known``, with their outputs for the episode at the place ``shown``."""
    genomes = [g for g, _ in work]
    passes = [3 * config.iterations * len(places) + (config.iterations + 1) * len(held) for _, places in work]
    if jvm.fits(genomes) and sum(n * x.shape[1] * jvm.operations(g) for n, g in zip(passes, genomes)) <= DRIVER_OPERATIONS:
        seeds = [config.seed * 1_000_003 + g.genome_id for g in genomes]
        jvm.train_all(spark, work, x, y, held, list(spec.inputs), config.iterations, Optimizer(config.update, config.learning_rate), batch, seeds, known, shown)
        return {g.genome_id: g for g in genomes}
    rows = [(g.genome_id, json.dumps(g.to_row()), places) for g, places in work]
    # The episodes of one generation, whose number the configuration bounds, travel with the job: no shuffle.
    shared = spark.sparkContext.broadcast((rows, x, y))
    inputs, iterations, update, rate, seed = list(spec.inputs), config.iterations, config.update, config.learning_rate, config.seed

    def run(batches):
        rows, x, y = shared.value
        for ids in batches:
            out = []
            for k in ids["id"]:
                genome_id, text, places = rows[k]
                g = Genome.from_row(json.loads(text))
                if places:
                    train(g, x[places], y[places], x[held], y[held], inputs, iterations, Optimizer(update, rate), batch, seed=seed * 1_000_003 + genome_id)
                else:
                    g.fitness = errors(predict(g, x[held], inputs), y[held])[0]
                out.append({"genome_id": genome_id, "genome": json.dumps(g.to_row())})
            yield pd.DataFrame(out, columns=["genome_id", "genome"])

    done = spark.range(0, len(rows), 1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "genome_id long, genome string").collect()
    shared.destroy()
    out = {r["genome_id"]: Genome.from_row(json.loads(r["genome"])) for r in done}
    return {k: Packed.of(out[k]) if isinstance(g, Packed) else out[k] for k, g in ((g.genome_id, g) for g in genomes)}


class OnlineRun:
    """The generation loop: draw episodes for each genome, train, validate on the next episodes, forecast the one after."""

    def __init__(self, spark: SparkSession, episodes: DataFrame, spec: SeriesSpec, config: RunConfig, batch: int = 1, held_episodes: int = 4096):
        self.held_episodes, self.held = held_episodes, {}
        self.programs: dict[int, jvm.Program] = {}
        self.spark, self.spec, self.config, self.batch = spark, spec, config, batch
        # The run looks at the episodes up to its last generation's test. In order of id, so that a generation's episodes are found by few blocks.
        needed = config.generations + config.training_episodes + config.validation_episodes + 1
        self.episodes = episodes.select("episode_id", "x", "y").repartitionByRange("episode_id").sortWithinPartitions("episode_id").persist()
        self.ids = sorted(int(r[0]) for r in self.episodes.select("episode_id").collect())[:needed]
        self.population = islands(config, seed_genome(list(spec.inputs), list(spec.outputs)))
        self.mse = np.ones(len(self.ids))
        self.best: Genome | Packed | None = None
        self.began = time.perf_counter()
        self.log: list[dict] = []
        self.time_log: list[dict] = []
        self.training_log: list[dict] = []
        self.priority_log: list[dict] = []

    @property
    def generations(self) -> int:
        return max(0, min(self.config.generations, len(self.ids) - self.config.training_episodes - self.config.validation_episodes))

    def _fetch(self, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The episodes at these places. Missing ones are fetched together with the next ones that will be asked for; at most
        ``held_episodes`` stay on the driver, those that were used last."""
        missing = [k for k in places if k not in self.held]
        if missing:
            ahead = range(max(places) + 1, min(max(places) + 1 + self.held_episodes // 4, len(self.ids)))
            wanted = {self.ids[k]: k for k in [*missing, *(k for k in ahead if k not in self.held)]}
            low, high = min(wanted), max(wanted)
            asked = self.episodes.where(F.col("episode_id").between(low, high) & F.col("episode_id").isin(list(wanted)))
            pdf = asked.toPandas().sort_values("episode_id")
            x, y = _arrays(pdf)
            self.held |= {wanted[int(i)]: (x[k], y[k]) for k, i in enumerate(pdf["episode_id"])}
        out = [self.held.pop(k) for k in places]
        self.held |= dict(zip(places, out))
        for k in list(self.held)[: max(0, len(self.held) - max(self.held_episodes, len(places)))]:
            del self.held[k]
        return np.stack([x for x, _ in out]), np.stack([y for _, y in out])

    def _draw(self, generation: int, genome_id: int) -> list[int]:
        """Places of training episodes for one genome: uniform, or by priority, without replacement."""
        c = self.config
        n = generation + c.training_episodes
        u = np.random.default_rng([c.seed, generation, genome_id]).random(n)
        if c.prioritized:
            priority = np.exp(-c.decay * (generation - np.arange(n))) / (self.mse[:n] + c.epsilon)
            key = -np.log(np.maximum(u, 1e-300)) / priority**c.alpha
        else:
            key = u
        return [int(k) for k in np.argsort(key, kind="stable")[: c.training_episodes]]

    def step(self, generation: int) -> dict:
        c, p = self.config, self.population
        now = generation + c.training_episodes
        validation, test = list(range(now, now + c.validation_episodes)), now + c.validation_episodes
        genomes = p.generate(generation)
        drawn = {g.genome_id: self._draw(generation, g.genome_id) for g in genomes}
        elites = [g for i in p.islands for g in i.elite]
        used = sorted({k for d in drawn.values() for k in d} | set(validation))
        place = {k: j for j, k in enumerate(used)}
        all_x, all_y = self._fetch(used + [test] * (test < len(self.ids)))
        held = [place[k] for k in validation]
        work = [(g, [place[k] for k in drawn[g.genome_id]]) for g in genomes] + [(g, []) for g in elites]
        trained = train_genomes(self.spark, work, all_x, all_y, held, self.spec, c, self.batch, self.programs, len(used) if test < len(self.ids) else None)
        for g in elites:
            g.fitness = trained[g.genome_id].fitness
        self.best = p.finish(generation, [trained[g.genome_id] for g in genomes])
        row = {"generation": generation, "test_episode": self.ids[test] if test < len(self.ids) else -1, "best_validation_mse": self.best.fitness if self.best else math.nan, "naive_mse": math.nan, "model_mse": math.nan}
        if self.best and test < len(self.ids):
            program = self.programs.get(self.best.genome_id)
            y, predicted = all_y[-1], program.shown if program else predict(Genome.from_row(self.best.to_row()), all_x[-1:], list(self.spec.inputs))[0]
            row["naive_mse"], row["model_mse"] = float(((y[1:] - y[:-1]) ** 2).mean()), float(((y[1:] - predicted[1:]) ** 2).mean())
            p.compare(generation, row["naive_mse"], row["model_mse"])
        erased = p.repopulate(generation)
        row["erased_island"], row["erased_islands"] = (erased[0] if erased else None), ";".join(map(str, erased))
        kept = {g.genome_id for i in p.islands for g in i.elite}
        self.programs = {k: v for k, v in self.programs.items() if k in kept}
        self._update_priorities(generation)
        for g in genomes:
            self.training_log.append({"genome_id": g.genome_id, "generation": generation, "indices": ";".join(str(self.ids[k]) for k in drawn[g.genome_id])})
        for island in p.islands:
            row[f"island_{island.number}_best"] = island.best()
            row[f"island_{island.number}_worst"] = island.elite[-1].fitness if island.elite else math.inf
        self.time_log.append({"generation": generation, "elapsed_ms": (time.perf_counter() - self.began) * 1000})
        self.log.append(row)
        return row

    def _update_priorities(self, generation: int) -> None:
        if not self.config.prioritized:
            return
        fits = [g.fitness for i in self.population.islands for g in i.elite]
        if not fits:
            return
        if generation < len(self.mse):
            self.mse[generation] = min(fits)
        low = max(0, generation - self.config.training_episodes)
        self.mse[low:generation] = 0.7 * self.mse[low:generation] + 0.3 * float(np.mean(fits))
        # What a generation changed; the other episodes keep what they had, 1 at first.
        self.priority_log += [{"generation": generation, "episode_id": self.ids[k], "mse": float(self.mse[k])} for k in range(low, min(generation + 1, len(self.mse)))]

    def save(self, path: str) -> None:
        """The run's state as one row of JSON, in a file system that the cluster shares."""
        p = self.population
        state = {
            "done": len(self.log), "next_id": p.next_id, "size": p.size, "wins": p.wins, "shrunk": p.shrunk, "mse": list(self.mse), "log": self.log, "rng": p.rng.bit_generator.state,
            "innovations": [p.mutator.innovations.node, p.mutator.innovations.edge],
            "islands": [{"status": i.status, "immune": i.immune, "elite": [g.to_row() for g in i.elite]} for i in p.islands],
        }
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(path)

    def resume(self, path: str) -> None:
        """Goes on from a saved state: the next generations are those that an unbroken run would have had."""
        state, p = json.loads(self.spark.read.text(path).collect()[0][0]), self.population
        read = Packed.of if isinstance(p, PackedIslands) else lambda g: g
        p.next_id, p.size, p.wins, p.shrunk, self.mse, self.log = state["next_id"], state["size"], state["wins"], state["shrunk"], np.array(state["mse"]), state["log"]
        p.rng.bit_generator.state = state["rng"]
        p.mutator.innovations.node, p.mutator.innovations.edge = state["innovations"]
        for island, saved in zip(p.islands, state["islands"]):
            island.status, island.immune, island.elite = saved["status"], saved["immune"], [read(Genome.from_row(g)) for g in saved["elite"]]
        self.best = p.best()

    def run(self) -> DataFrame:
        for g in range(len(self.log), self.generations):
            row = self.step(g)
            logger.info("generation %d: best %g, naive %g, model %g, %d ms", g, row["best_validation_mse"], row["naive_mse"], row["model_mse"], self.time_log[-1]["elapsed_ms"])
        self.episodes.unpersist()
        return self.spark.createDataFrame(pd.DataFrame(self.log).astype({"erased_island": "float64"}, errors="ignore"))


class SearchRun:
    """A search over a fixed set of episodes by the older strategies: steady-state islands (``island`` or no name) or species (``neat``).

    Genomes are made and trained a batch of ``generated`` at a time, as a task each, and inserted in order of their id until
    ``generations`` times ``generated`` were evaluated. Each trains on ``training_episodes`` episodes drawn for it; ``validation_episodes``
    drawn for all validate and stay out of training.
    """

    def __init__(self, spark: SparkSession, episodes: DataFrame, spec: SeriesSpec, config: RunConfig, batch: int = 1):
        if config.strategy == "online":
            raise ValueError("online runs are OnlineRun's")
        self.spark, self.spec, self.config, self.batch = spark, spec, config, batch
        wanted = config.validation_episodes + config.generated * config.training_episodes
        drawn = [int(r[0]) for r in sampled_ids(episodes, wanted, config.seed).collect()]  # bounded by the configuration
        pdf = episodes.where(F.col("episode_id").isin(drawn)).toPandas()
        self.x, self.y = _arrays(pdf)
        order = {k: j for j, k in enumerate(sorted(int(v) for v in pdf["episode_id"]))}
        places = [order[k] for k in drawn]
        self.validating, self.training = places[: config.validation_episodes], places[config.validation_episodes :]
        seed = seed_genome(list(spec.inputs), list(spec.outputs))
        self.population = Species(config, seed) if config.strategy == "neat" else SteadyIslands(config, seed)
        self.log: list[dict] = []

    def run(self) -> DataFrame:
        """``(evaluated, best, place, groups)`` of each inserted genome: the place or species it took and how many islands or species are filled."""
        c, p = self.config, self.population
        for _ in range(c.generations):
            genomes = [p.generate() if c.strategy == "neat" else p.generate_one(c.generations * c.generated) for _ in range(c.generated)]
            work = []
            for g in filter(None, genomes):
                rng = np.random.default_rng([c.seed, g.genome_id])
                work.append((g, [self.training[int(k)] for k in rng.permutation(len(self.training))[: c.training_episodes]]))
            trained = train_genomes(self.spark, work, self.x, self.y, self.validating, self.spec, c, self.batch)
            for g, _ in work:
                done = trained[g.genome_id]
                if c.strategy == "neat":
                    place = p.insert(done)
                    p.check()
                    best, groups = p.best, sum(map(bool, p.species))
                else:
                    place = p.insert(done, c.repopulate_every)
                    best, groups = p.best(), sum(bool(i.elite) for i in p.islands)
                self.log.append({"evaluated": len(self.log) + 1, "best": best.fitness if best else math.nan, "place": int(place), "groups": groups})
        return self.spark.createDataFrame(pd.DataFrame(self.log))


def search(spark: SparkSession, episodes: DataFrame, spec: SeriesSpec, config: RunConfig, batch: int = 1) -> OnlineRun | SearchRun:
    """The run that the configuration's strategy names."""
    return (OnlineRun if config.strategy == "online" else SearchRun)(spark, episodes, spec, config, batch)


def score(spark: SparkSession, genome: Genome, episodes: DataFrame, spec: SeriesSpec) -> DataFrame:
    """``(episode_id, step, output, expected, predicted)`` of one network over any number of episodes, in Arrow batches."""
    text, inputs, outputs = json.dumps(genome.to_row()), list(spec.inputs), list(spec.outputs)

    def run(batches):
        g = Genome.from_row(json.loads(text))
        for b in batches:
            if not len(b):
                continue
            x, y = _arrays(b)
            p = predict(g, x, inputs)
            ids = np.sort(b["episode_id"].to_numpy())
            n, steps, outs = p.shape
            yield pd.DataFrame({
                "episode_id": np.repeat(ids, steps * outs), "step": np.tile(np.repeat(np.arange(steps), outs), n), "output": np.tile(np.array(outputs, dtype=object), n * steps),
                "expected": y.reshape(-1), "predicted": p.reshape(-1),
            })

    return episodes.select("episode_id", "x", "y").mapInPandas(run, "episode_id long, step long, output string, expected double, predicted double")


def sampled_ids(episodes: DataFrame, n: int, seed: int) -> DataFrame:
    """Uniformly drawn episode ids on the cluster, for stores of episodes that are too large for the driver."""
    return episodes.select("episode_id").withColumn("__u", hash_unit(F.col("episode_id"), seed)).orderBy("__u", "episode_id").limit(n).drop("__u")
