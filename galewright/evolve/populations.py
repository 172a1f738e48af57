"""Populations: islands with elites, the older steady-state islands, species. State of tens of genomes, kept by the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from galewright.evolve.variation import Innovations, Mutator, crossover, distance
from galewright.nn.genome import Genome
from galewright.nn.training import initialize
from galewright.spec import RunConfig


def insert_bounded(population: list[Genome], genome: Genome, size: int, shape=lambda g: g.shape()) -> int:
    """Inserts into a list sorted by fitness, after equals. A genome of the structure of another replaces it only if it is
    better. Returns its place, or -1 if it isn't taken."""
    if not math.isfinite(genome.fitness):
        return -1
    if len(population) >= size and genome.fitness >= population[-1].fitness:
        return -1
    key = shape(genome)
    for twin in population:
        if shape(twin) == key:
            if genome.fitness >= twin.fitness:
                return -1
            population.remove(twin)
            break
    place = sum(g.fitness <= genome.fitness for g in population)
    population.insert(place, genome)
    del population[size:]
    return place if place < size else -1


@dataclass
class Island:
    number: int
    status: str = "initializing"
    elite: list[Genome] = field(default_factory=list)
    generated: list[Genome] = field(default_factory=list)
    immune: int = 0

    def best(self) -> float:
        return self.elite[0].fitness if self.elite else math.inf

    def erase(self) -> None:
        self.elite, self.generated, self.status, self.immune = [], [], "repopulating", 5


class Islands:
    """Islands that generate in turns: mutation, crossover on the island, crossover between islands at 0.7, 0.2, 0.1."""

    def __init__(self, config: RunConfig, seed: Genome):
        self.config, self.seed = config, seed
        self.rng = np.random.default_rng(config.seed)
        node, edge = seed.max_innovations()
        self.mutator = Mutator(self.rng, Innovations(node, edge), max_delay=config.max_recurrent_depth, weights=config.mutation_weights)
        self.islands = [Island(k) for k in range(config.islands)]
        self.next_id = 1
        self.size = config.island_size
        self.rates = (0.7, 0.2, 0.1) if config.islands > 1 else (0.7, 0.3, 0.0)
        self.wins = {"naive": 0, "model": 0}
        self.shrunk = False
        self.shapes: dict[int, tuple[Genome, tuple]] = {}

    def _shape(self, genome: Genome) -> tuple:
        """A trained genome's structure, which no longer changes."""
        known, shape = self.shapes.get(genome.genome_id, (None, None))
        if known is not genome:
            shape = genome.shape()
            self.shapes[genome.genome_id] = genome, shape
        return shape

    def _number(self, genome: Genome, island: Island, generation: int) -> Genome:
        genome.genome_id, genome.island, genome.generation = self.next_id, island.number, generation
        self.next_id += 1
        return genome

    def generate(self, generation: int) -> list[Genome]:
        """The genomes to be trained in a generation, islands in turn."""
        return [self._number(self._one(island), island, generation) for _ in range(self.config.generated) for island in self.islands]

    def _fresh(self) -> Genome:
        g = self.seed.copy()
        initialize(g, self.config.weight_rule, self.rng)
        self.mutator.mutate(g, self.config.mutations)
        return g

    def _one(self, island: Island) -> Genome:
        if island.status == "repopulating":
            return self._repopulated(island)
        if len(island.elite) < 2:
            return self._fresh() if not island.elite else self._mutant(island)
        others = [i for i in self.islands if i is not island and i.elite]
        u = self.rng.random() * (sum(self.rates) if others else self.rates[0] + self.rates[1])
        if u < self.rates[0]:
            return self._mutant(island)
        if u < self.rates[0] + self.rates[1]:
            a, b = (island.elite[int(k)] for k in self.rng.permutation(len(island.elite))[:2])
        else:
            a = island.elite[int(self.rng.integers(len(island.elite)))]
            b = others[int(self.rng.integers(len(others)))].elite[0]
        return self._child(a, b)

    def _mutant(self, island: Island) -> Genome:
        g = island.elite[int(self.rng.integers(len(island.elite)))].copy()
        self.mutator.mutate(g, self.config.mutations)
        return g

    def _child(self, a: Genome, b: Genome) -> Genome:
        child = self._cross(*((a, b) if a.fitness <= b.fitness else (b, a)))
        if child.outputs_unreachable():
            child = (a if a.fitness <= b.fitness else b).copy()
            self.mutator.mutate(child, 1)
        return child

    def _cross(self, better: Genome, worse: Genome) -> Genome:
        return crossover(better, worse, self.rng, rule=self.config.crossover_weights)

    def _repopulated(self, island: Island) -> Genome:
        """A genome for an erased island from the others, with ``repopulation_mutations`` more mutations."""
        others = [i for i in self.islands if i is not island and i.elite]
        if not others:
            return self._fresh()
        mode, more = self.config.repopulation, self.config.repopulation_mutations
        if mode == "best_genome":
            g, more = min((i.elite[0] for i in others), key=lambda g: g.fitness).copy(), max(1, more)
        elif mode == "best_island":
            source = min(others, key=Island.best)
            g = source.elite[int(self.rng.integers(len(source.elite)))].copy()
        elif len(others) < 2:
            g = self._mutant(others[0])
        else:
            x, y = (others[int(k)] for k in self.rng.permutation(len(others))[:2])
            pick = (lambda i: i.elite[0]) if mode == "best_parents" else (lambda i: i.elite[int(self.rng.integers(len(i.elite)))])
            g = self._child(pick(x), pick(y))
        if more:
            self.mutator.mutate(g, more)
        return g

    def finish(self, generation: int, trained: list[Genome]) -> Genome | None:
        """Takes the trained genomes and re-evaluated elites, and returns the best genome of all islands."""
        for g in trained:
            self.islands[g.island].generated.append(g)
        for island in self.islands:
            island.elite = sorted((g for g in island.elite if math.isfinite(g.fitness)), key=lambda g: (g.fitness, g.genome_id))
            for g in sorted(island.generated, key=lambda g: g.genome_id):
                insert_bounded(island.elite, g, self.size, self._shape)
            island.generated = []
            island.status = "filled" if len(island.elite) >= self.size else ("repopulating" if island.status == "repopulating" else "initializing")
        kept = {g.genome_id for i in self.islands for g in i.elite}
        self.shapes = {k: v for k, v in self.shapes.items() if k in kept}
        return self.best()

    def best(self) -> Genome | None:
        return min((i.elite[0] for i in self.islands if i.elite), key=lambda g: (g.fitness, g.genome_id), default=None)

    def ranked(self) -> list[Island]:
        """From the worst to the best."""
        return sorted(self.islands, key=lambda i: (-i.best(), i.number))

    def repopulate(self, generation: int) -> list[int]:
        """Erases the ``erased_islands`` worst islands, every so many generations after the second such time; one that was erased is spared for
        the next five times, unless ``repeat_extinction``. At least one island stays. Returns their numbers."""
        every = self.config.repopulate_every
        if not every or generation <= 2 * every or generation % every or len(self.islands) < 2:
            return []
        for island in self.islands:
            island.immune = max(0, island.immune - 1)
        return self._erase(self.config.erased_islands)

    def _erase(self, most: int) -> list[int]:
        filled = [i for i in self.ranked() if i.elite]
        worst = [i for i in filled if self.config.repeat_extinction or not i.immune][: min(most, len(filled) - 1)]
        for island in worst:
            island.erase()
        return [i.number for i in worst]

    def compare(self, generation: int, naive_mse: float, model_mse: float) -> None:
        """Counts wins; once the model has more of them after generation 10, islands shrink to a quarter, one time."""
        self.wins["naive" if naive_mse < model_mse else "model"] += 1
        if generation > 10 and not self.shrunk and self.wins["model"] > self.wins["naive"]:
            self.shrunk, self.size = True, max(1, self.size // 4)
            for island in self.islands:
                del island.elite[self.size :]


class SteadyIslands(Islands):
    """The older strategy: one genome at a time, no generations; extinction by the number of evaluated genomes."""

    evaluated = 0
    turn = 0

    def generate_one(self, max_genomes: int) -> Genome | None:
        if self.evaluated > max_genomes:
            return None
        island = self.islands[self.turn % len(self.islands)]
        self.turn += 1
        return self._number(self._one(island), island, 0)

    def insert(self, genome: Genome, extinction_every: int = 0) -> int:
        self.evaluated += 1
        island = self.islands[genome.island]
        place = insert_bounded(island.elite, genome, self.size)
        if len(island.elite) >= self.size:
            island.status = "filled"
        if extinction_every and self.evaluated % extinction_every == 0 and len(self.islands) > 1:
            self._erase(self.config.erased_islands)
        return place


class Species:
    """Species by distance to each one's latest genome; shared fitness decides who goes."""

    def __init__(self, config: RunConfig, seed: Genome, threshold: float = 3.0, stagnation: int = 2250, most: int = 3000):
        self.config, self.seed, self.threshold, self.stagnation, self.most = config, seed, threshold, stagnation, most
        self.rng = np.random.default_rng(config.seed)
        node, edge = seed.max_innovations()
        self.mutator = Mutator(self.rng, Innovations(node, edge), max_delay=config.max_recurrent_depth, weights=config.mutation_weights)
        self.species: list[list[Genome]] = []
        self.latest: list[Genome] = []
        self.idle = 0
        self.best: Genome | None = None
        self.next_id = 1

    def insert(self, genome: Genome) -> int:
        """Its species' number."""
        if not math.isfinite(genome.fitness):
            return -1
        order = self.rng.permutation(len(self.species))
        home = next((int(k) for k in order if distance(genome, self.latest[int(k)]) < self.threshold), None)
        if home is None:
            self.species.append([])
            self.latest.append(genome)
            home = len(self.species) - 1
        members = self.species[home]
        members.insert(sum(g.fitness <= genome.fitness for g in members), genome)
        self.latest[home] = genome
        if self.best is None or genome.fitness < self.best.fitness:
            self.best, self.idle = genome, 0
        else:
            self.idle += 1
        return home

    def generate(self) -> Genome:
        filled = [s for s in self.species if s]
        if not filled:
            g = self.seed.copy()
            initialize(g, self.config.weight_rule, self.rng)
        else:
            s = filled[int(self.rng.integers(len(filled)))]
            if len(s) > 1 and self.rng.random() < 0.25:
                a, b = (s[int(k)] for k in self.rng.permutation(len(s))[:2])
                g = crossover(*((a, b) if a.fitness <= b.fitness else (b, a)), self.rng, rule=self.config.crossover_weights)
                if g.outputs_unreachable():
                    g = a.copy()
            else:
                g = s[int(self.rng.integers(len(s)))].copy()
        self.mutator.mutate(g, 1)
        g.genome_id, self.next_id = self.next_id, self.next_id + 1
        return g

    def check(self) -> bool:
        """After long stagnation, or with too many genomes, only the two best species stay."""
        if self.idle < self.stagnation and sum(map(len, self.species)) < self.most:
            return False
        keep = sorted((k for k in range(len(self.species)) if self.species[k]), key=lambda k: self.species[k][0].fitness)[:2]
        self.species, self.latest, self.idle = [self.species[k] for k in keep], [self.latest[k] for k in keep], 0
        return True

    def share(self, k: int) -> int:
        """Removes members whose shared fitness is above mean + 3 sqrt(sum of squares / (n - 1)); returns how many."""
        s = self.species[k]
        if len(s) < 3:
            return 0
        near = [sum(distance(a, b) < self.threshold for b in s) for a in s]
        shares = np.array([g.fitness / n for g, n in zip(s, near)])
        limit = shares.mean() + 3 * math.sqrt((shares**2).sum() / (len(s) - 1))
        self.species[k] = [g for g, v in zip(s, shares) if v <= limit]
        return len(s) - len(self.species[k])


def filled_with_mutants(seed: Genome, n: int, mutations: int, mutator: Mutator) -> list[Genome]:
    """``n`` mutated copies; the seed stays as it is."""
    out = []
    for _ in range(n):
        g = seed.copy()
        mutator.mutate(g, mutations)
        out.append(g)
    return out
