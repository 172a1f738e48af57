"""Roles of columns and checked configurations of runs."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field, fields, replace

# The names a configuration may use.
UPDATES = ("vanilla", "momentum", "nesterov", "adagrad", "rmsprop", "adam", "adam-bias")
WEIGHT_RULES = ("random", "xavier", "kaiming", "lamarckian", "gp")
STRATEGIES = ("", "island", "neat", "online")
NORMALIZATIONS = ("none", "min_max", "avg_std_dev")
REPOPULATIONS = ("random_parents", "best_parents", "best_genome", "best_island")


def merge_names(*lists: Iterable[str]) -> list[str]:
    """The union of name lists in the order of first appearance."""
    return list(dict.fromkeys(n for names in lists for n in names))


@dataclass(frozen=True)
class SeriesSpec:
    """Which columns are inputs, outputs, and inputs taken at the output's time (shifted), and which files train and test."""

    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    shifted: tuple[str, ...] = ()
    offset: int = 1
    length: int = 40
    normalization: str = "min_max"
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    training: tuple[int, ...] = ()
    testing: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        if not self.inputs or not self.outputs:
            raise ValueError("a series needs inputs and outputs")
        if unknown := set(self.shifted) - set(self.inputs):
            raise ValueError(f"shifted columns that are no inputs: {sorted(unknown)}")
        if self.offset < 0 or self.length < 1:
            raise ValueError("the offset can't be negative, the length not under 1")
        if self.normalization not in NORMALIZATIONS:
            raise ValueError(f"normalization must be one of {NORMALIZATIONS}")
        if both := set(self.training) & set(self.testing):
            raise ValueError(f"series that train and test: {sorted(both)}")

    @property
    def columns(self) -> list[str]:
        return merge_names(self.inputs, self.outputs, self.shifted)

    @classmethod
    def from_parameters(cls, parameters: dict[str, str], **more) -> SeriesSpec:
        """From ``{name: flags}`` with the flags i (input), o (output), b (both) and s (shifted input), each followed by
        bounds if the column has some: ``"b 0 100"``."""
        roles: dict[str, list[str]] = {"i": [], "o": [], "s": []}
        bounds = {}
        for name, text in parameters.items():
            flags, *limits = text.split()
            if not flags or set(flags) - set("iobs"):
                raise ValueError(f"unknown flags of {name}: {flags}")
            if len(limits) not in (0, 2):
                raise ValueError(f"{name} needs both bounds or none")
            if limits:
                bounds[name] = (float(limits[0]), float(limits[1]))
            for role in "ios":
                if role in flags or (role in "io" and "b" in flags) or (role == "i" and "s" in flags):
                    roles[role].append(name)
        return cls(tuple(roles["i"]), tuple(roles["o"]), tuple(roles["s"]), bounds=bounds, **more)


@dataclass(frozen=True)
class RunConfig:
    """A run of the search. Unknown keys and values are errors."""

    strategy: str = "online"
    islands: int = 10
    island_size: int = 10
    generated: int = 10
    generations: int = 50
    iterations: int = 10
    learning_rate: float = 0.001
    update: str = "adam"
    weight_rule: str = "xavier"
    crossover_weights: str = "lamarckian"
    mutation_weights: str = "lamarckian"
    repopulation: str = "best_genome"
    repopulate_every: int = 0
    erased_islands: int = 1
    repeat_extinction: bool = False
    mutations: int = 1
    repopulation_mutations: int = 0
    training_episodes: int = 300
    validation_episodes: int = 25
    prioritized: bool = True
    alpha: float = 0.6
    decay: float = 0.01
    epsilon: float = 1e-8
    max_recurrent_depth: int = 10
    seed: int = 1

    def __post_init__(self) -> None:
        for name, allowed in (
            ("strategy", STRATEGIES), ("update", UPDATES), ("repopulation", REPOPULATIONS), ("weight_rule", WEIGHT_RULES[:3]),
            ("crossover_weights", WEIGHT_RULES), ("mutation_weights", WEIGHT_RULES),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        # What is inherited must be the rule that weights began with, or the parents' own.
        for name in ("crossover_weights", "mutation_weights"):
            rule = getattr(self, name)
            if rule not in ("lamarckian", "gp") and rule != self.weight_rule:
                raise ValueError(f"{name} must be lamarckian, gp or {self.weight_rule}")
        for name in ("islands", "island_size", "generated", "generations", "iterations", "training_episodes", "validation_episodes", "erased_islands", "mutations"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    @classmethod
    def from_toml(cls, text: str) -> RunConfig:
        given = tomllib.loads(text)
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        return cls(**given)

    @classmethod
    def from_arguments(cls, arguments: list[str]) -> RunConfig:
        """From ``--name value`` pairs; dashes count as underscores."""
        out, known = cls(), {f.name: f for f in fields(cls)}
        pairs = dict(zip((a.removeprefix("--").replace("-", "_") for a in arguments[::2]), arguments[1::2]))
        if len(arguments) % 2 or (unknown := set(pairs) - set(known)):
            raise ValueError(f"arguments must be known names with values: {unknown if len(arguments) % 2 == 0 else arguments[-1]}")
        kinds = {k: type(getattr(out, k)) for k in pairs}
        return replace(out, **{k: v.lower() in ("1", "true", "yes") if kinds[k] is bool else kinds[k](v) for k, v in pairs.items()})
