"""The catalogue of the core's queries and of the SQL that states the same results."""

from __future__ import annotations

from galewright.plans import network, quality, relational, series, streams

MODULES = [quality, series, relational, network, streams]


def core_queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def core_oracles() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
