"""Registered queries over the given tables, each beside its oracle SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = [
    "interval_queries", "annotation_queries", "motif_queries", "effect_queries", "stats_queries", "source_queries",
    "reader_queries", "roundtrip_queries", "surface_queries", "plan_queries",
]


def load():
    for m in _MODULES:
        import_module(f"exonloom.catalog.{m}")
    from exonloom.catalog.base import QUERIES

    return QUERIES


def oracles():
    load()
    from exonloom.catalog.base import ORACLES

    return ORACLES
