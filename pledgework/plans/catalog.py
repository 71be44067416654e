"""Registered queries of the engine and their SQL."""

from __future__ import annotations

import importlib

from pledgework.plans import registry

MODULES = ("trait_queries", "dashboard_queries", "segment_queries", "import_queries", "identity_queries", "health_queries", "validation_queries", "reversal_queries", "feed_queries", "export_queries")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"pledgework.plans.{m}")


def queries():
    _load()
    return registry.QUERIES


def oracles():
    _load()
    return registry.ORACLES
