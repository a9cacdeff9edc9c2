"""Queries over the supplied tables."""

from __future__ import annotations

import importlib

MODULES = ["history_queries", "event_queries", "evaluate_queries", "table_queries", "scenario_queries", "model_queries"]


def all_queries():
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"raceframe.plans.{name}")
    return importlib.import_module("raceframe.plans.registry")
