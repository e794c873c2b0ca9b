"""Registered queries: each plan module binds operators to the test tables."""

from __future__ import annotations

import importlib

MODULES = [
    "sources", "cleaning", "category", "splits", "features", "popularity", "neighbors",
    "factors", "graph", "reranking", "evaluation", "places", "dashboard", "statistics", "text", "models",
]


def load_all() -> None:
    for name in MODULES:
        try:
            importlib.import_module(f"savora.plans.{name}")
        except ModuleNotFoundError as err:
            if err.name != f"savora.plans.{name}":
                raise
