"""The engine's queries by name, each with its SQL oracle where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "hotspots"


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir) as a query."""

    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"graphloom.plans.{name}")


MODULES = ["graphs", "health", "traffic", "joins", "reports", "clones", "symbols", "texts", "formats"]
load()
