"""Named queries over the given tables, each with the SQL text that states the same result."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register `f(spark, sf_dir) -> DataFrame`."""
    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return add


MODULES = ["indicators", "rolling", "tables", "cleaning", "joins", "metrics", "risk", "signals", "attribution",
           "weights", "learning", "datasets", "streams"]


def load_all() -> None:
    import importlib.util
    for m in MODULES:
        if importlib.util.find_spec(f"quantloom.plans.{m}") is not None:
            import_module(f"quantloom.plans.{m}")
