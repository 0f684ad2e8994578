"""Registry of the retrieval engine's queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

FLAGSHIP = "flagship_retrieval"
QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers ``f(spark, sf_dir) -> DataFrame`` under ``name``, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


for _module in ("retrieval", "relational", "graphs", "sessions", "evidence", "maintenance", "scalars", "streams", "rescue", "ingest", "knowledge", "spectra", "confidence"):
    import_module(f"marlstone.plans.{_module}")
