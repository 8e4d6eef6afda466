"""The named queries of the engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from pmx.deploy import shipped

Query = Callable[[SparkSession, str], DataFrame]
#: The modules of pmx.plans, in order.
PLANS = ["prices", "periods", "enrichment", "addresses", "categories", "chain", "backtest", "surfaces", "semantic", "learning", "selections", "sources"]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its DuckDB SQL where there is one."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = f
        if oracle:
            _oracles[name] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    _load()
    return {name: shipped(f) for name, f in _queries.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)


def _load() -> None:
    """Import the modules that register queries."""
    for name in PLANS:
        import_module(f"pmx.plans.{name}")
