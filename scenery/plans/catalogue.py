"""The catalogue of named queries: Spark plans and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a plan under a name, with its SQL twin where there is one."""

    def register(plan):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = plan
        if sql is not None:
            _ORACLES[name] = sql
        return plan

    return register


def _load() -> None:
    import importlib
    import pkgutil

    import scenery.plans as here

    for module in pkgutil.iter_modules(here.__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"scenery.plans.{module.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["t03_absolute_distance"](spark, sf_dir)
