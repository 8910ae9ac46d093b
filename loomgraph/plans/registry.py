"""Collects the registered queries and their SQL checks from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("search", "documents", "graph", "lifecycle", "modelio", "datasets", "evaluation")


class Plans:
    """Queries of one plan module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Decorator: register a query and, when SQL can state it, its check."""

        def wrap(fn):
            if name in self.queries:
                raise ValueError(f"{name} registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return wrap


def all_plans() -> list[Plans]:
    return [import_module(f"loomgraph.plans.{m}").PLANS for m in MODULES]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for p in all_plans() for k, v in p.queries.items()}


def all_sql() -> dict[str, str]:
    return {k: v for p in all_plans() for k, v in p.sql.items()}
