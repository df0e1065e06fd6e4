"""Registry of named queries: each has a Spark plan builder and, where the
semantics are SQL-expressible, an independent DuckDB oracle query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from hearth.functions.exprs import round_doubles
from hearth.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: QueryFn
    sql: str | None = None
    scale: int = 4
    overrides: dict[str, int] = field(default_factory=dict)
    round_output: bool = True

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        df = self.build(spark, sf_dir)
        return round_doubles(df, self.scale, self.overrides) if self.round_output else df


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, scale: int = 4, overrides: dict[str, int] | None = None,
             round_output: bool = True):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, scale, overrides or {}, round_output)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every module that registers queries."""
    from hearth.plans import (  # noqa: F401
        queries_core, queries_ingest, queries_market, queries_models, queries_profile, queries_scoring,
        queries_streaming,
        queries_training)
    return REGISTRY
