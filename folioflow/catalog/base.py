"""Registry of named queries over the given tables, with the equal SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(value: Column) -> Column:
    """Six decimals by floor(x * 1e6 + 0.5): the same arithmetic in every engine."""
    return F.floor(value * 1e6 + 0.5) / 1e6


def r10(value: Column) -> Column:
    return F.floor(value * 1e10 + 0.5) / 1e10


def r10s(expr: str) -> str:
    return f"floor(({expr}) * 1e10::DOUBLE + 0.5::DOUBLE) / 1e10::DOUBLE"


def r6s(expr: str) -> str:
    return f"floor(({expr}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"


def joined(values) -> Column:
    """An array as comma-separated text."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")
