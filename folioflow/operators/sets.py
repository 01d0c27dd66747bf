"""Unions, differences and ordered distinct."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine_outputs(**outputs: DataFrame) -> DataFrame:
    """Union of the outputs of a run; the argument name becomes the ``role`` tag."""
    tagged = [df.withColumn("role", F.lit(role)) for role, df in outputs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def excluded_captures(captures: DataFrame, kept: DataFrame, key: Sequence[str]) -> DataFrame:
    """All captures but the kept ones."""
    return captures.join(kept.select(*key), list(key), "left_anti")


def ordered_distinct(df: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """First occurrence of every value of a key, with its order columns. Combined before the shuffle."""
    first = F.min(F.struct(*order)).alias("_first")
    return df.groupBy(*key, value).agg(first).select(*key, value, "_first.*")
