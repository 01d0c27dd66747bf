"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.session import shared_dir
from folioflow.ship import ship

# A word of the whitespace kind: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

# Staged sides of up to so many narrow rows (or rows with a short array) are broadcast, some 100 MB at most;
# beyond that the same joins shuffle.
BROADCAST_ROWS = 4_000_000
BROADCAST_DOCUMENTS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: lineage ends, rows stay fixed, lost executors do no harm."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/folioflow-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(small: DataFrame, rows: int = BROADCAST_ROWS, count: int | None = None) -> DataFrame:
    """Broadcast a side whose counted size, or a known upper limit of it, is within the bound."""
    return F.broadcast(small) if (small.count() if count is None else count) <= rows else small


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Narrow Arrow pass whose function may use this package on every executor."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def words(text: Column) -> Column:
    """White-space words of a text, in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(columns, *names: str) -> list[str]:
    """Working column names that do not clash with the given ones."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column behind a generator of one row, which later filters are not pushed through.

    A filter on a plain column is pushed below it with the whole expression
    copied in, also into the bodies of higher-order functions.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def set_aside(df: DataFrame, names) -> tuple[DataFrame, dict[str, str]]:
    """Rename input columns whose names an operator needs to ``in_<name>``.

    Returns the frame and {current name: original name} of all its columns.
    """
    names = {n.lower() for n in names}
    clashing = [c for c in df.columns if c.lower() in names]
    away = dict(zip(clashing, fresh([*df.columns, *names], *[f"in_{c}" for c in clashing])))
    out = df.select(*[F.col(f"`{c}`").alias(away.get(c, c)) for c in df.columns])
    return out, {away.get(c, c): c for c in df.columns}


def restored(df: DataFrame, original: dict[str, str]) -> DataFrame:
    """Only the input's own columns, under their original names."""
    return df.select(*[F.col(f"`{now}`").alias(was) for now, was in original.items()])
