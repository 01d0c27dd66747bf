"""Arrow batches in and out of small numpy helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {
    "boolean": (T.BooleanType(), pa.bool_()),
    "int": (T.IntegerType(), pa.int32()),
    "bigint": (T.LongType(), pa.int64()),
    "double": (T.DoubleType(), pa.float64()),
    "string": (T.StringType(), pa.string()),
    "binary": (T.BinaryType(), pa.binary()),
    "array<int>": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "array<double>": (T.ArrayType(T.DoubleType()), pa.list_(pa.float64())),
}


def appended_schema(df: DataFrame, outputs: Sequence[tuple[str, str]]) -> T.StructType:
    return T.StructType(df.schema.fields + [T.StructField(n, _TYPES[t][0], True) for n, t in outputs])


def column_values(column: pa.Array) -> list:
    """Per-row values; list columns become numpy views instead of Python lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    if pa.types.is_list(kind) and not pa.types.is_nested(kind.value_type):
        flat = column.values.to_numpy(zero_copy_only=False)
        ends = column.offsets.to_numpy()
        rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        if column.null_count:
            rows = [r if ok else None for r, ok in zip(rows, column.is_valid().to_pylist())]
        return rows
    return column.to_pylist()


def append_columns(batch: pa.RecordBatch, outputs, values: Sequence[Sequence]) -> pa.RecordBatch:
    arrays = list(batch.columns)
    names = list(batch.schema.names)
    for (name, kind), column in zip(outputs, values):
        arrays.append(pa.array(column, type=_TYPES[kind][1]))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def map_rows(
    df: DataFrame,
    columns: Sequence[str],
    fn: Callable[..., tuple],
    outputs: Sequence[tuple[str, str]],
) -> DataFrame:
    """Append ``fn(*columns)`` to every row. Narrow: no shuffle, one Arrow batch at a time."""
    columns, outputs = list(columns), list(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[column_values(batch.column(c)) for c in columns])
            results = [fn(*row) for row in rows]
            yield append_columns(batch, outputs, list(zip(*results)) if results else [[] for _ in outputs])

    return df.mapInArrow(run, appended_schema(df, outputs))


def as_list(value: Iterable | np.ndarray | None) -> list | None:
    if value is None:
        return None
    return value.tolist() if isinstance(value, np.ndarray) else list(value)
