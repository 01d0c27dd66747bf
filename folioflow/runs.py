"""Ordered work over keys of any size.

Positions, neighbours, running sums and greedy folds need the rows of a key in
order. When every key is small enough for one task (a count decides), a plain
window or a hash-partitioned pass is used. When some key is larger, the rows are
range-partitioned on (key, order), so that a key may span many partitions
("runs"), work is done inside runs, and only one row per run crosses a border.
Both ways give the same rows.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioflow.arrow import append_columns, appended_schema, column_values
from folioflow.session import stage

RUN = "_run"
RUN_ROWS_CONF = "spark.folioflow.runRows"
# Rows of one key that one task may walk: plain rows, and rows that carry pixels or vectors.
DEFAULT_RUN_ROWS = 1_000_000
DEFAULT_RUN_FRAMES = 20_000
# Bytes of gray pixels of one key that one task may walk.
RUN_BYTES = 1 << 30
# Border states that are moved at once; more of them go in several waves.
BORDER_BYTES = 64 * 1024 * 1024


def run_rows(df: DataFrame) -> int:
    heavy = any(isinstance(f.dataType, (T.BinaryType, T.ArrayType)) for f in df.schema.fields)
    default = DEFAULT_RUN_FRAMES if heavy else DEFAULT_RUN_ROWS
    return int(df.sparkSession.conf.get(RUN_ROWS_CONF, str(default)))


def _pack(value) -> bytes:
    """Border values cross the driver, so they are compressed (a frame shrinks about tenfold)."""
    return zlib.compress(pickle.dumps(value), 1)


def _unpack(data: bytes):
    return pickle.loads(zlib.decompress(data))


def group_sizes(df: DataFrame, key: Sequence[str]) -> tuple[int, int]:
    """(runs that all rows need, runs that the largest key needs), by rows and by gray bytes where frames have sizes.

    Counts are combined before the shuffle.
    """
    limit = run_rows(df)
    sides = next((s for s in (("gw", "gh"), ("width", "height")) if set(s) <= set(df.columns)), None)
    size = F.col(sides[0]).cast("bigint") * F.col(sides[1]) if sides else F.lit(0)
    row = (
        df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"))
        .agg(F.sum("n"), F.max("n"), F.sum("b"), F.max("b")).first()
    )
    rows, most, total, heavy = (int(v or 0) for v in row)
    return max(-(-rows // limit), -(-total // RUN_BYTES)), max(-(-most // limit), -(-heavy // RUN_BYTES))


def fits(df: DataFrame, key: Sequence[str]) -> bool:
    """Can one task walk the largest key? A yes also holds for rows derived by filtering or grouping."""
    return group_sizes(df, key)[1] <= 1


class Ordered:
    """A DataFrame with a partition key and a total order, laid out once for several steps.

    ``small``: the answer of ``fits`` for an input with at least as many rows per
    key, which saves counting again; when it is False the rows are counted.
    """

    def __init__(self, df: DataFrame, key: Sequence[str], order: Sequence[str], *, small: bool | None = None):
        self.key, self.order = list(key), list(order)
        self.split, self.df = False, df
        if not small:
            runs, largest = group_sizes(df, self.key)
            if largest > 1:
                self.split, self.df = True, split_runs(df, self.key, self.order, runs)

    def _window(self):
        parts = [RUN] + self.key if self.split else self.key
        return Window.partitionBy(*parts).orderBy(*self.order)

    def neighbour(self, name: str, value: Column, offset: int = -1) -> "Ordered":
        """Add the value of the row just before (-1) or just after (+1); null at the ends."""
        value = F.struct(value.alias("v"))
        window = self._window()
        near = F.lag(value).over(window) if offset < 0 else F.lead(value).over(window)
        if not self.split:
            self.df = self.df.withColumn(name, near["v"])
            return self
        order = F.struct(*self.order)
        edge = (F.max_by if offset < 0 else F.min_by)(value, order)
        edges = self.df.groupBy(RUN, *self.key).agg(edge.alias("_edge"))
        beside = Window.partitionBy(*self.key).orderBy(RUN)
        step = F.lag("_edge") if offset < 0 else F.lead("_edge")
        edges = edges.select(RUN, *self.key, step.over(beside).alias("_edge"))
        self.df = (
            self.df.withColumn("_near", near)
            .join(edges, [RUN, *self.key], "left")
            .withColumn(name, F.coalesce(F.col("_near"), F.col("_edge"))["v"])
            .drop("_near", "_edge")
        )
        return self

    def running(self, name: str, value: Column) -> "Ordered":
        """Add the sum of ``value`` from the first row of the key to this row."""
        total = F.sum(value).over(self._window().rowsBetween(Window.unboundedPreceding, 0))
        if not self.split:
            self.df = self.df.withColumn(name, total)
            return self
        sums = self.df.groupBy(RUN, *self.key).agg(F.sum(value).alias("_sum"))
        before = Window.partitionBy(*self.key).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(RUN, *self.key, F.sum("_sum").over(before).alias("_before"))
        self.df = (
            self.df.withColumn(name, total)
            .join(sums, [RUN, *self.key], "left")
            .withColumn(name, F.col(name) + F.coalesce(F.col("_before"), F.lit(0)))
            .drop("_before")
        )
        return self

    def position(self, name: str, start: int = 0) -> "Ordered":
        """Add the 0-based position of the row inside its key."""
        if not self.split:
            self.df = self.df.withColumn(name, F.row_number().over(self._window()) - 1 + start)
            return self
        self.running(name, F.lit(1))
        self.df = self.df.withColumn(name, (F.col(name) - 1 + start).cast("int"))
        return self

    def result(self) -> DataFrame:
        return self.df.drop(RUN)


def split_runs(df: DataFrame, key, order, runs: int) -> DataFrame:
    """Range-partition on (key, order) and stage, so the borders stay put in later passes."""
    return stage(
        df.repartitionByRange(max(2, runs), *key, *order)
        .sortWithinPartitions(*key, *order)
        .withColumn(RUN, F.spark_partition_id())
    )


class Fold:
    """A sequential rule over the ordered rows of a key.

    ``step(state, *columns)`` returns the next state and one output tuple for the
    row. The state must be picklable, must not count rows, and is what crosses a
    run border; equal states must pickle to equal bytes.
    """

    columns: Sequence[str] = ()
    outputs: Sequence[tuple[str, str]] = ()
    # With ``arrays`` columns come as numpy arrays, nulls as NaN, and ``walk`` is the fold's own.
    arrays = False

    def start(self):
        return None

    def step(self, state, *row):
        if not self.arrays:
            raise NotImplementedError
        state, values = self.walk(state, [np.array([np.nan if v is None else v]) for v in row])
        return state, tuple(v[0] for v in values)

    def walk(self, state, columns: Sequence) -> tuple[object, list[Sequence]]:
        """(next state, one sequence per output) for consecutive rows of a key; a fold may go from decision to decision."""
        out = []
        for row in zip(*columns):
            state, values = self.step(state, *row)
            out.append(values)
        return state, list(zip(*out))


def _key_starts(batch: pa.RecordBatch, key) -> list[int]:
    """Rows of a batch at which another key begins; the first row always."""
    fresh = np.zeros(batch.num_rows, dtype=bool)
    fresh[:1] = True
    for k in key:
        codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        fresh[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(fresh).tolist()


def _walk(batches, key, fold: Fold, entry):
    """Yield (batch, one list per output) and finally (None, summary of the partition)."""
    first = last = state = None
    for batch in batches:
        if fold.arrays:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in fold.columns]
        else:
            columns = [column_values(batch.column(c)) for c in fold.columns]
        starts, out = _key_starts(batch, key), [[] for _ in fold.outputs]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            at = tuple(batch.column(k)[a].as_py() for k in key)
            if at != last:
                state = entry if first is None and entry is not None else fold.start()
                first = at if first is None else first
                last = at
            state, values = fold.walk(state, [c[a:b] for c in columns])
            for held, new in zip(out, values):
                held.extend(new)
        yield batch, out
    yield None, (first, last, state)


def ordered_fold(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    fold: Fold,
    *,
    small: bool | None = None,
) -> DataFrame:
    """Append the fold's outputs to every row.

    Small keys: one shuffle on the key, sort inside partitions, one pass with one
    state. A key above the limit: each run is folded from a fresh state, then
    every run whose true entry state (the exit of the run before) differs from
    the one it used is folded again, until nothing changes. Greedy
    last-kept rules fall back into step within a few rows, so two or three
    rounds are usual. Every round makes at least the first stale run final, so
    it ends; only stale runs are read again.
    """
    key, order = list(key), list(order)
    if not small:
        runs, largest = group_sizes(df, key)
        if largest > 1:
            return _fold_runs(split_runs(df, key, order, runs), key, fold).drop(RUN)
    outputs = list(fold.outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in _walk(batches, key, fold, None):
            if batch is not None:
                yield append_columns(batch, outputs, out)

    ready = df.repartition(*key).sortWithinPartitions(*key, *order)
    return ready.mapInArrow(run, appended_schema(df, outputs))


class _Borders:
    """What is known of the runs: first and last key, digest and size of the exit state, and where that state is staged."""

    def __init__(self):
        self.known: dict[int, tuple] = {}

    def learn(self, summary: DataFrame) -> None:
        rows = summary.select("run", "first", "last", F.sha2("state", 256).alias("digest"), F.length("state").alias("size")).collect()
        for r in rows:  # one short row per run
            self.known[r.run] = (bytes(r.first), bytes(r.last), r.digest, r.size, summary)

    def before(self) -> dict[int, int]:
        """{run: the run before it} where both hold the same key at their border."""
        order = sorted(self.known)
        return {b: a for a, b in zip(order, order[1:]) if self.known[a][1] == self.known[b][0]}

    def waves(self, runs: Sequence[int], before: dict[int, int]) -> Iterator[list[int]]:
        """Runs in order, as many at once as their entry states fit into BORDER_BYTES, at least one."""
        wave, filled = [], 0
        for run in runs:
            size = self.known[before[run]][3] if run in before else 0
            if wave and filled + size > BORDER_BYTES:
                yield wave
                wave, filled = [], 0
            wave.append(run)
            filled += size
        yield wave

    def entries(self, wave: Sequence[int], before: dict[int, int]) -> dict[int, bytes]:
        """The entry states of a wave, read from the staged summaries."""
        by_table: dict[int, tuple[DataFrame, list[int]]] = {}
        for run in wave:
            if run in before:
                table = self.known[before[run]][4]
                by_table.setdefault(id(table), (table, []))[1].append(before[run])
        states = {}
        for table, runs in by_table.values():
            for r in table.filter(F.col("run").isin(runs)).select("run", "state").collect():
                states[r.run] = bytes(r.state)
        return {run: states[before[run]] for run in wave if run in before}


def _fold_runs(runs: DataFrame, key, fold: Fold) -> DataFrame:
    context, borders, used = runs.sparkSession.sparkContext, _Borders(), {}
    schema = "run int, first binary, last binary, state binary"
    todo, entries = None, {}
    while True:
        borders.learn(stage(runs.mapInArrow(_summarise(key, fold, context.broadcast(entries), todo), schema)))
        before = borders.before()
        stale = [run for run in sorted(before) if used.get(run) != borders.known[before[run]][2]]
        if not stale:
            break
        todo = set(next(borders.waves(stale, before)))
        entries = borders.entries(sorted(todo), before)
        used.update({run: borders.known[before[run]][2] for run in todo})
    out = None
    for wave in borders.waves(sorted(borders.known), before):
        shared = context.broadcast(borders.entries(wave, before))
        part = runs.mapInArrow(_emit(key, fold, shared, set(wave)), appended_schema(runs, list(fold.outputs)))
        out = part if out is None else out.unionByName(part)
    return out


def _entry(batches, entries):
    """The run number of this partition, its entry state and the batches again."""
    for batch in batches:
        if batch.num_rows:
            number = batch.column(RUN)[0].as_py()
            state = _unpack(entries.value[number]) if number in entries.value else None

            def again(head=batch):
                yield head
                yield from batches

            return number, state, again()
    return None, None, iter(())


def _summarise(key, fold, entries, todo):
    def run(batches):
        number, state, rest = _entry(batches, entries)
        if number is None or (todo is not None and number not in todo):
            return
        for batch, out in _walk(rest, key, fold, state):
            if batch is None:
                first, last, end = (_pack(v) for v in out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int32())] + [pa.array([v], pa.binary()) for v in (first, last, end)],
                    names=["run", "first", "last", "state"],
                )

    return run


def _emit(key, fold, entries, wave):
    outputs = list(fold.outputs)

    def run(batches):
        number, state, rest = _entry(batches, entries)
        if number not in wave:
            return
        for batch, out in _walk(rest, key, fold, state):
            if batch is not None:
                yield append_columns(batch, outputs, out)

    return run
