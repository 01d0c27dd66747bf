"""Structured Streaming forms of the ordered operators. State is per key and bounded."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioflow.arrow import _TYPES
from folioflow.operators.folds import KeepDistinctFrames, distinct_features
from folioflow.operators.windows import latest_fields
from folioflow.runs import Fold
from folioflow.ship import by_value

# Rows that one output batch of a key holds.
OUT_ROWS = 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def missing(value) -> bool:
    import pandas as pd

    return value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value)


class _FoldProcessor(StatefulProcessor):
    """Runs a fold over the rows of a key, carrying its state from batch to batch.

    Rows of one micro-batch arrive in any order. One chunk of them is sorted in memory; when a key has more
    than that in a micro-batch, its rows wait in map state and are taken from there one at a time, in order.
    """

    def __init__(self, fold: Fold, order: Sequence[str], order_types: str, columns: Sequence[str], names: Sequence[str]):
        self.fold, self.order, self.order_types, self.names = fold, list(order), order_types, list(names)
        # Chunks come with names of their own for columns that begin with an underscore.
        self.columns = list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "state binary")
        self.waiting = handle.getMapState("waiting", f"{self.order_types}, n bigint", "row binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        state = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else self.fold.start()
        held, count = next(rows), 0
        for chunk in rows:
            for part in (held, chunk) if held is not None else (chunk,):
                count = self._wait(part, count)
            held = None
        ordered = self._sorted(held) if held is not None else self._waiting()
        out = []
        for row in ordered:
            state, values = self.fold.step(state, *[row[c] for c in self.fold.columns])
            out.append((*[row[n] for n in self.names], *values))
            if len(out) >= OUT_ROWS:
                yield self._frame(out)
                out = []
        self.state.update((pickle.dumps(state),))
        if out:
            yield self._frame(out)

    def _rows(self, chunk) -> Iterator[dict]:
        for row in chunk.itertuples(index=False, name=None):
            yield {c: None if missing(v) else v for c, v in zip(self.columns, row)}

    def _sorted(self, chunk) -> Iterator[dict]:
        return self._rows(chunk.set_axis(self.columns, axis=1).sort_values(self.order, kind="stable"))

    def _wait(self, chunk, count: int) -> int:
        for count, row in enumerate(self._rows(chunk), count + 1):
            self.waiting.updateValue((*[row[o] for o in self.order], count), (pickle.dumps(row),))
        return count

    def _waiting(self) -> Iterator[dict]:
        for at in sorted(map(tuple, self.waiting.keys())):
            row = pickle.loads(bytes(self.waiting.getValue(at)[0]))
            self.waiting.removeKey(at)
            yield row

    def _frame(self, rows):
        import pandas as pd

        names = [*self.names, *[n for n, _ in self.fold.outputs]]
        return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    def close(self) -> None:
        pass


def stream_fold(stream: DataFrame, key: Sequence[str], order: Sequence[str], fold: Fold) -> DataFrame:
    """An ordered fold on a stream: the key's state lives in the state store between batches.

    Rows must arrive in order across batches; inside a batch they are sorted.
    """
    names = [f.name for f in stream.schema.fields if f.name not in fold.columns]
    fields = [stream.schema[n] for n in names]
    schema = T.StructType(fields + [T.StructField(n, _TYPES[t][0], True) for n, t in fold.outputs])
    order_types = ", ".join(f"{o} {stream.schema[o].dataType.simpleString()}" for o in order)
    with by_value():
        return stream.groupBy(*key).transformWithStateInPandas(
            statefulProcessor=_FoldProcessor(fold, order, order_types, stream.columns, names),
            outputStructType=schema,
            outputMode="Append",
            timeMode="None",
        )


def stream_dedupe(
    stream: DataFrame, key: Sequence[str], order: Sequence[str], *, layout: str = "full_scroll", level: str = "normal", **overrides
) -> DataFrame:
    """Kept frames of an unbounded frame stream (key, order, drop_reason null)."""
    rule = KeepDistinctFrames(layout, level, **overrides)
    features = distinct_features(stream, key, order, rule, keep_gray=True)
    return stream_fold(features, key, order, rule).filter("keep").drop("keep")


def stream_sample(
    stream: DataFrame, key: Sequence[str], *, ts: str = "ts", slot: str, delay: str, tie: Sequence[str] = ()
) -> DataFrame:
    """First row of every slot of event time, sent when the watermark has passed the slot."""
    key = list(key)
    payload = F.struct(*[c for c in stream.columns if c not in key])
    first = F.min_by(payload, F.struct(ts, *tie)).alias("_row")
    windows = stream.withWatermark(ts, delay).groupBy(*key, F.window(ts, slot).alias("_slot")).agg(first)
    return windows.select(*key, F.col("_slot.start").alias("slot_start"), F.col("_slot.end").alias("slot_end"), "_row.*")


def stream_debounce(
    stream: DataFrame, key: Sequence[str], *, ts: str = "ts", gap: str, delay: str, tie: str
) -> DataFrame:
    """Last request of every burst, sent when no newer one can come within ``gap``."""
    key = list(key)
    payload = F.struct(*[c for c in stream.columns if c not in key])
    last = F.max_by(payload, F.struct(ts, tie)).alias("_row")
    bursts = stream.withWatermark(ts, delay).groupBy(*key, F.session_window(ts, gap).alias("_burst"))
    return bursts.agg(last, F.count(F.lit(1)).alias("requests")).select(
        *key, F.col("_burst.start").alias("burst_start"), F.col("_burst.end").alias("burst_end"), "requests", "_row.*"
    )


def stream_current_jobs(stream: DataFrame, key: Sequence[str] = ("job_id",), *, fields: Sequence[str]) -> DataFrame:
    """The running job table: one updated row per job and batch (update mode)."""
    return stream.groupBy(*key).agg(*latest_fields(fields, F.struct("ts", "seq")), F.max("seq").alias("last_seq"))


def stream_transitions(stream: DataFrame, key: Sequence[str] = ("job_id",)) -> DataFrame:
    """(key, seq, status): the first final state of every job, exactly once (update mode).

    A job is sent by the micro-batch that first meets a final patch of it, and by no other: there the time of its first
    micro-batch and of its latest are the same. A repeated micro-batch has the time it had before.
    """
    key = list(key)
    ended = stream.filter(F.col("status").isin("done", "error")).withColumn("_now", F.current_timestamp())
    first = F.min_by(F.struct("seq", "status"), F.struct("ts", "seq")).alias("_row")
    rows = ended.groupBy(*key).agg(first, F.min("_now").alias("_since"), F.max("_now").alias("_latest"))
    return rows.filter("_since = _latest").select(*key, "_row.*")


def stream_recover(stream: DataFrame, key: Sequence[str] = ("job_id",), *, stale_after: str, delay: str) -> DataFrame:
    """Jobs whose newest patch is older than ``stale_after`` and was not final, marked as recovered errors."""
    key = list(key)
    quiet = stream.withWatermark("ts", delay).groupBy(*key, F.session_window("ts", stale_after).alias("_w"))
    last = quiet.agg(F.max_by("status", F.struct("ts", "seq")).alias("_status"), F.max("ts").alias("updated_at"))
    return last.filter(F.col("_status").isin("queued", "running")).select(
        *key,
        F.lit("error").alias("status"),
        F.lit("failed").alias("current_step"),
        F.lit("RECOVERED_AFTER_RESTART").alias("error_code"),
        "updated_at",
    )


def append_batches(path: str):
    """A foreachBatch sink: batch n always lands in its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_sink(stream: DataFrame, sink, *, mode: str, checkpoint: str) -> None:
    """Process everything there is through a foreachBatch sink, then stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer.foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()


def run_available(stream: DataFrame, path: str, *, mode: str, checkpoint: str) -> None:
    """Process everything there is into one folder per micro-batch, then stop."""
    run_sink(stream, append_batches(path), mode=mode, checkpoint=checkpoint)


def latest_batch_rows(rows: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The newest version of every key from update batches written by ``append_batches``."""
    newest = F.max_by(F.struct(*columns), F.col("batch")).alias("_row")
    return rows.groupBy(*key).agg(newest).select(*key, "_row.*")
