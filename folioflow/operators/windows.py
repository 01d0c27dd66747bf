"""Queues, tails and the current state of a job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.runs import Ordered, fits


def review_queue(
    captures: DataFrame, key: Sequence[str], *, idx: str = "idx", suspicious: str = "suspicious", n: int | None = None
) -> DataFrame:
    """Add ``rank`` (from 1): suspicious captures first, then the original order; at most ``n`` per key if given."""
    key = list(key)
    rows = captures.withColumn("_calm", F.when(F.coalesce(suspicious, F.lit(False)), 0).otherwise(1))
    if n is None:
        return Ordered(rows, key, ["_calm", idx]).position("rank", 1).result().drop("_calm")
    # A top-n per key is cut down in every task before the shuffle.
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_calm", idx))
    return rows.withColumn("rank", place).filter(F.col("rank") <= n).drop("_calm")


def log_tail(log: DataFrame, key: Sequence[str], *, seq: str = "seq", n: int = 20) -> DataFrame:
    """Last ``n`` lines per key with ``tail_pos`` from 1 (newest) on."""
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(seq)))
    return log.withColumn("tail_pos", newest).filter(F.col("tail_pos") <= n)


PATCH_FIELDS = ("progress", "current_step", "message", "result", "error_code")


def latest_fields(fields: Sequence[str], order: Column) -> list[Column]:
    """Aggregates that fold patches: status always, other fields only where given."""
    out = [F.max_by("status", order).alias("status"), F.max("ts").alias("updated_at")]
    for name in fields:
        value = F.col(name)
        if name == "progress":
            value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
        out.append(F.max_by(value, F.when(F.col(name).isNotNull(), order)).alias(name))
    return out


def current_jobs(patches: DataFrame, key: Sequence[str] = ("job_id",), *, fields: Sequence[str] | None = None) -> DataFrame:
    """One row per job: the fold of its patches in (ts, seq) order. One shuffle, combined before it."""
    fields = [f for f in (fields or PATCH_FIELDS) if f in patches.columns]
    return patches.groupBy(*key).agg(*latest_fields(fields, F.struct("ts", "seq")))


def recover_jobs(jobs: DataFrame, *, stale_before: Column | None = None) -> DataFrame:
    """After a restart: active jobs become errors. With ``stale_before`` only those not updated since then.

    Adds ``recovered_log``, the log line of a recovered job.
    """
    active = F.col("status").isin("queued", "running")
    if stale_before is not None:
        active = active & (F.col("updated_at") < stale_before)
    lost = jobs.withColumn("_lost", active)
    line = "job recovered after restart"

    def put(text, column):
        return F.when(F.col("_lost"), F.lit(text)).otherwise(F.col(column))

    return lost.withColumns(
        {
            "status": put("error", "status"),
            "current_step": put("failed", "current_step"),
            "message": put(line + "; rerun the capture", "message"),
            "error_code": put("RECOVERED_AFTER_RESTART", "error_code"),
            "recovered_log": F.when(F.col("_lost"), F.lit(line)),
        }
    ).drop("_lost")


def debounce_latest(df: DataFrame, key: Sequence[str], *, ts: str = "ts", tie: str, gap: Column) -> DataFrame:
    """Last request of each burst: a row counts only if none follows within ``gap``. Adds ``burst`` (from 0)."""
    small = fits(df, key)
    rows = Ordered(df, key, [ts, tie], small=small).neighbour("_next", F.col(ts), 1)
    last = F.col("_next").isNull() | (F.col("_next") >= F.col(ts) + gap)
    kept = rows.result().filter(last).drop("_next")
    return Ordered(kept, key, [ts, tie], small=small).position("burst").result()


def current_answers(
    requests: DataFrame, answers: DataFrame, key: Sequence[str], *, ts: str = "ts", tie: str, patience: Column | None = None
) -> DataFrame:
    """Answers (key, tie, asked_at, ts, ...) for which no newer request of the key existed when they came.

    ``requests`` (key, tie, ts). With ``patience`` answers that took longer are left out.
    """
    key = list(key)
    asked = requests.select(*key, tie, ts)
    following = Ordered(asked, key, [ts, tie]).neighbour("_next", F.col(ts), 1).result().drop(ts)
    out = answers.join(following, [*key, tie]).filter(F.col("_next").isNull() | (F.col("_next") > F.col(ts))).drop("_next")
    return out if patience is None else out.filter(F.col("asked_at") >= F.col(ts) - patience)
