"""Streaming operators: run over all available rows, written out and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from folioflow import fixtures as X
from folioflow.catalog.base import ORACLES, query
from folioflow.catalog.frames import KEY, ORDER
from folioflow.operators import windows as W
from folioflow.session import scratch_path
from folioflow.streaming import ordered as O
from folioflow.streaming import streams as T

SG = X.SIGNAL_SQL


# Micro-batches of a feed, whatever its size; a larger table has more files in each, of about so many rows.
BATCHES = 4
FILE_ROWS = 250_000
FEED_FILES = 4


def _feed(spark, df, name, order, closing=None):
    """Write a table as micro-batches, oldest rows first, and open a stream that takes one micro-batch at a time.

    A micro-batch is a range of the order, dealt over files by as many tasks. Their number is fixed: each one loads and commits
    the state of every key it meets, so more of them for more rows would cost the square of the rows. They are
    written one after the other, so the source finds them in order; ``closing`` rows come in the last file, so nothing is late to them.
    """
    path, ranges = scratch_path(spark, name), scratch_path(spark, name + "-ranges")
    files = max(FEED_FILES, -(-df.count() // (BATCHES * FILE_ROWS)))
    # Written by range: each micro-batch reads its own ranges only.
    dealt = df.repartitionByRange(BATCHES * files, *order).withColumn("_part", F.spark_partition_id())
    dealt.write.partitionBy("_part").parquet(ranges)
    dealt = spark.read.schema(StructType([*df.schema.fields, StructField("_part", IntegerType())])).parquet(ranges)
    parts = dealt.agg(F.max("_part")).first()[0] + 1
    for batch in range(BATCHES):
        own = dealt.filter((F.col("_part") >= batch * parts // BATCHES) & (F.col("_part") < (batch + 1) * parts // BATCHES))
        own.drop("_part").repartition(files).write.mode("append").parquet(path)
    if closing is not None:
        closing.select(*df.columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", str(files)).parquet(path)


def _closing(df, key, ts="ts", **values):
    """One row of a key that does not occur, so late that the watermark passes all others."""
    end = df.agg((F.max(ts) + F.expr("interval 400 days")).alias(ts))
    own = {key: F.lit(-1), ts: F.col(ts)} | values
    return end.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields])


def _finish(spark, stream, name, mode="append"):
    path = scratch_path(spark, name)
    T.run_available(stream, path, mode=mode, checkpoint=scratch_path(spark, name + "-checkpoint"))
    return spark.read.parquet(path)


@query("t1_stream_dedupe", ORACLES["q1_dedupe_frames"])
def t1(spark, d):
    T.use_rocksdb(spark)
    frames = X.micro_frames(spark, d).select(*KEY, *ORDER, "px", "width", "height")
    stream = _feed(spark, frames, "frames", ORDER)
    out = T.stream_dedupe(stream, KEY, ORDER, layout="full_scroll", static=0.20, structure=0.0, min_side=0, blur=False)
    return _finish(spark, out, "t1").select(*KEY, *ORDER)


@query("t1_stream_reordered", ORACLES["q1_dedupe_frames"])
def t1b(spark, d):
    """Frames that arrive up to six seconds late, over several micro-batches; the last one's watermark releases the rest."""
    T.use_rocksdb(spark)
    frames = X.micro_frames(spark, d).withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000) + F.col("frame_index"))).select(*KEY, "ts", *ORDER, "px", "width", "height")
    late = F.pmod(F.xxhash64(*KEY, *ORDER), F.lit(7))
    end = _closing(frames, "source_id", frame_index=F.lit(0))
    stream = _feed(spark, frames, "late-frames", [F.unix_seconds("ts") + late, *KEY], end)
    out = O.stream_dedupe_ordered(stream, KEY, ORDER, delay="10 seconds", layout="full_scroll", static=0.20, structure=0.0, min_side=0, blur=False)
    return _finish(spark, out, "t1-late").filter("source_id >= 0").select(*KEY, *ORDER)


@query(
    "t2_stream_sample",
    f"""WITH {SG}, a AS (SELECT source_id, epoch_us(ts) AS us, event_id FROM sg), m AS (SELECT max(us) // 1000 * 1000 - 3600000000 AS wm FROM a),
s AS (SELECT source_id, us // 21600000000 * 21600000000 AS slot, arg_min(event_id, ROW(us, event_id)) AS event_id, min(us) AS first_us FROM a GROUP BY ALL)
SELECT source_id, slot AS slot_start, event_id, first_us FROM s, m WHERE slot + 21600000000 <= wm""",
)
def t2(spark, d):
    T.use_rocksdb(spark)
    rows = X.signal(spark, d).select("source_id", "ts", "event_id")
    out = T.stream_sample(_feed(spark, rows, "signal", ["ts", "event_id"]), ["source_id"], slot="6 hours", delay="1 hour", tie=["event_id"])
    back = _finish(spark, out, "t2")
    return back.select("source_id", F.unix_micros("slot_start").alias("slot_start"), "event_id", F.unix_micros("ts").alias("first_us"))


BURST = """b AS (SELECT source_id, ts, event_id, lead(ts) OVER (PARTITION BY source_id ORDER BY ts, event_id) AS nxt FROM sg)"""


@query(
    "t3_debounce_latest",
    f"""WITH {SG}, {BURST}, k AS (SELECT source_id, ts, event_id FROM b WHERE nxt IS NULL OR nxt >= ts + INTERVAL 6 HOUR)
SELECT source_id, event_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY ts, event_id) - 1 AS INTEGER) AS burst FROM k""",
)
def t3(spark, d):
    rows = X.signal(spark, d).select("source_id", "ts", "event_id")
    gap = F.expr("interval 6 hours")
    return W.debounce_latest(rows, ["source_id"], tie="event_id", gap=gap).select("source_id", "event_id", "burst")


@query(
    "t3_stream_debounce",
    f"""WITH {SG}, {BURST}, m AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 AS wm FROM sg)
SELECT source_id, event_id, epoch_us(ts) AS last_us FROM b, m WHERE (nxt IS NULL OR nxt >= ts + INTERVAL 6 HOUR) AND epoch_us(ts) + 21600000000 <= wm""",
)
def t3b(spark, d):
    T.use_rocksdb(spark)
    rows = X.signal(spark, d).select("source_id", "ts", "event_id")
    out = T.stream_debounce(_feed(spark, rows, "requests", ["ts", "event_id"]), ["source_id"], gap="6 hours", delay="1 hour", tie="event_id")
    return _finish(spark, out, "t3").select("source_id", "event_id", F.unix_micros("ts").alias("last_us"))


_ANSWERS_SQL = f"""WITH {SG}, r AS (SELECT source_id, event_id, ts AS asked_at, ts + to_hours(CAST(3 * (event_id % 9) AS BIGINT)) AS ts, lead(ts) OVER (PARTITION BY source_id ORDER BY ts, event_id) AS nxt FROM sg)
SELECT source_id, event_id, epoch_us(asked_at) AS asked_us, epoch_us(ts) AS answered_us FROM r WHERE nxt IS NULL OR nxt > ts"""


def _answers(spark, d):
    """(requests, answers): each request is answered after up to 24 hours, so answers overtake each other and newer requests."""
    requests = X.signal(spark, d).select("source_id", "ts", "event_id")
    took = F.make_dt_interval(hours=(3 * F.pmod("event_id", F.lit(9))).cast("int"))
    return requests, requests.select("source_id", "event_id", F.col("ts").alias("asked_at"), (F.col("ts") + took).alias("ts"))


def _micros(rows):
    return rows.select("source_id", "event_id", F.unix_micros("asked_at").alias("asked_us"), F.unix_micros("ts").alias("answered_us"))


@query("t3_current_answers", _ANSWERS_SQL)
def t3c(spark, d):
    requests, answers = _answers(spark, d)
    return _micros(W.current_answers(requests, answers, ["source_id"], tie="event_id"))


@query("t3_stream_answers", _ANSWERS_SQL)
def t3d(spark, d):
    """Both streams over several micro-batches, their rows up to 50 minutes late."""
    T.use_rocksdb(spark)
    requests, answers = _answers(spark, d)
    late = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(3000))
    asked = _feed(spark, requests, "asked", [late, "source_id"], _closing(requests, "source_id"))
    given = _feed(spark, answers, "answered", [late, "source_id"], _closing(answers, "source_id", asked_at=F.col("ts")))
    out = O.stream_answers(asked, given, ["source_id"], tie="event_id", delay="1 hour", patience="30 hours")
    return _micros(_finish(spark, out, "t3-answers").filter("source_id >= 0"))


_FIELDS = ("progress", "current_step", "message", "error_code")


@query("t4_stream_current_jobs", ORACLES["w7_current_jobs"])
def t4(spark, d):
    T.use_rocksdb(spark)
    stream = _feed(spark, X.job_patches(spark, d), "patches", ["ts", "seq"])
    back = _finish(spark, T.stream_current_jobs(stream, fields=_FIELDS), "t4", mode="update")
    out = T.latest_batch_rows(back, ["job_id"], ["status", "updated_at", *_FIELDS])
    return out.withColumn("updated_at", F.unix_micros("updated_at"))


@query(
    "t4_stream_transitions",
    f"""WITH {X.JOB_PATCHES_SQL} SELECT job_id, min(seq) AS seq, arg_min(status, seq) AS status FROM (SELECT job_id, seq, status, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS n FROM jp WHERE status IN ('done','error')) WHERE n = 1 GROUP BY job_id""",
)
def t4b(spark, d):
    T.use_rocksdb(spark)
    stream = _feed(spark, X.job_patches(spark, d), "patches", ["ts", "seq"])
    return _finish(spark, T.stream_transitions(stream), "t4-final", mode="update").select("job_id", "seq", "status")


@query(
    "t5_stream_recover",
    f"""WITH {X.JOB_PATCHES_SQL}, b AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, seq) AS nxt FROM jp), m AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 AS wm FROM jp)
SELECT job_id, epoch_us(ts) AS updated_us, 'error' AS status, 'RECOVERED_AFTER_RESTART' AS error_code FROM b, m
WHERE (nxt IS NULL OR nxt >= ts + INTERVAL 24 HOUR) AND status IN ('queued','running') AND epoch_us(ts) + 86400000000 <= wm""",
)
def t5b(spark, d):
    T.use_rocksdb(spark)
    out = T.stream_recover(_feed(spark, X.job_patches(spark, d), "patches", ["ts", "seq"]), stale_after="24 hours", delay="1 hour")
    back = _finish(spark, out, "t5")
    return back.select("job_id", F.unix_micros("updated_at").alias("updated_us"), "status", "error_code")


@query(
    "t4_transitions_expiring",
    f"""WITH {X.JOB_PATCHES_SQL}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts, seq) < INTERVAL 48 HOUR THEN 0 ELSE 1 END AS fresh FROM jp),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts, seq) AS run FROM g),
f AS (SELECT job_id, seq, status, row_number() OVER (PARTITION BY job_id, run ORDER BY ts, seq) AS n FROM r WHERE status IN ('done', 'error'))
SELECT job_id, seq, status FROM f WHERE n = 1""",
)
def t4c(spark, d):
    """A job that had no patch for two days has left the state and starts anew."""
    T.use_rocksdb(spark)
    late = F.unix_seconds("ts") + F.pmod(F.xxhash64("seq"), F.lit(3000))
    patches = X.job_patches(spark, d).select("job_id", "ts", "seq", "status")
    stream = _feed(spark, patches, "late-patches", [late, "job_id"], _closing(patches, "job_id", seq=F.lit(0)))
    out = O.stream_transitions_expiring(stream, forget_ms=48 * 3_600_000, delay="1 hour")
    return _finish(spark, out, "t4-expiring").filter("job_id >= 0").select("job_id", "seq", "status")


@query(
    "t5_timer_recover",
    f"""WITH {X.JOB_PATCHES_SQL}, b AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, seq) AS nxt FROM jp)
SELECT job_id, epoch_us(ts) AS updated_us, 'error' AS status, 'RECOVERED_AFTER_RESTART' AS error_code FROM b
WHERE (nxt IS NULL OR nxt >= ts + INTERVAL 24 HOUR) AND status IN ('queued','running')""",
)
def t5c(spark, d):
    """Patches up to 50 minutes late; every quiet job is recovered by its timer."""
    T.use_rocksdb(spark)
    late = F.unix_seconds("ts") + F.pmod(F.xxhash64("seq"), F.lit(3000))
    patches = X.job_patches(spark, d).select("job_id", "ts", "seq", "status")
    stream = _feed(spark, patches, "late-patches", [late, "job_id"], _closing(patches, "job_id", seq=F.lit(0)))
    out = O.stream_recover_by_timer(stream, stale_ms=24 * 3_600_000, delay="1 hour")
    back = _finish(spark, out, "t5-timer").filter("job_id >= 0")
    return back.select("job_id", F.unix_micros("updated_at").alias("updated_us"), "status", "error_code")
