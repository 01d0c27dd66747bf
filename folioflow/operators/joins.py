"""Joins: regions onto frames, seeks onto frames, reviews and crops onto captures.

Sides that come from data carry no broadcast hint: Spark broadcasts them only
below its size threshold and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as C
from folioflow.functions.geometry import crop_box, order_roi_points
from folioflow.operators.aggregates import nearest_to_mean


def attach_roi(frames: DataFrame, rois: DataFrame, key: Sequence[str], *, manual: Column | None = None) -> DataFrame:
    """Add the ordered region of the source and ``score`` 1.0; frames without one take the manual region."""
    joined = frames.join(rois.select(*key, "roi"), list(key), "left")
    roi = F.coalesce("roi", manual) if manual is not None else F.col("roi")
    return joined.withColumn("roi", roi).withColumns(
        {"roi": F.when(F.col("roi").isNotNull(), order_roi_points(F.col("roi"))), "score": F.lit(1.0)}
    )


def seek_candidates(sec: Column) -> Column:
    """Seek times to try in order: forward offsets, then back from 1.5 s on, two decimals, no repeats."""
    base = F.greatest(F.lit(0.0), F.coalesce(sec, F.lit(0.0)))
    forward = F.array(*[F.bround(base + o, 2) for o in C.SEEK_OFFSETS])
    back = F.array(*[F.bround(F.greatest(F.lit(0.0), base + o), 2) for o in C.SEEK_BACK])
    return F.array_distinct(F.when(base >= C.SEEK_BACK_FROM, F.concat(forward, back)).otherwise(forward))


def seek_first_available(
    requests: DataFrame,
    frames: DataFrame,
    key: Sequence[str],
    request: str,
    *,
    sec: str = "sec",
    ts: str = "ts_sec",
    frame: str = "frame_id",
    tol: float = 0.5,
    vector: str | None = None,
) -> DataFrame:
    """(key, request, sec, seek_rank, seek_sec, frame): the first candidate time with a frame in [t, t + tol].

    Candidates and frames meet on (key, time bucket). With ``vector`` a request
    without any hit takes the representative of the first frames in the next 12 seconds (rank null).
    """
    key = list(key)
    tries = requests.select(*key, request, sec, F.posexplode(seek_candidates(F.col(sec))).alias("seek_rank", "seek_sec"))
    # Division keeps order, so every time in [t, t + tol] falls into one of these buckets.
    first, last = F.floor(F.col("seek_sec") / tol), F.floor((F.col("seek_sec") + tol) / tol)
    tries = tries.withColumn("_bucket", F.explode(F.sequence(first, last)))
    # Frames at one instant are interchangeable: keep the first of each.
    instants = frames.groupBy(*key, ts).agg(F.min(frame).alias(frame))
    instants = instants.withColumn("_bucket", F.floor(F.col(ts) / tol))
    hits = tries.join(instants, [*key, "_bucket"]).filter(
        (F.col(ts) >= F.col("seek_sec")) & (F.col(ts) <= F.col("seek_sec") + tol)
    )
    best = hits.groupBy(*key, request).agg(
        F.min_by(F.struct("seek_rank", "seek_sec", frame), F.struct("seek_rank", ts, frame)).alias("_hit")
    )
    out = requests.select(*key, request, sec).join(best, [*key, request], "left")
    found = out.select(*key, request, sec, "_hit.seek_rank", "_hit.seek_sec", F.col("_hit")[frame].alias(frame))
    if vector is None:
        return found
    missing = found.filter(F.col(frame).isNull()).select(*key, request, sec)
    window = F.lit(C.SEEK_WINDOW)
    spans = missing.withColumn("_start", F.greatest(F.lit(0.0), F.col(sec)))
    first, last = F.floor(F.col("_start") / window), F.floor((F.col("_start") + window) / window)
    spans = spans.withColumn("_bucket", F.explode(F.sequence(first, last)))
    near = spans.join(
        frames.select(*key, ts, frame, vector).withColumn("_bucket", F.floor(F.col(ts) / window)), [*key, "_bucket"]
    ).filter((F.col(ts) >= F.col("_start")) & (F.col(ts) < F.col("_start") + window))
    typical = nearest_to_mean(near, [*key, request], [ts, frame], vector, first=C.THUMBNAIL_BATCH)
    spare = typical.select(*key, request, F.col(frame).alias("_spare"))
    return (
        found.join(spare, [*key, request], "left")
        .withColumn(frame, F.coalesce(frame, "_spare"))
        .drop("_spare")
    )


def select_captures(
    requests: DataFrame, captures: DataFrame, key: Sequence[str], *, path: str = "path", order: str = "pos"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, rejected, counts) of ordered keep-lists: first occurrences that are selectable captures."""
    key = list(key)
    clean = requests.withColumn(path, F.trim(path)).filter(F.col(path) != "")
    firsts = clean.groupBy(*key, path).agg(F.min(order).alias(order))
    selectable = captures.select(*key, path).distinct()
    kept = firsts.join(selectable, [*key, path], "left_semi")
    rejected = firsts.join(selectable, [*key, path], "left_anti").withColumn(
        "reason", F.lit("capture is not selectable for this job")
    )
    asked = clean.groupBy(*key).agg(F.count(F.lit(1)).alias("requested_count"))
    counts = asked.join(kept.groupBy(*key).agg(F.count(F.lit(1)).alias("kept_count")), key, "left")
    return kept, rejected, counts.withColumn("kept_count", F.coalesce("kept_count", F.lit(0)))


def review_guard(jobs: DataFrame, counts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add ``reason`` why a review of a job is refused; null when it can be applied."""
    reason = (
        F.when(F.col("status").isin("queued", "running"), F.lit("job is still running"))
        .when(F.col("reviewed"), F.lit("review export is already applied"))
        .when(F.coalesce("requested_count", F.lit(0)) == 0, F.lit("keep_captures must include at least one capture"))
        .when(F.col("kept_count") == 0, F.lit("no valid captures selected"))
    )
    return jobs.join(counts, list(key), "left").withColumn("reason", reason)


def attach_diagnostics(captures: DataFrame, diagnostics: DataFrame, key: Sequence[str], *, idx: str = "idx") -> DataFrame:
    """Pair captures with diagnostics by position, only for keys where both sides have equally many."""
    key = list(key)
    count = F.count(F.lit(1))
    have = captures.groupBy(*key).agg(count.alias("_captures"))
    found = diagnostics.groupBy(*key).agg(count.alias("_found"))
    equal = have.join(found, key).filter("_captures = _found").select(*key)
    usable = diagnostics.join(equal, key, "left_semi")
    return captures.join(usable, [*key, idx], "left")


def apply_crops(
    crops: DataFrame,
    captures: DataFrame,
    jobs: DataFrame,
    key: Sequence[str],
    *,
    path: str = "path",
    roles: Sequence[str] = ("review_candidates", "upscaled_frames", "images"),
) -> DataFrame:
    """Outcome of each crop request: new size, or the reason of refusal.

    ``crops`` (key, path, roi), ``captures`` (key, path, role, width, height), ``jobs`` (key, status, reviewed).
    """
    key = list(key)
    rank = F.array_position(F.array(*[F.lit(r) for r in roles]), F.col("role"))
    ranked = captures.filter(F.col("role").isin(*roles)).withColumn("_rank", rank)
    best = ranked.groupBy(*key).agg(F.min("_rank").alias("_rank"))
    selectable = ranked.join(best, [*key, "_rank"], "left_semi").select(*key, path).distinct().withColumn("_ok", F.lit(True))
    facts = captures.groupBy(*key, path).agg(
        F.max("width").alias("width"),
        F.max("height").alias("height"),
        F.bool_or(F.col("role").isin("preview_images", "images")).alias("_final"),
    )
    rows = (
        crops.join(jobs.select(*key, "status", "reviewed"), key, "left")
        .join(facts, [*key, path], "left")
        .join(selectable, [*key, path], "left")
        .join(best.select(*key, F.lit(True).alias("_any")), key, "left")
        .withColumn("_box", crop_box(F.col("roi"), F.col("width"), F.col("height")))
    )
    reason = (
        F.when(F.col("status").isNull(), F.lit("job not found"))
        .when(F.col("status").isin("queued", "running"), F.lit("job is still running"))
        .when(F.col("width").isNull(), F.lit("capture file not found"))
        .when(F.coalesce("_any", F.lit(False)) & F.col("_ok").isNull(), F.lit("capture is not selectable for this job"))
        .when(F.col("reviewed") & F.col("_final"), F.lit("capture crop is unavailable after review export"))
        .otherwise(F.col("_box.reason"))
    )
    return rows.withColumn("reason", reason).select(
        *key,
        path,
        F.when(F.col("reason").isNull(), F.col("_box.x2") - F.col("_box.x1")).alias("new_width"),
        F.when(F.col("reason").isNull(), F.col("_box.y2") - F.col("_box.y1")).alias("new_height"),
        "reason",
    )
