"""Review: the captures a person kept, exported again, and the jobs updated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import normalize_formats
from folioflow.operators import joins as J
from folioflow.plans.export import Export, export


def review(
    jobs: DataFrame, requests: DataFrame, captures: DataFrame, frames: DataFrame, *, mode: str = "performance"
) -> tuple[DataFrame, Export]:
    """(verdicts, export of the accepted reviews).

    ``jobs`` (job_id, status, reviewed, formats), ``requests`` (job_id, path, pos), ``captures``
    (job_id, path), ``frames`` (job_id, path, width, height, px). A refused job exports nothing.
    """
    kept, rejected, counts = J.select_captures(requests, captures, ["job_id"])
    verdicts = J.review_guard(jobs, counts, ["job_id"])
    bad = rejected.groupBy("job_id").agg(F.first("reason").alias("_bad"))
    verdicts = verdicts.join(bad, "job_id", "left").withColumn("reason", F.coalesce("reason", "_bad")).drop("_bad")
    accepted = verdicts.filter("reason is null").select("job_id")
    chosen = kept.join(accepted, "job_id", "left_semi")
    pixels = frames.join(chosen, ["job_id", "path"]).select("job_id", F.col("pos").alias("frame_index"), "width", "height", "px")
    runs = jobs.join(accepted, "job_id", "left_semi").select(
        "job_id", normalize_formats(F.col("formats")).alias("formats"), F.lit(False).alias("include_raw")
    )
    return verdicts, export(pixels, runs, ["job_id"], ["frame_index"], mode=mode, review=True)
