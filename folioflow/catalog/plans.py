"""Whole plans as queries: capture jobs with options of their own, and what becomes of failed ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.catalog.base import query
from folioflow.catalog.frames import MF, TOTAL, _full_rule_sql, big_frames
from folioflow.plans import jobs as J

# Options of a source by its number: layout, level, rate and range differ; some are broken, some take no frame, some cannot be read.
_OPTIONS = """op AS (SELECT DISTINCT source_id, ['bottom_bar', 'page_turn', 'full_scroll'][source_id % 3 + 1] AS layout, CASE WHEN source_id % 2 = 0 THEN 'normal' ELSE 'aggressive' END AS level,
  CASE WHEN source_id % 4 = 1 THEN 0.8::DOUBLE ELSE 2.0::DOUBLE END AS fps, CASE WHEN source_id % 5 = 4 THEN 2.0::DOUBLE END AS start_sec,
  CASE WHEN source_id % 8 = 5 THEN 20.0::DOUBLE END AS end_sec, source_id % 9 = 7 AS broken FROM mf),
taken AS (SELECT source_id, frame_index, px, layout, level FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, floor((ts - t0) * fps) ORDER BY ts, frame_index) AS nth
  FROM (SELECT mf.*, layout, level, fps, frame_index * 0.5::DOUBLE AS ts, min(frame_index * 0.5::DOUBLE) OVER (PARTITION BY mf.source_id) AS t0
    FROM mf JOIN op USING (source_id) WHERE NOT broken AND coalesce(frame_index * 0.5::DOUBLE >= start_sec, true) AND coalesce(frame_index * 0.5::DOUBLE < end_sec, true)) AS a) AS b WHERE nth = 1)"""
_RULE = """layout, CASE layout WHEN 'bottom_bar' THEN CASE level WHEN 'normal' THEN 0.028 ELSE 0.045 END WHEN 'page_turn' THEN CASE level WHEN 'normal' THEN 0.008 ELSE 0.012 END
    ELSE CASE level WHEN 'normal' THEN 0.018 ELSE 0.026 END END AS st,
  CASE layout WHEN 'bottom_bar' THEN CASE level WHEN 'normal' THEN 0.062 ELSE 0.085 END WHEN 'page_turn' THEN CASE level WHEN 'normal' THEN 0.024 ELSE 0.032 END
    ELSE CASE level WHEN 'normal' THEN 0.038 ELSE 0.052 END END AS sr,
  CASE level WHEN 'normal' THEN 0.14 ELSE 0.22 END AS pl, CASE layout WHEN 'bottom_bar' THEN CASE level WHEN 'normal' THEN 6 ELSE 8 END ELSE CASE level WHEN 'normal' THEN 2 ELSE 3 END END AS hd"""


def _job_options(frames):
    k = F.col("source_id")
    return frames.select("source_id").distinct().select(
        "source_id",
        F.element_at(F.array(F.lit("bottom_bar"), F.lit("page_turn"), F.lit("full_scroll")), F.pmod(k, F.lit(3)) + 1).alias("layout_hint"),
        F.when(k % 2 == 0, "normal").otherwise("aggressive").alias("dedupe_level"),
        F.when(k % 4 == 1, 0.8).otherwise(2.0).alias("fps"),
        F.when(k % 5 == 4, 2.0).alias("start_sec"),
        F.when(k % 8 == 5, 20.0).alias("end_sec"),
        F.when(k % 9 == 7, 1.5).when(k % 3 == 1, 0.4).alias("overlap_threshold"),
    )


@query(
    "plan_capture_options",
    f"""WITH RECURSIVE {MF}, {_OPTIONS}, tk AS (SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY frame_index) - 1 AS INTEGER) AS frame_index, frame_index AS own, px, layout, level FROM taken),
{_full_rule_sql("tk", _RULE)},
kp AS (SELECT tk.source_id, tk.own, tk.px, tk.layout, CAST(row_number() OVER (PARTITION BY tk.source_id ORDER BY tk.own) - 1 AS INTEGER) AS n FROM walk JOIN tk USING (source_id, frame_index) WHERE drop_reason IS NULL),
turn AS (
  SELECT source_id, own, n, px, true AS fresh FROM kp WHERE layout = 'page_turn' AND n = 0
  UNION ALL
  SELECT k.source_id, k.own, k.n, CASE WHEN x.same THEN t.px ELSE k.px END, NOT x.same
  FROM turn t JOIN kp k ON k.source_id = t.source_id AND k.n = t.n + 1, LATERAL (SELECT greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - {TOTAL.format(a="t.px", b="k.px")} / 64.0::DOUBLE / 255.0::DOUBLE)) >= 0.9 AS same) AS x)
SELECT source_id, own AS frame_index, layout FROM kp WHERE layout <> 'page_turn' UNION ALL SELECT source_id, own, 'page_turn' FROM turn WHERE fresh""",
)
def plan_capture_options(spark, d):
    """Frames kept by one run over sources of three layouts, two levels, two rates and several ranges."""
    frames = big_frames(spark, d).withColumn("ts_sec", F.col("frame_index") * 0.5)
    resolved = J.stage(J.resolve_options(_job_options(frames)))
    accepted = resolved.filter(F.size("broken") == 0)
    taken = J.sampled_frames(frames, accepted)
    sheets = J.stage(frames.join(taken, [*J.KEY, *J.ORDER], "left_semi").select(*J.KEY, *J.ORDER, "px", "width", "height"))
    return J.kept_frames(sheets, accepted).join(accepted.select("source_id", "layout"), "source_id").select("source_id", "frame_index", "layout")


@query(
    "plan_failed_sources",
    f"""WITH {MF}, s AS (SELECT DISTINCT source_id FROM mf),
f AS (SELECT source_id, CASE WHEN source_id % 5 = 2 THEN 2 WHEN source_id % 5 = 3 THEN 3 ELSE 7 END AS reached, CASE WHEN source_id % 5 = 2 THEN 'No frames were extracted from source'
  WHEN source_id % 5 = 3 THEN 'rectification produced no output frames' END AS reason, source_id % 2 = 0 AS upscale FROM s WHERE source_id % 7 <> 6),
st AS (SELECT * FROM (VALUES (0, 'initializing', 0.01, 'initializing pipeline'), (1, 'detecting', 0.2, 'frame extraction completed'), (2, 'rectifying', 0.45, 'sheet detection completed'),
  (3, 'stitching', 0.68, 'rectification completed'), (4, 'upscaling', 0.82, 'stitching completed'), (5, 'exporting', 0.92, 'upscaling skipped'), (6, 'done', 1.0, 'export finished')) AS v(seq, step, progress, message))
SELECT source_id, CAST(seq AS INTEGER) AS seq, CASE WHEN step = 'done' THEN 'done' ELSE 'running' END AS status, CAST(progress AS DOUBLE) AS progress, step AS current_step,
  CASE WHEN step = 'exporting' AND upscale THEN 'upscaling completed' ELSE message END AS message, CAST(NULL AS VARCHAR) AS error_code FROM f JOIN st ON seq < reached
UNION ALL SELECT source_id, CAST(reached AS INTEGER), 'error', 1.0::DOUBLE, 'failed', 'job failed: ' || reason, 'PIPELINE_ERROR' FROM f WHERE reason IS NOT NULL""",
)
def plan_failed_sources(spark, d):
    """Progress and failure of every job: some sources have no frame in their range, some no frame that can be read, some broken options."""
    frames = big_frames(spark, d).withColumn("ts_sec", F.col("frame_index") * 0.5)
    k = F.col("source_id")
    frames = frames.withColumn("px", F.when(k % 5 != 3, F.col("px")))
    options = frames.select("source_id").distinct().select(
        "source_id", F.when(k % 5 == 2, 1e9).alias("start_sec"), (k % 2 == 0).alias("upscale"), F.when(k % 7 == 6, 5.0).otherwise(2.0).alias("scale"), F.lit(0.1).alias("fps")
    )
    return J.capture_jobs(frames, options).patches
