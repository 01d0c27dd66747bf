"""Capture jobs with options of their own: one run for sources of any layout, rate, range and format.

Options are resolved per source (presets, hints, region shape), checked, and turned into
columns; folds take their thresholds from them. Sources whose options are broken are refused, sources that give no
frames, sheets or pages become failed jobs; every job's progress comes out as patches for the job table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.geometry import infer_layout, inherit_hint
from folioflow.functions.numbers import effective_overlap, page_turn_similarity
from folioflow.functions.text import normalize_formats
from folioflow.operators import folds as Q
from folioflow.operators import frames as FR
from folioflow.operators import joins as J
from folioflow.operators import projections as P
from folioflow.plans.export import Export, export
from folioflow.runs import Ordered
from folioflow.session import stage
from folioflow.sources.writers import nothing_to_export

KEY, ORDER = ["source_id"], ["frame_index"]

# Option columns that a table may leave out, with their defaults.
DEFAULTS = {
    "source_type": ("string", "file"),
    "preset": ("string", None),
    "fps": ("double", None),
    "start_sec": ("double", None),
    "end_sec": ("double", None),
    "roi": ("array<array<double>>", None),
    "layout_hint": ("string", "auto"),
    "detect_hint": ("string", "auto"),
    "dedupe_level": ("string", None),
    "stitch": ("boolean", None),
    "overlap_threshold": ("double", None),
    "upscale": ("boolean", None),
    "scale": ("double", None),
    "page_fill_mode": ("string", "performance"),
    "include_raw": ("boolean", False),
}
MODES = ("performance", "balanced")

# What a job reports when a step is done, and why it fails when a step gives nothing.
# step, progress, message
STAGES = (
    ("initializing", 0.01, "initializing pipeline"),
    ("detecting", 0.2, "frame extraction completed"),
    ("rectifying", 0.45, "sheet detection completed"),
    ("stitching", 0.68, "rectification completed"),
    ("upscaling", 0.82, "stitching completed"),
    ("exporting", 0.92, "upscaling skipped"),
    ("done", 1.0, "export finished"),
)
UPSCALED = "upscaling completed"
NO_FRAMES = "No frames were extracted from source"
NO_SHEETS = "rectification produced no output frames"


@dataclass
class CaptureRun:
    """What a run of capture jobs gives: all tables are keyed by the source."""

    options: DataFrame
    refused: DataFrame
    kept: DataFrame
    exports: list[Export]
    patches: DataFrame


def resolve_options(options: DataFrame) -> DataFrame:
    """One row per source with every option set, its layout, level and thresholds, and ``broken`` rules.

    A preset gives what a source leaves open; without one the basic preset does.
    """
    given = options
    for name, (kind, default) in DEFAULTS.items():
        held = F.col(name).cast(kind) if name in options.columns else F.lit(None).cast(kind)
        given = given.withColumn(name, held if default is None else F.coalesce(held, F.lit(default)))
    if "formats" not in options.columns:
        given = given.withColumn("formats", F.lit(None).cast("array<string>"))
    own = {"_stitch": "stitch", "_level": "dedupe_level", "_upscale": "upscale"}
    given = given.withColumns({a: F.col(b) for a, b in own.items()}).drop(*own.values())
    wide = P.expand_presets(given, "preset", fps="fps")
    wide = wide.withColumns(
        {
            "stitch": F.coalesce("_stitch", "stitch"),
            "level": F.coalesce("_level", "dedupe_level"),
            "overlap_threshold": F.coalesce("overlap_threshold", "overlap"),
            "upscale": F.coalesce("_upscale", "upscale"),
            "scale": F.coalesce("scale", "upscale_factor"),
        }
    )
    fields = {f: F.col(f) for f in P.OPTION_FIELDS}
    checked = P.validate_options(wide, fields)
    hint = inherit_hint(F.col("layout_hint"), F.col("detect_hint"))
    checked = checked.withColumn("layout", infer_layout(hint, F.col("roi"), F.col("stitch"), F.col("source_type")))
    return checked.withColumns(
        {
            "formats": normalize_formats(F.coalesce("formats", F.array(F.lit("png"), F.lit("pdf")))),
            "threshold": effective_overlap(F.col("overlap_threshold"), F.col("layout")),
            "cut": page_turn_similarity(F.col("overlap_threshold")),
        }
    ).select(
        *KEY, "source_type", "capture_fps", "start_sec", "end_sec", "roi", "layout", "level", "stitch", "threshold", "cut", "upscale", "scale",
        "page_fill_mode", "formats", "include_raw", "broken",
    )


def sampled_frames(frames: DataFrame, options: DataFrame) -> DataFrame:
    """(source_id, frame_index) of the frames that each source's range and rate take; no pixels are read."""
    rows = frames.select(*KEY, *ORDER, "ts_sec").join(options.select(*KEY, "start_sec", "end_sec", "capture_fps"), KEY)
    rows = P.clip_time_range(rows, "ts_sec", F.col("start_sec"), F.col("end_sec"))
    return P.sample_frames(rows, KEY, "ts_sec", F.col("capture_fps"), tie=ORDER).select(*KEY, *ORDER)


def kept_frames(sheets: DataFrame, options: DataFrame) -> DataFrame:
    """Without duplicates by each source's layout and level; of page-turn sources only the first frame of each page."""
    flags = Q.dedupe_by_options(sheets, KEY, ORDER, options)
    kept = sheets.join(flags.filter("keep").select(*KEY, *ORDER), [*KEY, *ORDER], "left_semi")
    turning = options.filter("layout = 'page_turn'").select(*KEY, "cut")
    kept = stage(kept)
    turns = Q.collapse_page_turns(kept.join(turning.select(*KEY), KEY, "left_semi"), KEY, ORDER, cuts=turning)
    first = Q.page_turn_pages(turns).select(*KEY, *ORDER)
    pages = kept.join(first, [*KEY, *ORDER], "left_semi")
    return kept.join(turning.select(*KEY), KEY, "left_anti").unionByName(pages)


def stage_patches(options: DataFrame, sampled: DataFrame, sheets: DataFrame, failed_exports: DataFrame) -> DataFrame:
    """(source_id, seq, status, progress, current_step, message, error_code): the progress of every job, up to its end or failure."""
    jobs = options.select(*KEY, "upscale")
    for rows, name in ((sampled.select(*KEY).distinct(), "_sampled"), (FR.runs_without_output(sampled, sheets, KEY), "_no_sheets")):
        jobs = jobs.join(rows.withColumn(name, F.lit(True)), KEY, "left")
    jobs = jobs.join(failed_exports.select(*KEY, "error"), KEY, "left")
    reason = (
        F.when(F.col("_sampled").isNull(), F.lit(NO_FRAMES)).when(F.col("_no_sheets"), F.lit(NO_SHEETS)).otherwise(F.col("error"))
    )
    # Steps that a job has gone through when it fails: frames are counted at the second, sheets at the third.
    reached = F.when(F.col("_sampled").isNull(), 2).when(F.col("_no_sheets"), 3).when(F.col("error").isNotNull(), 6).otherwise(7)

    def row(seq: int, step: str, progress: float, message: str | Column) -> Column:
        done = step == "done"
        return F.struct(
            F.lit(seq).alias("seq"), F.lit("done" if done else "running").alias("status"), F.lit(progress).alias("progress"),
            F.lit(step).alias("current_step"), (F.lit(message) if isinstance(message, str) else message).alias("message"),
            F.lit(None).cast("string").alias("error_code"),
        )

    steps = []
    for seq, (step, progress, message) in enumerate(STAGES):
        said = F.when(F.col("upscale"), F.lit(UPSCALED)).otherwise(F.lit(message)) if step == "exporting" else message
        steps.append(row(seq, step, progress, said))
    failure = F.struct(
        reached.cast("int").alias("seq"), F.lit("error").alias("status"), F.lit(1.0).alias("progress"), F.lit("failed").alias("current_step"),
        F.concat(F.lit("job failed: "), reason).alias("message"), F.lit("PIPELINE_ERROR").alias("error_code"),
    )
    walked = F.slice(F.array(*steps), F.lit(1), reached)
    ended = F.when(reason.isNotNull(), F.concat(walked, F.array(failure))).otherwise(walked)
    return jobs.select(*KEY, F.explode(ended).alias("_p")).select(*KEY, "_p.*")


def capture_jobs(frames: DataFrame, options: DataFrame, *, whole_sheet: bool = False) -> CaptureRun:
    """``frames`` (source_id, frame_index, ts_sec, width, height, px), ``options`` (source_id and columns of DEFAULTS, formats).

    Sources are exported in at most four groups, by page fill mode and by whether their frames are stitched.
    """
    resolved = stage(resolve_options(options))
    refused = resolved.filter(F.size("broken") > 0).select(*KEY, "broken")
    accepted = resolved.filter(F.size("broken") == 0)
    taken = sampled_frames(frames, accepted)
    rows = frames.join(taken, [*KEY, *ORDER], "left_semi")
    sheets = FR.rectify_frames(J.attach_roi(rows, accepted.select(*KEY, "roi"), KEY))
    sheets = sheets.filter("sheet is not null").select(
        *KEY, *ORDER, F.col("sheet").alias("px"), F.col("sheet_width").alias("width"), F.col("sheet_height").alias("height")
    )
    kept = stage(kept_frames(stage(sheets), accepted))
    stitching = (F.col("layout") != "page_turn") & F.col("stitch")
    copies = Ordered(taken.join(accepted.filter("include_raw").select(*KEY), KEY, "left_semi"), KEY, ORDER).position("_copy").result()
    raw = copies.select(*KEY, F.col("_copy").alias("frame_index"))
    exports = []
    for mode in MODES:
        for stitched in (False, True):
            group = accepted.filter((F.col("page_fill_mode") == mode) & (stitching == F.lit(stitched)))
            own = kept.join(group.select(*KEY), KEY, "left_semi")
            if own.isEmpty():
                continue
            plan = None
            if stitched:
                limited = own.join(group.select(*KEY, "threshold"), KEY)
                plan = stage(Q.stitch_plan(limited, KEY, ORDER, threshold=F.col("threshold"), whole_sheet=whole_sheet))
            runs = group.select(*KEY, "formats", "include_raw").join(own.select(*KEY).distinct(), KEY, "left_semi")
            exports.append(export(own, runs, KEY, ORDER, mode=mode, raw=raw.join(group.select(*KEY), KEY, "left_semi"), stitch=plan))
    written = _all([e.manifest.select(*KEY) for e in exports], accepted.select(*KEY).limit(0))
    empty = nothing_to_export(accepted.join(kept.select(*KEY).distinct(), KEY, "left_semi"), written, KEY)
    patches = stage_patches(accepted, taken, sheets, empty)
    return CaptureRun(options=resolved, refused=refused, kept=kept, exports=exports, patches=patches)


def _all(parts: list[DataFrame], none: DataFrame) -> DataFrame:
    out = none
    for part in parts:
        out = out.unionByName(part)
    return out


def all_rows(run: CaptureRun, table: str) -> DataFrame | None:
    """One table of all exports of a run: plan, profile, pages, diagnostics, canvas or manifest."""
    parts = [getattr(e, table) for e in run.exports]
    return _all(parts[1:], parts[0]) if parts else None
