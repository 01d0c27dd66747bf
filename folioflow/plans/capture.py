"""Full capture: frames of many sources to printed pages, as one chain of operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow import constants as C
from folioflow.functions.numbers import effective_overlap
from folioflow.operators import folds as Q
from folioflow.operators import frames as FR
from folioflow.operators import joins as J
from folioflow.operators import projections as P
from folioflow.plans.export import Export, export
from folioflow.runs import Ordered
from folioflow.session import stage

KEY, ORDER = ["source_id"], ["frame_index"]


@dataclass(frozen=True)
class CaptureOptions:
    start_sec: float | None = None
    end_sec: float | None = None
    fps: float = 1.0
    layout: str = "full_scroll"
    level: str = "normal"
    stitch: bool = False
    whole_sheet: bool = False
    overlap_threshold: float = 0.2
    page_fill_mode: str = "performance"
    formats: tuple[str, ...] = ("png", "pdf")
    include_raw: bool = False
    dedupe: dict = field(default_factory=dict)


def sampled_frames(frames: DataFrame, options: CaptureOptions) -> DataFrame:
    """(source_id, frame_index) of the frames in the time range that sampling takes; no pixels are read."""
    rows = P.clip_time_range(frames.select(*KEY, *ORDER, "ts_sec"), "ts_sec", options.start_sec, options.end_sec)
    return P.sample_frames(rows, KEY, "ts_sec", options.fps, tie=ORDER).select(*KEY, *ORDER)


def sampled_sheets(frames: DataFrame, rois: DataFrame, options: CaptureOptions) -> DataFrame:
    """Clip, sample, attach regions and rectify: (source_id, frame_index, px, width, height)."""
    rows = frames.join(sampled_frames(frames, options), [*KEY, *ORDER], "left_semi")
    sheets = FR.rectify_frames(J.attach_roi(rows, rois, KEY))
    return sheets.select(
        *KEY, *ORDER, F.col("sheet").alias("px"), F.col("sheet_width").alias("width"), F.col("sheet_height").alias("height")
    )


def kept_frames(sheets: DataFrame, options: CaptureOptions) -> DataFrame:
    """Without duplicates; in page-turn layout only the first frame of each page."""
    kept = Q.dedupe_frames(sheets, KEY, ORDER, layout=options.layout, level=options.level, **options.dedupe)
    if options.layout != "page_turn":
        return kept
    # Staged: the fold's frames are read by the page turns and again for their rows.
    kept = stage(kept)
    turns = Q.page_turn_pages(Q.collapse_page_turns(kept, KEY, ORDER, overlap=options.overlap_threshold))
    return kept.join(turns.select(*KEY, *ORDER), [*KEY, *ORDER], "left_semi")


def stitched_pages(kept: DataFrame, options: CaptureOptions) -> DataFrame | None:
    """The stitch plan of scrolling sources; none for page turns or when stitching is off."""
    if not options.stitch or options.layout == "page_turn":
        return None
    one = kept.sparkSession.range(1).select(effective_overlap(F.lit(options.overlap_threshold), F.lit(options.layout)).alias("t"))
    return stage(Q.stitch_plan(kept, KEY, ORDER, threshold=one.first()[0], whole_sheet=options.whole_sheet))


def capture(frames: DataFrame, rois: DataFrame, options: CaptureOptions = CaptureOptions()) -> Export:
    """``frames`` (source_id, frame_index, ts_sec, width, height, px), ``rois`` (source_id, roi) to an export."""
    # Staged: sizes, counts, features and the kept rows are all read from the warped frames.
    sheets = stage(sampled_sheets(frames, rois, options))
    kept = stage(kept_frames(sheets, options))
    formats = F.array(*[F.lit(f) for f in options.formats])
    runs = kept.select(*KEY).distinct().withColumns({"formats": formats, "include_raw": F.lit(options.include_raw)})
    raw = None
    if options.include_raw:
        # Copies are numbered from 0 in the order of the sampled frames.
        numbered = Ordered(sampled_frames(frames, options), KEY, ORDER).position("_copy").result()
        raw = numbered.select(*KEY, F.col("_copy").alias("frame_index"))
    return export(kept, runs, KEY, ORDER, mode=options.page_fill_mode, raw=raw, stitch=stitched_pages(kept, options))


__all__ = ["C", "CaptureOptions", "capture", "kept_frames", "sampled_sheets", "stitched_pages"]
