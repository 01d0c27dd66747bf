"""Export stage: frames of a source merged into a sheet, cut into pages, checked and listed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow import constants as C
from folioflow.operators import folds as Q
from folioflow.operators import frames as FR
from folioflow.operators import pagination as P
from folioflow.session import stage
from folioflow.sources.writers import export_manifest


@dataclass
class Export:
    """Tables of one export: all keyed by the source."""

    plan: DataFrame
    profile: DataFrame
    pages: DataFrame
    diagnostics: DataFrame
    canvas: DataFrame
    manifest: DataFrame


def toned_frames(frames: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Toned gray pixels and the row densities of their ink, from one pass over the pixels."""
    toned = FR.toned_profile(frames).filter("tone is not null")
    return toned.select(*key, *order, F.col("tone").alias("px"), "width", "height", "row_density")


def sheet_profile(toned: DataFrame, plan: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(key, y, density) of the merged sheets.

    Each row of a toned frame is placed at its offset; its density is a share of the
    widest frame of the sheet. Under an overlap the lower frame's rows count, gap rows are blank.
    """
    key = list(key)
    widest = toned.select(*key, "width").groupBy(*key).agg(F.max("width").alias("_widest"))
    inked = toned.select(*key, *order, F.col("width").alias("_own"), "row_density").join(widest, key)
    rows = inked.join(plan.select(*key, *order, "y_offset"), [*key, *order]).select(
        *key, F.col("y_offset").alias("_at"), (F.col("_own") / F.col("_widest")).alias("_share"), F.posexplode("row_density").alias("_line", "density")
    )
    rows = rows.select(*key, (F.col("_at") + F.col("_line")).cast("int").alias("y"), "_at", (F.col("density") * F.col("_share")).alias("density"))
    # Two frames may cover a row: the later one starts lower.
    top = rows.groupBy(*key, "y").agg(F.max_by("density", "_at").alias("density"))
    height = rows.groupBy(*key).agg(F.max("y").alias("_last"))
    grid = height.select(*key, F.explode(F.sequence(F.lit(0), "_last")).alias("y"))
    return grid.join(top, [*key, "y"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


def export(
    frames: DataFrame,
    runs: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    *,
    mode: str = "performance",
    ratio: float = C.PAGE_RATIO,
    raw: DataFrame | None = None,
    review: bool = False,
    stitch: DataFrame | None = None,
) -> Export:
    """Merge, paginate, diagnose and list the ``frames`` of every key; ``runs`` (key, formats, include_raw).

    A ``review`` lists previews and no complete sheet. ``stitch`` (a ``stitch_plan`` of the frames)
    makes stitched pages the images that are merged.
    """
    key = list(key)
    toned = stage(toned_frames(frames, key, order))
    grids = toned.drop("row_density")
    grids = FR.align_width(grids, key) if dict(toned.dtypes)["px"].startswith("array") else grids
    if stitch is None:
        plan, used = stage(Q.merge_plan(grids, key, order, tone=False)), F.count(F.lit(1))
    else:
        plan, used = stage(Q.stitched_sheet_plan(grids, stitch, key, order, tone=False)), F.sum(F.col("new_page").cast("int"))
    profile = stage(sheet_profile(toned, plan, key, order))
    sheets = (
        plan.groupBy(*key).agg(F.max("width").alias("width"), used.alias("used_frames"))
        .join(profile.groupBy(*key).agg((F.max("y") + 1).alias("height")), key)
    )
    pages = stage(P.split_pages(profile, sheets, key, mode=mode, ratio=ratio))
    sized = pages.join(sheets.select(*key, "width"), key).withColumn("height", F.col("y_end") - F.col("y_start"))
    runs = runs.join(sheets.select(*key, "used_frames"), key)
    canvas = P.frame_pages(sized, key, ratio=ratio)
    return Export(
        plan=plan,
        profile=profile,
        pages=pages,
        diagnostics=P.canvas_diagnostics(profile, canvas, key),
        canvas=canvas,
        manifest=export_manifest(pages, runs, key, raw=raw, review=review),
    )
