"""Per-frame and per-pair measures. All narrow: one pass over the frames, no shuffle of pixels.

Grids (``px ARRAY<INT>`` + ``width``) are measured with higher-order functions in
the JVM; packed images (``BINARY``) go through Arrow batches to numpy helpers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as C
from folioflow import kernels as K
from folioflow.arrow import map_rows
from folioflow.runs import Ordered


def _like(frames: DataFrame, px: str = "px"):
    """(column type, converter) for an image column of the same kind as ``px``: packed bytes or a grid."""
    if dict(frames.dtypes)[px] == "binary":
        return "binary", lambda img: img.astype(np.uint8).tobytes()
    return "array<int>", lambda img: img.reshape(-1).astype(np.int32)


def unpack(frames: DataFrame) -> DataFrame:
    """``px`` as a gray grid, whatever it was."""

    def grid(px, width, height):
        gray = K.image(px, width, height)
        return (None if gray is None else gray.reshape(-1).astype(np.int32),)

    if dict(frames.dtypes)["px"] != "binary":
        return frames
    return map_rows(frames, ["px", "width", "height"], grid, [("_px", "array<int>")]).drop("px").withColumnRenamed("_px", "px")


def _height(px: Column, width: Column) -> Column:
    return F.floor(F.size(px) / width).cast("int")


def _count(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


# --- ink --------------------------------------------------------------------------


def ink_profile(frames: DataFrame, *, px: str = "px", width: str = "width", threshold: int = 127) -> DataFrame:
    """Add ``row_density`` and ``col_density``: share of ink (gray <= threshold) per row and column."""
    p, w = F.col(px), F.col(width)
    h = _height(p, w)
    rows = F.transform(
        F.sequence(F.lit(0), h - 1), lambda y: _count(F.slice(p, y * w + 1, w), lambda v: v <= threshold) / w
    )
    cols = F.transform(
        F.sequence(F.lit(0), w - 1),
        lambda x: _count(F.sequence(F.lit(0), h - 1), lambda y: F.get(p, y * w + x) <= threshold) / h,
    )
    return frames.withColumns({"row_density": rows, "col_density": cols})


def adaptive_ink_profile(
    frames: DataFrame, *, block: int = C.INK_BLOCK, c: int = C.INK_OFFSET, opened: bool = False
) -> DataFrame:
    """The same two columns from the adaptive ink mask of ``px``/``width``/``height`` images."""

    def measure(px, width, height):
        gray = K.image(px, width, height)
        if gray is None:
            return None, None
        mask = K.ink_mask(gray, block, c, opened)
        return mask.mean(axis=1), mask.mean(axis=0)

    outputs = [("row_density", "array<double>"), ("col_density", "array<double>")]
    return map_rows(frames, ["px", "width", "height"], measure, outputs)


def profile_rows(frames: DataFrame, key: Sequence[str], density: str = "row_density") -> DataFrame:
    """Long form (key, y, density) of a density array."""
    return frames.select(*key, F.posexplode(density).alias("y", "density"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def frame_density(profiles: DataFrame, *, rows: str = "row_density") -> DataFrame:
    """Add ``density``, ``top_density``, ``bottom_density`` of a frame from its row densities."""
    r = F.col(rows)
    h = F.size(r)
    fifth = F.floor(h / 5).cast("int")
    band = F.greatest(F.lit(4), F.least(F.lit(28), F.when(fifth == 0, F.lit(4)).otherwise(fifth)))
    used = F.least(band, h)
    return profiles.withColumns(
        {
            "density": _mean(r),
            "top_density": _mean(F.slice(r, F.lit(1), used)),
            "bottom_density": _mean(F.slice(r, h - used + 1, used)),
        }
    )


def content_bbox(profiles: DataFrame, *, cut: float = C.CONTENT_CUT, pad_min: int = 8) -> DataFrame:
    """Add ``box`` (y0, y1, x0, x1): rows and columns with content, padded; the full frame when there is none."""

    def span(density: str):
        d = F.col(density)
        hits = F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda i: F.get(d, i) > cut)
        return F.array_min(hits), F.array_max(hits)

    h, w = F.size("row_density"), F.size("col_density")
    (top, bottom), (left, right) = span("row_density"), span("col_density")
    pad = F.greatest(F.lit(pad_min), F.floor(F.least(h, w) * 0.012).cast("int"))
    empty = top.isNull() | left.isNull() | (h <= 8) & (F.lit(pad_min) > 0) | (w <= 8) & (F.lit(pad_min) > 0)
    box = F.struct(
        F.when(empty, 0).otherwise(F.greatest(F.lit(0), top - pad)).alias("y0"),
        F.when(empty, h).otherwise(F.least(h, bottom + pad + 1)).alias("y1"),
        F.when(empty, 0).otherwise(F.greatest(F.lit(0), left - pad)).alias("x0"),
        F.when(empty, w).otherwise(F.least(w, right + pad + 1)).alias("x1"),
    )
    return profiles.withColumn("box", box)


def ink_mask(
    frames: DataFrame,
    *,
    block: int = C.INK_BLOCK,
    c: int = C.INK_OFFSET,
    opened: bool = False,
    threshold: int | None = None,
) -> DataFrame:
    """Add ``ink`` (1 = ink), of the kind of ``px``. A global ``threshold`` stays in the JVM; else adaptive."""
    if threshold is not None:
        return frames.withColumn("ink", F.transform("px", lambda v: F.when(v <= threshold, 1).otherwise(0)))

    kind, pack = _like(frames)

    def mask(px, width, height):
        gray = K.image(px, width, height)
        return (None if gray is None else pack(K.ink_mask(gray, block, c, opened)),)

    return map_rows(frames, ["px", "width", "height"], mask, [("ink", kind)])


# --- tone, hash, geometry ------------------------------------------------------------


def normalize_tone(frames: DataFrame, *, median: bool = True) -> DataFrame:
    """Add ``tone``, of the kind of ``px``: median filter, percentile stretch, lift."""
    kind, pack = _like(frames)

    def tone(px, width, height):
        gray = K.image(px, width, height)
        return (None if gray is None else pack(K.normalize_tone(gray, median)),)

    return map_rows(frames, ["px", "width", "height"], tone, [("tone", kind)])


def toned_profile(frames: DataFrame, *, median: bool = True) -> DataFrame:
    """Add ``tone`` and ``row_density``, the share of adaptive ink per row of the toned image, in one pass."""
    kind, pack = _like(frames)

    def measure(px, width, height):
        gray = K.image(px, width, height)
        if gray is None:
            return None, None
        gray = K.normalize_tone(gray, median)
        return pack(gray), K.ink_mask(gray).mean(axis=1)

    return map_rows(frames, ["px", "width", "height"], measure, [("tone", kind), ("row_density", "array<double>")])


def frame_hash(frames: DataFrame) -> DataFrame:
    """Add ``dhash BIGINT`` of the 9x8 shrunk frame; null below 9x8."""

    def measure(px, width, height):
        gray = K.image(px, width, height)
        return (None if gray is None else K.dhash(gray),)

    return map_rows(frames, ["px", "width", "height"], measure, [("dhash", "bigint")])


def rectify_frames(frames: DataFrame, *, roi: str = "roi") -> DataFrame:
    """Add ``sheet``, ``sheet_width``, ``sheet_height``: the ordered region warped to a rectangle.

    Rows without a region pass their frame through; unreadable frames are dropped.
    """
    kind, pack = _like(frames)
    outputs = [("sheet", kind), ("sheet_width", "int"), ("sheet_height", "int")]

    def rectify(px, width, height, points):
        gray = K.image(px, width, height)
        if gray is None:
            return None, None, None
        out = gray if points is None else K.warp(gray, points)
        return pack(out), out.shape[1], out.shape[0]

    return map_rows(frames, ["px", "width", "height", roi], rectify, outputs).filter("sheet is not null")


def runs_without_output(frames: DataFrame, rectified: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys whose rectification gave no frame at all: the runs to report as failed."""
    return frames.select(*key).distinct().join(rectified.select(*key).distinct(), list(key), "left_anti")


def align_width(frames: DataFrame, key: Sequence[str], *, px: str = "px", width: str = "width") -> DataFrame:
    """Pad narrower grids with white on both sides to the widest frame of the key."""
    widest = frames.groupBy(*key).agg(F.max(width).alias("_target"))
    extra = F.col("_target") - F.col(width)
    left = F.floor(extra / 2).cast("int")
    white = F.lit(255)
    p, w = F.col(px), F.col(width)
    padded = F.flatten(
        F.transform(
            F.sequence(F.lit(0), _height(p, w) - 1),
            lambda y: F.concat(
                F.array_repeat(white, left), F.slice(p, y * w + 1, w), F.array_repeat(white, extra - left)
            ),
        )
    )
    return (
        frames.join(widest, list(key))
        .withColumn(px, F.when(extra > 0, padded).otherwise(p))
        .withColumn(width, F.col("_target"))
        .drop("_target")
    )


# --- neighbouring frames ---------------------------------------------------------------


def consecutive_pairs(
    frames: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], *, small: bool | None = None
) -> DataFrame:
    """Add ``prev_<column>`` of the frame just before, null for the first frame of a key."""
    rows = Ordered(frames, key, order, small=small).neighbour("_prev", F.struct(*columns)).result()
    return rows.withColumns({f"prev_{c}": F.col("_prev")[c] for c in columns}).drop("_prev")


def frame_change(pairs: DataFrame, *, px: str = "px", prev: str = "prev_px", cut: int = C.CHANGE_CUT) -> DataFrame:
    """Add mean_abs_diff, changed_ratio, similarity and near_same against the frame before."""
    diff = F.zip_with(px, prev, lambda a, b: F.abs(a - b))
    n = F.size(px)
    total = F.aggregate("_diff", F.lit(0).cast("bigint"), lambda a, v: a + v)
    out = pairs.withColumn("_diff", diff).withColumn("mean_abs_diff", total / n)
    return out.withColumns(
        {
            "changed_ratio": _count(F.col("_diff"), lambda v: v > cut) / n,
            "similarity": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("mean_abs_diff") / 255.0)),
            "near_same": F.col("mean_abs_diff") < C.NEAR_SAME_CUT,
        }
    ).drop("_diff")


def structure_diff(pairs: DataFrame, *, block: int = C.INK_BLOCK, c: int = C.INK_OFFSET) -> DataFrame:
    """Add ``structure_diff``: share of pixels whose opened ink masks differ."""

    def measure(px, prev, width, height):
        a, b = K.image(px, width, height), K.image(prev, width, height)
        if a is None or b is None:
            return (None,)
        return (float((K.ink_mask(a, block, c, True) ^ K.ink_mask(b, block, c, True)).mean()),)

    return map_rows(pairs, ["px", "prev_px", "width", "height"], measure, [("structure_diff", "double")])


def detect_playhead(pairs: DataFrame, *, cut: int = C.CHANGE_CUT) -> DataFrame:
    """Add ``playhead``: do the changed pixels form a thin tall bar?"""

    def measure(px, prev, width, height):
        a, b = K.image(px, width, height), K.image(prev, width, height)
        if a is None or b is None:
            return (None,)
        return (K.moving_bar(np.abs(a.astype(np.int32) - b.astype(np.int32)) > cut),)

    return map_rows(pairs, ["px", "prev_px", "width", "height"], measure, [("playhead", "boolean")])


def row_mean_profile(frames: DataFrame, *, px: str = "px", width: str = "width", name: str = "row_mean") -> DataFrame:
    """Add the mean gray of every row of a grid."""
    p, w = F.col(px), F.col(width)
    rows = F.transform(
        F.sequence(F.lit(0), _height(p, w) - 1),
        lambda y: F.aggregate(F.slice(p, y * w + 1, w), F.lit(0).cast("bigint"), lambda a, v: a + v) / w,
    )
    return frames.withColumn(name, rows)


def estimate_shift(
    pairs: DataFrame,
    a: str,
    b: str,
    *,
    max_lag: int | None = None,
    min_seg: int = C.SHIFT_MIN_SEGMENT,
) -> DataFrame:
    """Add shift, shift_score, shift_conf: best lag between two row profiles of a pair."""

    def measure(x, y):
        if x is None or y is None:
            return None, None, None
        limit = max(20, int(min(len(x), len(y)) * 0.22)) if max_lag is None else max_lag
        return K.best_lag(x, y, limit, min_seg)

    outputs = [("shift", "int"), ("shift_score", "double"), ("shift_conf", "double")]
    return map_rows(pairs, [a, b], measure, outputs)


def phase_shift(pairs: DataFrame, *, max_shift: int) -> DataFrame:
    """Add phase_shift, phase_conf from the phase correlation of a pair."""

    def measure(px, prev, width, height):
        a, b = K.image(prev, width, height), K.image(px, width, height)
        return (None, None) if a is None or b is None else K.phase_shift(a, b, max_shift)

    return map_rows(
        pairs, ["px", "prev_px", "width", "height"], measure, [("phase_shift", "double"), ("phase_conf", "double")]
    )


def choose_shift(lag: Column, sure: Column, phase: Column, phase_sure: Column) -> Column:
    """Struct(shift, conf): row correlation unless phase correlation is clearly more certain."""
    use_phase = (phase_sure >= F.greatest(F.lit(0.38), sure + 0.12)) | ((sure < 0.24) & (phase_sure >= 0.3))
    return F.struct(
        F.when(use_phase, phase).otherwise(lag.cast("double")).alias("shift"),
        F.when(use_phase, phase_sure).otherwise(sure).alias("conf"),
    )


def estimate_overlap(
    pairs: DataFrame, *, lo: int | None = None, hi: int | None = None, step: int = 2, accept: float | None = None
) -> DataFrame:
    """Add overlap, overlap_diff, overlap_score between the frame before and this frame.

    Without bounds the stitch rule applies (window around the estimated shift);
    with ``lo``/``hi`` the plain search; ``accept`` turns a worse best into 0 rows.
    """
    outputs = [("overlap", "int"), ("overlap_diff", "double"), ("overlap_score", "double")]

    def measure(px, prev, width, height, prev_width, prev_height):
        b, a = K.image(px, width, height), K.image(prev, prev_width, prev_height)
        if a is None or b is None:
            return None, None, None
        if lo is None:
            score, rows, _ = K.stitch_overlap(a, b)
            return rows, (1.0 - score) * 255.0, score
        rows, diff = K.best_overlap(a, b, lo, hi, step)
        if accept is not None and diff > accept:
            rows = 0
        return rows, diff, min(1.0, max(0.0, 1.0 - diff / 255.0))

    return map_rows(pairs, ["px", "prev_px", "width", "height", "prev_width", "prev_height"], measure, outputs)
