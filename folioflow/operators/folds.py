"""Greedy rules over ordered frames: duplicates, page turns, scrolling, stitching, merging."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as C
from folioflow import kernels as K
from folioflow.arrow import map_rows
from folioflow.operators.frames import consecutive_pairs, unpack
from folioflow.runs import Fold, Ordered, fits, ordered_fold
from folioflow.session import stage


def gray_frames(
    frames: DataFrame, key: Sequence[str], order: Sequence[str], *, tone: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """(key, order, gray BINARY, gw, gh): one byte per pixel, the only pixels a fold shuffles; ``keep`` of width and height stays."""

    def measure(px, width, height):
        img = K.image(px, width, height)
        if img is None:
            return None, None, None
        if tone:
            img = K.normalize_tone(img)
        return img.tobytes(), img.shape[1], img.shape[0]

    slim = frames.select(*key, *order, "px", "width", "height")
    return map_rows(slim, ["px", "width", "height"], measure, [("gray", "binary"), ("gw", "int"), ("gh", "int")]).drop(
        "px", *{"width", "height"}.difference(keep)
    )


def _img(gray: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(gray, dtype=np.uint8).reshape(height, width)


FEATURES = (("gray", "binary"), ("gw", "int"), ("gh", "int"), ("soft", "binary"), ("ink", "binary"), ("mark", "bigint"))


def distinct_features(frames: DataFrame, key: Sequence[str], order: Sequence[str], rule: "KeepDistinctFrames", *, keep_gray: bool) -> DataFrame:
    """(key, order, gray, gw, gh, soft, ink, mark): what the duplicate rules compare, made per frame in a narrow pass.

    ``soft`` is the gray frame at comparison size, blurred; ``ink`` its opened ink mask, one bit per pixel; ``mark``
    the gradient hash. ``gray`` is carried only where frames of unlike sizes, or shifts at a size of their own, need it.
    """

    def measure(px, width, height):
        img = K.image(px, width, height)
        if img is None:
            return (None,) * len(FEATURES)
        soft = rule.softened(K.resize(img, min(img.shape[1], C.COMPARE_WIDTH), min(img.shape[0], C.COMPARE_HEIGHT)))
        ink = K.packed(K.ink_mask(soft, opened=True)) if rule.structure > 0 and min(soft.shape) > rule.min_side else None
        return img.tobytes() if keep_gray else None, img.shape[1], img.shape[0], soft.tobytes(), ink, K.dhash(img)

    slim = frames.select(*key, *order, "px", "width", "height")
    return map_rows(slim, ["px", "width", "height"], measure, FEATURES).drop("px", "width", "height")


def needs_gray(frames: DataFrame, key: Sequence[str], rule: "KeepDistinctFrames") -> bool:
    """Must the fold see whole gray frames? Sizes tell, without a look at the pixels."""
    if dict(frames.dtypes)["px"] != "binary":
        return True
    sides = frames.groupBy(*key).agg(*[f(c).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("lo", F.min), ("hi", F.max))])
    unlike = (F.col("lo_width") != F.col("hi_width")) | (F.col("lo_height") != F.col("hi_height"))
    row = sides.agg(F.max(unlike), F.max("hi_width"), F.max("hi_height")).first()
    own_size = row[1] is not None and (row[1] > min(C.COMPARE_WIDTH, C.SHIFT_WIDTH) or row[2] > min(C.COMPARE_HEIGHT, C.SHIFT_HEIGHT))
    return bool(row[0]) or (rule.layout == "full_scroll" and (bool(own_size) or not rule.blur))


class KeepDistinctFrames(Fold):
    """Keep a frame unless it repeats the last kept one, a recent kept hash, or barely scrolled.

    Frames come with their features; frames of one size are compared by differences, bits and one lag search.
    """

    columns = tuple(n for n, _ in FEATURES)
    outputs = (("keep", "boolean"), ("drop_reason", "string"))

    def __init__(self, layout="full_scroll", level="normal", **over):
        row = layout if layout in C.LAYOUTS else "full_scroll"
        self.layout = layout
        self.static = over.get("static", C.by_level(C.STATIC_CUT[row], level))
        self.structure = over.get("structure", C.by_level(C.STRUCTURE_CUT[row], level))
        self.playhead = over.get("playhead", C.by_level(C.PLAYHEAD_CUT, level))
        self.distance = over.get("distance", C.by_level(C.HASH_CUT[row], level))
        self.scroll = over.get("scroll", C.by_level(C.SCROLL_MIN, level))
        self.min_side = over.get("min_side", C.MIN_COMPARE_SIDE)
        self.blur = over.get("blur", True)

    def softened(self, image: np.ndarray) -> np.ndarray:
        return K.blur3(image) if self.blur else image

    def _compared(self, kept, now):
        """Both frames at one size, softened, and the share of their ink that differs (a function, since it costs more)."""
        (gray_a, wa, ha, soft_a, ink_a, _), (gray_b, wb, hb, soft_b, ink_b, _) = kept, now
        if (wa, ha) == (wb, hb):
            shape = (min(ha, C.COMPARE_HEIGHT), min(wa, C.COMPARE_WIDTH))
            a, b = (np.frombuffer(s, dtype=np.uint8).reshape(shape) for s in (soft_a, soft_b))
            return a, b, lambda: K.differing_bits(ink_a, ink_b) / a.size
        a, b = map(self.softened, K.common(_img(gray_a, wa, ha), _img(gray_b, wb, hb), C.COMPARE_HEIGHT, C.COMPARE_WIDTH))
        return a, b, lambda: float((K.ink_mask(a, opened=True) ^ K.ink_mask(b, opened=True)).mean())

    def _duplicate(self, kept, now) -> str | None:
        if min(kept[2], now[2], C.COMPARE_HEIGHT) <= self.min_side or min(kept[1], now[1], C.COMPARE_WIDTH) <= self.min_side:
            return None
        a, b, ink_diff = self._compared(kept, now)
        changed = np.where(a > b, a - b, b - a) > C.CHANGE_CUT
        ratio = float(changed.mean())
        if ratio < self.static:
            return "static"
        if self.structure > 0 and ink_diff() < self.structure:
            return "structure"
        if self.layout == "bottom_bar" and ratio < self.playhead and K.moving_bar(changed):
            return "playhead"
        return None

    def _shift(self, kept, now) -> tuple[float, float]:
        if kept[0] is None or now[0] is None:
            return K.blurred_shift(*(np.frombuffer(f[3], dtype=np.uint8).reshape(f[2], f[1]) for f in (kept, now)))
        return K.vertical_shift(_img(*kept[:3]), _img(*now[:3]))

    def step(self, state, *now):
        unreadable, mark = now[1] is None, now[5]
        if state == "off":
            return state, (True, None)
        if state is None:
            if unreadable:
                return "off", (True, None)
            return (now, () if mark is None else (mark,), 0), (True, None)
        if unreadable:
            return state, (False, "unreadable")
        kept, ring, direction = state
        reason = self._duplicate(kept, now)
        if reason:
            return state, (False, reason)
        if self.layout in ("bottom_bar", "page_turn") and mark is not None and ring:
            if min(K.hamming(mark, old) for old in ring) <= self.distance:
                return state, (False, "recent")
        if self.layout == "full_scroll":
            keep, direction = scroll_step(direction, *self._shift(kept, now), self.scroll)
            if not keep:
                return state, (False, "scroll")
        if mark is not None:
            ring = (ring + (mark,))[-C.RING :]
        return (now, ring, direction), (True, None)


class KeepDistinctByOptions(Fold):
    """``KeepDistinctFrames`` with the layout and level that each row carries (the same for all rows of a key)."""

    columns = (*KeepDistinctFrames.columns, "layout", "level")
    outputs = KeepDistinctFrames.outputs

    def __init__(self):
        self.rules: dict[tuple, KeepDistinctFrames] = {}

    def step(self, state, *row):
        *now, layout, level = row
        rule = self.rules.get((layout, level))
        if rule is None:
            rule = self.rules[layout, level] = KeepDistinctFrames(layout, level)
        return rule.step(state, *now)


def scroll_step(direction: int, shift: float, sure: float, minimum: float) -> tuple[bool, int]:
    """(keep, new direction) of one scroll movement."""
    if sure >= C.SCROLL_CONFIDENCE and abs(shift) < minimum:
        return False, direction
    if sure >= C.DIRECTION_CONFIDENCE and abs(shift) >= 1.0:
        way = 1 if shift > 0 else -1
        if direction and way != direction and abs(shift) < minimum * C.JITTER_FACTOR:
            return False, direction
        return True, way
    return True, direction


def dedupe_frames(
    frames: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    *,
    layout: str = "full_scroll",
    level: str = "normal",
    flags: bool = False,
    **overrides,
) -> DataFrame:
    """Rows of the kept frames. The fold sees features only; the rows come back by a semi join."""
    rule = KeepDistinctFrames(layout, level, **overrides)
    features = distinct_features(frames, key, order, rule, keep_gray=needs_gray(frames, key, rule))
    out = ordered_fold(features, key, order, rule, small=fits(frames, key)).drop(*rule.columns)
    if flags:
        return out
    return frames.join(out.filter("keep").select(*key, *order), [*key, *order], "left_semi")


def dedupe_by_options(frames: DataFrame, key: Sequence[str], order: Sequence[str], options: DataFrame) -> DataFrame:
    """(key, order, keep, drop_reason) by the layout and level of each key; ``options`` (key, layout, level).

    One pass for all layouts. Options join the features by key; the features' sizes are those of ``dedupe_frames``.
    """
    rule = KeepDistinctFrames("full_scroll")
    features = distinct_features(frames, key, order, rule, keep_gray=needs_gray(frames, key, rule))
    rows = features.join(options.select(*key, "layout", "level"), list(key))
    fold = KeepDistinctByOptions()
    return ordered_fold(rows, key, order, fold, small=fits(frames, key)).drop(*fold.columns)


class RecentHash(Fold):
    columns = ("_hash",)
    outputs = (("keep", "boolean"),)

    def __init__(self, max_dist: int, ring: int = C.RING):
        self.max_dist, self.size = max_dist, ring

    def start(self):
        return ()

    def step(self, ring, mark):
        if mark is None:
            return ring, (True,)
        if ring and min(K.hamming(mark, old) for old in ring) <= self.max_dist:
            return ring, (False,)
        return (ring + (mark,))[-self.size :], (True,)


def recent_hash_filter(
    df: DataFrame, key: Sequence[str], order: Sequence[str], hash_col: str, *, max_dist: int, ring: int = C.RING
) -> DataFrame:
    """Keep a row only if its hash is farther than ``max_dist`` from the last ``ring`` kept hashes."""
    out = ordered_fold(df.withColumn("_hash", F.col(hash_col)), key, order, RecentHash(max_dist, ring))
    return out.filter("keep").drop("keep", "_hash")


class Scroll(Fold):
    """``scroll_step`` over whole arrays: only rows that move far enough, or the first that move at all, set the direction."""

    columns = ("_shift", "_conf")
    outputs = (("keep", "boolean"), ("direction", "int"))
    arrays = True

    def __init__(self, minimum: float):
        self.minimum = minimum

    def start(self):
        return 0

    def walk(self, direction, columns):
        shift, sure = (np.asarray(c, dtype=np.float64) for c in columns)
        far, way = np.abs(shift), np.where(shift > 0, 1, -1)
        still = (sure >= C.SCROLL_CONFIDENCE) & (far < self.minimum)
        moves = ~still & (sure >= C.DIRECTION_CONFIDENCE) & (far >= 1.0)
        sets = moves & (far >= self.minimum * C.JITTER_FACTOR)
        if not direction and moves.any():
            sets[moves.argmax()] = True
        latest = np.maximum.accumulate(np.where(sets, np.arange(len(sets)), -1))
        directions = np.where(latest >= 0, way[latest], direction)
        keep = ~still & ~(moves & (way != directions))
        return int(directions[-1]) if len(directions) else direction, [keep.tolist(), directions.tolist()]


def filter_scroll(
    df: DataFrame, key: Sequence[str], order: Sequence[str], shift: str, conf: str, *, level: str = "normal"
) -> DataFrame:
    """Add keep and direction: rows that barely moved or jittered back are not kept."""
    rows = df.withColumns({"_shift": F.col(shift), "_conf": F.col(conf)})
    return ordered_fold(rows, key, order, Scroll(C.by_level(C.SCROLL_MIN, level))).drop("_shift", "_conf")


class PageTurns(Fold):
    columns = ("gray", "gw", "gh")
    outputs = (("new_page", "boolean"), ("similarity", "double"))

    def __init__(self, cut: float):
        self.cut = cut

    def step(self, state, gray, gw, gh):
        if gray is None:
            return state, (None, None)
        if state is None:
            return (gray, gw, gh), (True, None)
        alike = K.similarity(_img(*state), _img(gray, gw, gh))
        if alike >= self.cut:
            return state, (False, alike)
        return (gray, gw, gh), (True, alike)


class PageTurnsByCut(PageTurns):
    """``PageTurns`` with the cut that each row carries."""

    columns = ("gray", "gw", "gh", "cut")

    def __init__(self):
        super().__init__(0.0)

    def step(self, state, gray, gw, gh, cut):
        self.cut = cut
        return super().step(state, gray, gw, gh)


def collapse_page_turns(
    frames: DataFrame, key: Sequence[str], order: Sequence[str], *, overlap: float | None = 0.2, cuts: DataFrame | None = None
) -> DataFrame:
    """(key, order, new_page, similarity, page_no): a page starts where a frame differs from the page's first.

    ``cuts`` (key, cut) gives each key its own least similarity in place of the one that ``overlap`` sets.
    """
    small = fits(frames, key)
    gray = gray_frames(frames, key, order)
    if cuts is None:
        turns = ordered_fold(gray, key, order, PageTurns(max(0.88, min(0.98, 1.0 - overlap * 0.25))), small=small)
    else:
        turns = ordered_fold(gray.join(cuts.select(*key, "cut"), list(key)), key, order, PageTurnsByCut(), small=small).drop("cut")
    turns = turns.drop("gray", "gw", "gh").filter("new_page is not null")
    return Ordered(turns, key, order, small=small).running("page_no", F.col("new_page").cast("int")).result()


def page_turn_pages(turns: DataFrame) -> DataFrame:
    """First frame of every page."""
    return turns.filter("new_page").drop("new_page")


# --- stitch and merge plans -------------------------------------------------------------


def _offsets(rows: DataFrame, key, order, new_page, gain, small) -> DataFrame:
    """Page number and y offset from page starts and the height gained by each following frame."""
    rows = Ordered(rows, key, order, small=small).running("page_no", F.when(new_page, 1).otherwise(0)).result()
    gain = F.when(F.col("new_page"), F.lit(0)).otherwise(gain)
    return Ordered(rows, [*key, "page_no"], order, small=small).running("y_offset", gain).result()


class OntoSheet(Fold):
    """Lay each frame onto the page stitched so far, or start a page with it."""

    columns = ("gray", "gw", "gh", "threshold")
    outputs = (("overlap", "int"), ("score", "double"), ("new_page", "boolean"), ("y_offset", "bigint"))

    def __init__(self, bounds: tuple[int, int, int] | None, sheet_rows: int):
        self.bounds, self.sheet_rows = bounds, sheet_rows

    def _compare(self, sheet: K.Sheet, frame: np.ndarray) -> tuple[float, int]:
        if self.bounds is None:
            score, rows, _ = K.stitch_overlap(sheet, frame)
            return score, rows
        rows, diff = K.best_overlap(*K.common(sheet, frame), *self.bounds)
        return min(1.0, max(0.0, 1.0 - diff / 255.0)), rows

    def step(self, sheet, gray, gw, gh, threshold):
        if gray is None:
            return sheet, (None, None, None, None)
        frame = _img(gray, gw, gh)
        score, rows = (None, 0) if sheet is None else self._compare(sheet, frame)
        if score is None or score < threshold:
            return K.Sheet(frame, self.sheet_rows), (0, score, True, 0)
        height = sheet.shape[0]
        rows = max(0, min(rows, height - 1, gh - 1))
        return sheet.stitched(frame, rows), (rows, score, False, height - rows)


def _limits(frames: DataFrame, key: Sequence[str], threshold: float | Column) -> DataFrame | None:
    """(key, threshold) where each key has its own."""
    if not isinstance(threshold, Column):
        return None
    return frames.groupBy(*key).agg(F.first(threshold).alias("threshold"))


def stitch_plan(
    frames: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    *,
    threshold: float | Column,
    enable: bool = True,
    bounds: tuple[int, int, int] | None = None,
    whole_sheet: bool = False,
    sheet_rows: int = C.SHEET_ROWS,
) -> DataFrame:
    """(key, order, width, height, overlap, score, new_page, page_no, y_offset) of every frame.

    Frames are compared with the frame before them, all pairs in parallel. With ``whole_sheet``
    they are compared with the whole page stitched so far, squeezed to the frame's height: a
    fold per key whose state is a ``Sheet`` of at most ``sheet_rows`` rows (exact up to that
    height, thinned out above it); frames that cannot be read are left out. ``threshold`` may be a
    column of ``frames``, the same for all rows of a key.
    """
    size = [*key, *order, "width", "height"]
    small = fits(frames, key)
    if enable and whole_sheet:
        limits = _limits(frames, key, threshold)
        gray = gray_frames(frames, key, order)
        gray = gray.withColumn("threshold", F.lit(threshold)) if limits is None else gray.join(limits, list(key))
        laid = ordered_fold(gray, key, order, OntoSheet(bounds, sheet_rows), small=small)
        laid = laid.filter("new_page is not null")
        paged = Ordered(laid.drop("gray", "threshold"), key, order, small=small).running("page_no", F.col("new_page").cast("int")).result()
        named = {"gw": "width", "gh": "height"}
        return paged.withColumnsRenamed(named).select(*size, "overlap", "score", "new_page", "page_no", "y_offset")
    if not enable:
        alone = frames.select(*size).withColumns(
            {"overlap": F.lit(0), "score": F.lit(0.0), "new_page": F.lit(True), "y_offset": F.lit(0).cast("bigint")}
        )
        return Ordered(alone, key, order, small=small).position("page_no", 1).result()
    gray = gray_frames(frames, key, order, keep=("width", "height"))
    pairs = consecutive_pairs(gray, key, order, ["gray", "width", "height"], small=small)

    def measure(gray, prev, width, height, prev_width, prev_height):
        if gray is None or prev is None:
            return None, None
        b, a = _img(gray, width, -1), _img(prev, prev_width, -1)
        if bounds is None:
            score, rows, _ = K.stitch_overlap(a, b)
            return rows, score
        rows, diff = K.best_overlap(a, b, *bounds)
        return rows, min(1.0, max(0.0, 1.0 - diff / 255.0))

    columns = ["gray", "prev_gray", "width", "height", "prev_width", "prev_height"]
    scored = map_rows(pairs, columns, measure, [("overlap", "int"), ("score", "double")])
    scored = scored.select(*size, "prev_height", "overlap", "score")
    limits = _limits(frames, key, threshold)
    scored = scored.withColumn("threshold", F.lit(threshold)) if limits is None else scored.join(limits, list(key))
    new_page = F.col("score").isNull() | (F.col("score") < F.col("threshold"))
    scored = scored.withColumn("new_page", new_page)
    # The overlap never swallows a whole frame.
    used = F.greatest(F.lit(0), F.least(F.col("overlap"), F.least("prev_height", "height") - 1))
    scored = scored.withColumn("overlap", F.when(F.col("new_page"), F.lit(0)).otherwise(used))
    gain = F.col("prev_height") - F.col("overlap")
    return _offsets(scored, key, order, F.col("new_page"), gain, small).drop("prev_height", "threshold")


class NearSame(Fold):
    columns = ("gray", "gw", "gh")
    outputs = (("keep", "boolean"),)

    def __init__(self, cut: float = C.NEAR_SAME_CUT, min_side: int = C.MIN_NEAR_SAME_SIDE):
        self.cut, self.min_side = cut, min_side

    def step(self, state, gray, gw, gh):
        if gray is None:
            return state, (False,)
        if state is not None:
            a, b = K.common(_img(*state), _img(gray, gw, gh), C.COMPARE_HEIGHT, C.COMPARE_WIDTH)
            if min(a.shape) >= self.min_side and K.mean_abs(a, b) < self.cut:
                return state, (False,)
        return (gray, gw, gh), (True,)


def merge_plan(
    frames: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    *,
    tone: bool = True,
    near_cut: float = C.NEAR_SAME_CUT,
    min_side: int = C.MIN_NEAR_SAME_SIDE,
    bounds: tuple[int, int, int] | None = None,
    accept: float = C.MERGE_ACCEPT,
    gap: int = C.MERGE_GAP,
) -> DataFrame:
    """(key, order, width, height, overlap, y_offset) of the frames of one merged sheet per key.

    Near-same neighbours of the last used frame are dropped; frames without a good
    overlap follow after a white gap. For frames of equal height this equals
    merging into the growing sheet, because the searched tail lies in the last frame.
    """
    small = fits(frames, key)
    gray = gray_frames(frames, key, order, tone=tone)
    kept = ordered_fold(gray, key, order, NearSame(near_cut, min_side), small=small).filter("keep").drop("keep")
    pairs = consecutive_pairs(kept, key, order, ["gray", "gw", "gh"], small=small)

    def measure(gray, gw, gh, prev, pw, ph):
        if prev is None:
            return (None,)
        a, b = _img(prev, pw, ph), _img(gray, gw, gh)
        if bounds is None:
            return (K.merge_overlap(a, b),)
        rows, diff = K.best_overlap(a, b, *bounds)
        return (rows if diff <= accept else 0,)

    found = map_rows(pairs, ["gray", "gw", "gh", "prev_gray", "prev_gw", "prev_gh"], measure, [("overlap", "int")])
    gain = F.col("prev_gh") - F.col("overlap") + F.when(F.col("overlap") == 0, gap).otherwise(0)
    found = found.withColumn("_gain", F.coalesce(gain, F.lit(0)))
    rows = Ordered(found.drop("gray", "prev_gray"), key, order, small=small).running("y_offset", F.col("_gain")).result()
    return rows.select(
        *key, *order, F.col("gw").alias("width"), F.col("gh").alias("height"), F.coalesce("overlap", F.lit(0)).alias("overlap"), "y_offset"
    )


def stitched_sheet_plan(
    frames: DataFrame,
    stitch: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    *,
    tone: bool = True,
    gap: int = C.MERGE_GAP,
) -> DataFrame:
    """(key, order, width, height, overlap, y_offset, new_page): one sheet per key from stitched pages.

    Inside a page frames lie as ``stitch`` (``stitch_plan``) says; a page follows the
    one before by the overlap of their touching frames, or after a white gap.
    """
    key, order = list(key), list(order)
    small = fits(frames, key)
    gray = gray_frames(frames, key, order, tone=tone)
    pairs = consecutive_pairs(gray, key, order, ["gray", "gw", "gh"], small=small)
    pairs = pairs.join(stitch.select(*key, *order, "new_page", F.col("overlap").alias("_stitched")), [*key, *order])

    def measure(gray, gw, gh, prev, pw, ph, new_page):
        if prev is None or gray is None or not new_page:
            return (None,)
        return (K.merge_overlap(_img(prev, pw, ph), _img(gray, gw, gh)),)

    columns = ["gray", "gw", "gh", "prev_gray", "prev_gw", "prev_gh", "new_page"]
    found = map_rows(pairs, columns, measure, [("_merged", "int")])
    overlap = F.when(F.col("prev_gh").isNull(), 0).when(F.col("new_page"), F.coalesce("_merged", F.lit(0))).otherwise(F.col("_stitched"))
    found = found.drop("gray", "prev_gray").withColumn("overlap", overlap.cast("int"))
    space = F.when(F.col("new_page") & (F.col("overlap") == 0), gap).otherwise(0)
    found = found.withColumn("_gain", F.coalesce(F.col("prev_gh") - F.col("overlap") + space, F.lit(0)))
    rows = Ordered(found, key, order, small=small).running("y_offset", F.col("_gain")).result()
    return rows.select(*key, *order, F.col("gw").alias("width"), F.col("gh").alias("height"), "overlap", "y_offset", "new_page")


def compose_rows(
    frames: DataFrame,
    plan: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    *,
    seam: str = "stitch",
) -> DataFrame:
    """(key, page_no, y, row) of the composed sheets; rows blend over the seam of two frames.

    Every output row takes one frame row, or two at a seam. Frames are shuffled once, on (key, order), and meet the
    plan and the last rows of the frame above there; rows are taken apart once, after that, so
    sheets of any height are spread over all tasks.
    """
    paged = "page_no" in plan.columns
    group = [*key, "page_no"] if paged else list(key)
    at = [*key, *order]
    plan = plan.select(*group, *order, "height", "overlap", "y_offset")
    nxt = Ordered(plan, group, order, small=fits(frames, key)).neighbour("next_overlap", F.col("overlap"), 1)
    # Staged: the plan has no pixels and is joined to the frames twice.
    steps = stage(nxt.neighbour("_next", F.struct(*order), 1).result())

    def rows_of(overlap: str):
        o = F.col(overlap)
        size = F.greatest(F.lit(C.STITCH_SEAM_MIN), F.least(o, F.lit(C.STITCH_SEAM_MAX))) if seam == "stitch" else o
        return F.when(o > 0, F.least(size, F.col("height"))).otherwise(F.lit(0))

    steps = steps.withColumns({"_seam": rows_of("overlap"), "_next_seam": F.coalesce(rows_of("next_overlap"), F.lit(0))})
    grids = unpack(frames.select(*at, "px", "width", *(["height"] if dict(frames.dtypes)["px"] == "binary" else []))).select(*at, "px", "width")

    def last(px: Column, values: Column) -> Column:
        held = F.greatest(F.lit(0), F.least(F.size(px), values))
        return F.slice(px, F.greatest(F.lit(1), F.size(px) - held + 1), held)

    # A stitched seam has a greatest height, so only that many rows of a frame travel to the one below.
    tails = grids.withColumn("px", last(F.col("px"), F.col("width") * C.STITCH_SEAM_MAX)) if seam == "stitch" else grids
    tails = tails.join(steps.filter("_next is not null and _next_seam > 0").select(*at, "_next", "_next_seam"), at)
    tails = tails.select(
        *key, *[F.col("_next")[o].alias(o) for o in order], last(F.col("px"), F.col("width") * F.col("_next_seam")).alias("_above"), F.col("width").alias("_above_width")
    )
    placed = grids.join(steps, at).join(tails, at, "left")
    above_rows = F.coalesce(F.size("_above") / F.col("_above_width"), F.lit(0))

    def row(line: Column) -> Column:
        own = F.slice("px", line * F.col("width") + 1, F.col("width"))
        above = F.slice("_above", line * F.col("_above_width") + 1, F.col("_above_width"))
        alpha = F.when(F.col("_seam") > 1, 1.0 - line / (F.col("_seam") - 1)).otherwise(F.lit(1.0))
        mixed = F.zip_with(above, own, lambda a, b: F.greatest(F.lit(0.0), F.least(F.lit(255.0), a * alpha + b * (1.0 - alpha))).cast("int"))
        return F.when((line < F.col("_seam")) & (line < above_rows), mixed).otherwise(own)

    shown = F.col("height") - F.coalesce("next_overlap", F.lit(0))
    lines = F.when(shown > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), shown - 1)), lambda y: F.struct((F.col("y_offset") + y).alias("y"), row(y).alias("row"))))
    return placed.select(*group, F.explode(lines).alias("_line")).select(*group, "_line.y", "_line.row")
