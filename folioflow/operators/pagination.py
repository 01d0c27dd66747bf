"""Cutting tall sheets into pages from their row-density profiles.

Only profiles (8 bytes per row) are handled here, never pixels. Rows are keyed by
(sheet, y); lookups explode the wanted y values and join on both, so one tall
sheet is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow import constants as C
from folioflow.runs import Fold, Ordered, fits, ordered_fold
from folioflow.session import stage


def _mode(mode: str) -> tuple[str, dict]:
    mode = "performance" if mode == "performance" else "balanced"
    return mode, C.PAGINATION[mode]


def _int(value: Column) -> Column:
    return value.cast("int")


def target_height(width: Column, ratio: float = C.PAGE_RATIO) -> Column:
    return F.greatest(F.lit(900), F.least(F.lit(2600), _int(F.bround(width / F.lit(max(0.35, ratio))))))


def _canvas(width: Column, height: Column, ratio: float) -> dict[str, Column]:
    margin_x = F.greatest(F.lit(10), _int(width * 0.015))
    top = F.greatest(F.lit(14), _int(height * 0.026))
    bottom = F.greatest(F.lit(24), _int(height * 0.056))
    canvas_w = width + margin_x * 2
    canvas_h = F.greatest(top + bottom + 1, _int(F.bround(canvas_w / F.lit(max(0.6, ratio)))))
    inner_w = F.greatest(F.lit(1), canvas_w - margin_x * 2)
    inner_h = F.greatest(F.lit(1), canvas_h - top - bottom)
    scale = F.least(F.lit(1.0), inner_w / width, inner_h / height)
    return dict(canvas_w=canvas_w, canvas_h=canvas_h, margin_x=margin_x, margin_top=top, margin_bottom=bottom, scale=scale)


def page_scale(height: Column, width: Column, ratio: float = C.PAGE_RATIO) -> Column:
    """Scale at which a page of this size would fit its own print canvas; at most 1."""
    return F.when((height <= 0) | (width <= 0), F.lit(1.0)).otherwise(_canvas(width, height, ratio)["scale"])


# --- profile statistics ---------------------------------------------------------------


def density_quantiles(
    profile: DataFrame, key: Sequence[str], probs: dict[str, float], *, value: str = "density", small: bool | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, one column per entry of ``probs``.

    Equal values are counted first, so what is ordered is the distinct values; a
    key with many distinct values is split over runs like any other large key.
    """
    key = list(key)
    counts = profile.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = Ordered(counts, key, [value], small=small).running("_cum", F.col("_n")).result()
    totals = counts.groupBy(*key).agg((F.sum("_n") - 1).alias("_last"))
    ranked = ranked.join(totals, key)
    picks = {}
    for name, prob in probs.items():
        at = F.col("_last") * F.lit(float(prob))
        for end, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks[f"_{name}_{end}"] = F.min(F.when(F.col("_cum") > rank, F.col(value)))
    found = ranked.groupBy(*key, "_last").agg(*[c.alias(n) for n, c in picks.items()])
    out = list(key)
    for name, prob in probs.items():
        at = F.col("_last") * F.lit(float(prob))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*out)


def band_threshold(p72: Column) -> Column:
    return F.greatest(F.lit(0.004), F.least(F.lit(0.03), p72 * 0.34))


def blank_threshold(p28: Column) -> Column:
    return F.greatest(F.lit(0.0025), F.least(F.lit(0.018), p28 * 1.35))


def active_bands(
    profile: DataFrame,
    key: Sequence[str],
    *,
    threshold: Column,
    min_len: Column,
    y: str = "y",
    density: str = "density",
    small: bool | None = None,
) -> DataFrame:
    """(key, band_start, band_end): maximal half-open runs of rows above the threshold."""
    key = list(key)
    active = profile.filter(F.col(density) > threshold).withColumn("_min", min_len)
    placed = Ordered(active, key, [y], small=small).position("_pos").result()
    bands = placed.groupBy(*key, (F.col(y) - F.col("_pos")).alias("_island")).agg(
        F.min(y).alias("band_start"), (F.max(y) + 1).alias("band_end"), F.max("_min").alias("_min")
    )
    return bands.filter(F.col("band_end") - F.col("band_start") >= F.col("_min")).select(*key, "band_start", "band_end")


def boundary_score(
    profile: DataFrame,
    key: Sequence[str],
    *,
    radius: int = C.SEAM_RADIUS,
    y: str = "y",
    density: str = "density",
    block: int = 4096,
) -> DataFrame:
    """Add ``boundary_score``: mean density over [y - radius, y + radius), clipped to the sheet.

    Rows are windowed in blocks of y with a margin of neighbours, not per sheet.
    """
    at = F.floor(F.col(y) / block)
    blocks = F.array_distinct(
        F.array(at, F.floor((F.col(y) - radius + 1) / block), F.floor((F.col(y) + radius) / block))
    )
    wide = profile.withColumn("_own", at).withColumn("_block", F.explode(blocks))
    near = Window.partitionBy(*key, "_block").orderBy(y).rangeBetween(-radius, radius - 1)
    return (
        wide.withColumn("boundary_score", F.avg(density).over(near))
        .filter(F.col("_block") == F.col("_own"))
        .drop("_own", "_block")
    )


def page_gaps(pages: DataFrame, key: Sequence[str], *, max_gap: Column, small: bool | None = None) -> DataFrame:
    """(key, has_gap): does any page start more than ``max_gap`` rows after the one before ends?"""
    rows = Ordered(pages.withColumn("_max", max_gap), key, ["y_start", "y_end"], small=small)
    rows = rows.neighbour("_next", F.col("y_start"), 1).result()
    wide = F.coalesce(F.col("_next") - F.col("y_end") > F.col("_max"), F.lit(False))
    return rows.groupBy(*key).agg(F.bool_or(wide).alias("has_gap"))


# --- packing --------------------------------------------------------------------------


class Pack(Fold):
    columns = ("_s", "_e", "_soft", "_hard", "_under")
    outputs = (("new_page", "boolean"),)

    def step(self, state, s, e, soft, hard, under):
        if state is None:
            return (s, e), (True,)
        first, end = state
        height = e - first
        if height <= soft or (under > 0 and end - first < under and height <= hard):
            return (first, e), (False,)
        return (s, e), (True,)


def pack_bands(
    bands: DataFrame,
    key: Sequence[str],
    *,
    height: Column,
    target: Column,
    mode: str = "performance",
    small: bool | None = None,
) -> DataFrame:
    """(key, range_no, y_start, y_end): padded bands packed greedily into page ranges."""
    key = list(key)
    mode, p = _mode(mode)
    pad = F.greatest(F.lit(6), _int(target * 0.012)) if mode == "performance" else F.greatest(F.lit(8), _int(height * 0.012))
    rows = bands.withColumns(
        {
            "_s": _int(F.greatest(F.lit(0), F.col("band_start") - pad)),
            "_e": _int(F.least(height, F.col("band_end") + pad)),
            "_soft": _int(target * p["soft"]),
            "_hard": _int(target * p["hard"]),
            "_under": _int(target * p["underfill"]),
        }
    )
    small = fits(rows, key) if small is None else small
    packed = ordered_fold(rows, key, ["band_start"], Pack(), small=small)
    packed = Ordered(packed, key, ["band_start"], small=small).running("range_no", F.col("new_page").cast("int")).result()
    return packed.groupBy(*key, (F.col("range_no") - 1).cast("int").alias("range_no")).agg(
        F.min("_s").alias("y_start"), F.max("_e").alias("y_end")
    )


class Separate(Fold):
    columns = ("y_start", "y_end", "_before", "_least")
    outputs = (("_cut", "int"),)

    def step(self, state, start, end, before, least):
        if state is None or before is None or start >= before:
            return start, (None,)
        lo, hi = max(state + 1, start), min(before - 1, end - 1)
        if lo > hi:
            return start, (None,)
        cut = min(max(least, lo), hi) if least is not None else (lo + hi) // 2
        return cut, (cut,)


def resolve_overlaps(
    ranges: DataFrame, profile: DataFrame, key: Sequence[str], *, height: Column, small: bool | None = None
) -> DataFrame:
    """(key, range_no, y_start, y_end) made disjoint: overlapping neighbours part at the least dense row."""
    key = list(key)
    rows = ranges.withColumns({"y_start": F.greatest(F.lit(0), "y_start"), "y_end": _int(F.least(height, F.col("y_end")))})
    rows = rows.filter("y_end > y_start").select(*key, "range_no", "y_start", "y_end")
    small = fits(rows, key) if small is None else small
    rows = stage(Ordered(rows, key, ["range_no"], small=small).neighbour("_before", F.col("y_end")).result())
    shared = rows.filter("y_start < _before").select(
        *key, "range_no", F.explode(F.sequence("y_start", F.col("_before") - 1)).alias("y")
    )
    least = (
        shared.join(profile.select(*key, "y", "density"), [*key, "y"])
        .groupBy(*key, "range_no")
        .agg(F.min_by("y", F.struct("density", "y")).alias("_least"))
    )
    parted = ordered_fold(rows.join(least, [*key, "range_no"], "left"), key, ["range_no"], Separate(), small=small)
    parted = Ordered(parted, key, ["range_no"], small=small).neighbour("_next_cut", F.col("_cut"), 1).result()
    return parted.select(
        *key, "range_no", F.coalesce("_cut", "y_start").alias("y_start"), F.coalesce("_next_cut", "y_end").alias("y_end")
    )


# --- whitespace slicing -----------------------------------------------------------------


class Slice(Fold):
    """One pass down a profile. The state is the current page start and the rows read since
    then, which never exceed one page plus the forward search window."""

    columns = ("y", "density", "_h", "_target", "_blank")
    outputs = (("cuts", "array<int>"),)

    def __init__(self, mode: str):
        _, self.p = _mode(mode)
        self.tight = mode == "performance"

    arrays = True

    def start(self):
        return [0, np.zeros(0), None]

    def _bounds(self, start, h, target):
        p = self.p
        min_h = max(180, int(target * p["min_page"]))
        hard = min(h, start + target)
        lo = max(start + min_h, hard - int(target * p["back"]))
        hi = min(h - 1, hard + int(target * p["forward"]))
        return min_h, hard, lo, hi

    def _due(self, start, h, target):
        """The row at which the page from ``start`` can be cut: all rows that its cut looks at are known."""
        min_h, _, _, hi = self._bounds(start, h, target)
        return min(h - 1, max(hi, start + min_h) + C.SEAM_RADIUS)

    def walk(self, state, columns):
        """From cut to cut: rows are only gathered until the next cut is due."""
        ys, density, hs, targets, blanks = columns
        start, seen, due = state
        h, target, blank = int(hs[0]), int(targets[0]), float(blanks[0])
        cuts, taken = [None] * len(ys), 0
        if due is None:
            start = int(ys[0])  # 0, or the first row of a run whose true start is not known yet
            due = self._due(start, h, target)
        while taken < len(ys):
            at = int(np.searchsorted(ys, due))
            if at >= len(ys):
                break
            at = max(at, taken)
            seen, taken = np.concatenate([seen, density[taken : at + 1]]), at + 1
            here = []
            while ys[at] >= due:
                if min(h, start + target) >= h:
                    here.append(h)
                    due = h
                    break
                cut = self._cut(seen, start, h, target, blank)
                here.append(cut)
                seen, start = seen[cut - start :], cut
                if start >= h:
                    due = h
                    break
                due = self._due(start, h, target)
            cuts[at] = here
        return [start, np.concatenate([seen, density[taken:]]), due], [cuts]

    def _cut(self, rows, start, h, target, blank):
        """The cut below ``start``; ``rows[i]`` is the density of row ``start + i``."""
        p = self.p
        min_h, hard, lo, hi = self._bounds(start, h, target)

        def row(y):
            return rows[min(h - 1, max(0, y)) - start]

        cut = hard
        if hard > lo:
            back = rows[lo - start : hard - start]
            blanks = np.nonzero(back <= blank * 0.96)[0] if self.tight else ()
            early = lo + int(blanks[-1] if len(blanks) else back.argmin())
            if row(early) <= blank * p["back_blank"] or row(early) < row(hard - 1) * p["back_ratio"]:
                cut = early
        edge = row(cut - 1)
        if (cut - start < min_h or edge > blank * 1.25) and hi > hard:
            late = hard + int(rows[hard - start : hi + 1 - start].argmin())
            if row(late) <= edge * 0.94:
                cut = late
        cut = min(max(cut, start + min_h), h)
        if cut <= start:
            cut = min(h, start + target)
        if row(cut - 1) > blank * 1.12:
            near = np.nonzero(rows[lo - start : max(lo, hi + 1) - start] <= blank)[0] + lo
            if near.size:
                if self.tight:
                    close = near[near >= max(start + min_h, hard - int(target * 0.09))]
                    near = close if close.size else near
                pick = int(near[np.abs(near - hard).argmin()])
                if pick - start >= max(96, int(min_h * 0.42)):
                    cut = pick
        return self._clearer(rows, cut, start, hard, lo, hi, min_h, h)

    @staticmethod
    def _clearer(rows, cut, start, hard, lo, hi, min_h, h):
        """A nearby seam with a clearly lower mean density, when the chosen one is dense."""
        cut = int(min(max(cut, start + 1), h))
        if cut - start < min_h:
            return cut

        def seam(y):
            return float(rows[max(0, y - C.SEAM_RADIUS) - start : min(h, y + C.SEAM_RADIUS) - start].mean())

        now = seam(cut)
        lo, hi = max(start + min_h, lo), min(h - 1, hi)
        if now <= C.SEAM_CLEAR or hi <= lo:
            return cut
        at, best = cut, now + abs(cut - hard) * C.SEAM_DISTANCE
        for y in range(lo, hi + 1):
            score = seam(y) + abs(y - hard) * C.SEAM_DISTANCE
            if score < best:
                at, best = y, score
        return at if best < now * C.SEAM_GAIN else cut


def slice_by_whitespace(
    profile: DataFrame,
    key: Sequence[str],
    *,
    target: Column,
    mode: str = "performance",
    width: Column | None = None,
    ratio: float | None = None,
    small: bool | None = None,
) -> DataFrame:
    """(key, page_index, y_start, y_end): pages near the target height, cut at whitespace.

    ``profile`` holds every row y = 0..h-1 of a key; ``target`` and ``width`` may use its columns.
    """
    key = list(key)
    rows = profile.withColumns({"_target": _int(target), "_w": _int(width) if width is not None else F.lit(0)})
    facts = rows.groupBy(*key).agg(
        _int(F.max("y") + 1).alias("_h"), F.max("_target").alias("_target"), F.max("_w").alias("_w")
    )
    small = fits(profile, key) if small is None else small
    blanks = density_quantiles(profile, key, {"_p28": 0.28}, small=small).withColumn("_blank", blank_threshold(F.col("_p28")))
    facts = facts.join(blanks.drop("_p28"), key)
    walked = ordered_fold(
        rows.select(*key, "y", "density").join(facts, key), key, ["y"], Slice(mode), small=small
    )
    # Staged: one row per page, read again for the neighbours and for the tail.
    ends = stage(walked.filter(F.size("cuts") > 0).select(*key, "_h", "_target", "_w", F.explode("cuts").alias("y_end")))
    pages = Ordered(ends, key, ["y_end"], small=small).neighbour("_above", F.col("y_end")).position("page_index").result()
    pages = pages.withColumn("y_start", F.coalesce("_above", F.lit(0)))
    return merge_short_tail(
        pages, key, target=F.col("_target"), mode=mode, ratio=ratio, width=F.col("_w"), height=F.col("_h")
    )


def merge_short_tail(
    pages: DataFrame,
    key: Sequence[str],
    *,
    target: Column,
    mode: str = "performance",
    height: Column,
    ratio: float | None = None,
    width: Column | None = None,
) -> DataFrame:
    """(key, page_index, y_start, y_end) after merging short last pages into the page before.

    ``pages`` tile [0, height). Only pages that start a full merge can touch, those
    with less than one minimum tail below their end, are gathered: at most one per row of that tail.
    """
    key = list(key)
    mode, p = _mode(mode)
    tail = F.greatest(F.lit(84), _int(target * p["tail"]))
    hard, soft = _int(target * p["tail_hard"]), _int(target * p["tail_soft"])
    rows = pages.withColumns(
        {"_h": _int(height), "_tail": tail, "_hard": hard, "_soft": soft, "_w": _int(width) if width is not None else F.lit(0)}
    )
    last = rows.filter(F.col("_h") - F.col("y_end") < F.col("_tail"))
    gathered = last.groupBy(*key, "_h", "_tail", "_hard", "_soft", "_w").agg(
        F.sort_array(F.collect_list(F.struct("y_start", "y_end")), asc=False).alias("_pages")
    )

    def climb(state, page):
        low = F.col("_h") - state["start"]
        both = F.col("_h") - page["y_start"]
        fits = (both <= F.col("_hard")) | ((low <= _int(F.col("_tail") * 0.62)) & (both <= F.col("_soft")))
        if ratio is not None:
            fits = fits & (page_scale(both, F.col("_w"), ratio) >= p["single"])
        going = state["going"] & (low < F.col("_tail")) & fits
        return F.struct(
            F.when(going, page["y_start"]).otherwise(state["start"]).alias("start"), going.alias("going")
        )

    first = F.struct(F.col("_pages")[0]["y_start"].alias("start"), F.lit(True).alias("going"))
    rest = F.slice("_pages", F.lit(2), F.greatest(F.size("_pages") - 1, F.lit(0)))
    merged = gathered.select(*key, F.aggregate(rest, first, climb)["start"].alias("_tail_start"))
    joined = rows.join(merged, key).filter(F.col("y_start") <= F.col("_tail_start"))
    end = F.when(F.col("y_start") == F.col("_tail_start"), F.col("_h")).otherwise(F.col("y_end"))
    return joined.select(*key, "page_index", "y_start", end.alias("y_end"))


# --- the whole decision -----------------------------------------------------------------


def split_pages(
    profile: DataFrame,
    sheets: DataFrame,
    key: Sequence[str],
    *,
    mode: str = "performance",
    ratio: float = C.PAGE_RATIO,
    target: Column | None = None,
) -> DataFrame:
    """(key, page_index, y_start, y_end) of every sheet.

    ``sheets`` has (key, width, height). A sheet that fits one page stays whole; else
    bands are packed into pages; when that would drop rows, or there are no bands, or
    the only page is too tall, the sheet is sliced at whitespace; oversized pages are
    sliced again.
    """
    key = list(key)
    mode, p = _mode(mode)
    sheets = sheets.select(*key, "width", "height").withColumn("_target", _int(target) if target is not None else target_height(F.col("width"), ratio))
    scale = page_scale(F.col("height"), F.col("width"), ratio)
    single = sheets.filter(scale >= p["single"])
    tall = sheets.filter(scale < p["single"])

    body = profile.select(*key, "y", "density").join(tall, key)
    # Distinct densities, bands, ranges and pages of a sheet are never more than its rows: one count serves all.
    small = fits(profile, key)
    cuts = density_quantiles(body, key, {"_p72": 0.72}, small=small).withColumn("_cut", band_threshold(F.col("_p72")))
    bands = active_bands(
        body.join(cuts, key),
        key,
        threshold=F.col("_cut"),
        min_len=F.greatest(F.lit(6), _int(F.col("height") * 0.004)),
        small=small,
    )
    banded = bands.join(tall, key)
    ranges = pack_bands(banded, key, height=F.col("height"), target=F.col("_target"), mode=mode, small=small)
    ranges = resolve_overlaps(ranges.join(tall, key), body, key, height=F.col("height"), small=small)
    # Staged: a few rows per sheet, read by every check below.
    ranges = stage(ranges.join(tall, key))

    gap = F.greatest(F.lit(6), _int(F.col("_target") * 0.004))
    checks = page_gaps(ranges, key, max_gap=gap, small=small)
    oversize = F.col("y_end") - F.col("y_start") > _int(F.col("_target") * C.OVERSIZE)
    alone = ranges.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_or(oversize).alias("_over"),
        F.max(page_scale(F.col("y_end") - F.col("y_start"), F.col("width"), ratio)).alias("_scale"),
    )
    lone = (F.col("_n") == 1) & ~F.col("_over") & (F.col("_scale") < p["single"])
    verdict = checks.join(alone, key).withColumn("_whole", F.col("has_gap") | lone).select(*key, "_whole")

    good = ranges.join(verdict.filter(~F.col("_whole")).select(*key), key, "left_semi")
    kept = good.filter(~oversize).select(*key, "y_start", "y_end")
    whole = tall.join(verdict, key, "left").filter(F.coalesce("_whole", F.lit(True)))
    parts = whole.select(*key, "width", "_target", F.lit(0).alias("_from"), F.col("height").alias("_to")).unionByName(
        good.filter(oversize).select(*key, "width", "_target", F.col("y_start").alias("_from"), F.col("y_end").alias("_to"))
    )
    # A row belongs to the last part that starts at or above it: part starts are marked among the rows and counted down the sheet.
    parts = stage(Ordered(parts, key, ["_from"], small=small).position("_part", 1).result())
    marks = parts.select(*key, F.col("_from").alias("y"), F.lit(None).cast("double").alias("density"), F.lit(1).alias("_start"))
    rows = profile.select(*key, "y", "density", F.lit(0).alias("_start")).join(parts.select(*key).distinct(), key, "left_semi").unionByName(marks)
    counted = Ordered(rows.withColumn("_after", 1 - F.col("_start")), key, ["y", "_after"], small=small).running("_part", F.col("_start")).result()
    owned = counted.filter("_start = 0").select(*key, "_part", "y", "density").join(parts, [*key, "_part"])
    pieces = owned.filter(F.col("y") < F.col("_to")).withColumn("y", F.col("y") - F.col("_from")).drop("_to", "_part")
    pieces = stage(pieces)
    sliced = slice_by_whitespace(
        pieces, [*key, "_from"], target=F.col("_target"), mode=mode, width=F.col("width"), ratio=ratio, small=small
    )
    sliced = sliced.select(*key, (F.col("y_start") + F.col("_from")).alias("y_start"), (F.col("y_end") + F.col("_from")).alias("y_end"))
    pages = single.select(*key, F.lit(0).alias("y_start"), F.col("height").alias("y_end")).unionByName(kept).unionByName(sliced)
    return Ordered(pages, key, ["y_start"], small=small).position("page_index").result().select(*key, "page_index", "y_start", "y_end")


def frame_pages(pages: DataFrame, key: Sequence[str], *, ratio: float = C.PAGE_RATIO) -> DataFrame:
    """Add the uniform print canvas of a page set and each page's place on it.

    ``pages`` has (key, width, height) per page.
    """
    key = list(key)
    largest = pages.groupBy(*key).agg(F.max("width").alias("_w"), F.max("height").alias("_h"))
    canvas = largest.select(*key, *[v.alias(n) for n, v in _canvas(F.col("_w"), F.col("_h"), ratio).items()])
    rows = pages.join(canvas, key)
    scale = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("scale")))

    def side(name):
        return F.when(scale < 0.999, F.greatest(F.lit(1), _int(F.bround(F.col(name) * scale)))).otherwise(F.col(name))

    rows = rows.withColumns({"draw_w": side("width"), "draw_h": side("height")})
    usable = F.greatest(F.lit(1), F.col("canvas_w") - F.col("margin_x") * 2)
    x0 = F.col("margin_x") + F.greatest(F.lit(0), _int(F.floor((usable - F.col("draw_w")) / 2)))
    low = F.col("canvas_h") - F.col("margin_bottom") - F.col("draw_h")
    y0 = F.when(F.col("margin_top") > low, F.greatest(F.col("margin_top"), low)).otherwise(F.col("margin_top"))
    return rows.withColumns({"x0": x0, "y0": y0})


def page_diagnostics(profile: DataFrame, pages: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, page_index, top_edge_density, bottom_edge_density, suspicious, warning_reasons)."""
    key = list(key)
    edge = F.least(F.lit(C.PAGE_EDGE_ROWS), F.col("y_end") - F.col("y_start"))
    bands = F.array(
        F.struct(F.lit("top").alias("edge"), F.sequence("y_start", F.col("y_start") + edge - 1).alias("ys")),
        F.struct(F.lit("bottom").alias("edge"), F.sequence(F.col("y_end") - edge, F.col("y_end") - 1).alias("ys")),
    )
    wanted = pages.select(*key, "page_index", F.inline(bands)).withColumn("y", F.explode("ys")).drop("ys")
    means = (
        wanted.join(profile.select(*key, "y", "density"), [*key, "y"])
        .groupBy(*key, "page_index")
        .agg(
            F.avg(F.when(F.col("edge") == "top", F.col("density"))).alias("_top"),
            F.avg(F.when(F.col("edge") == "bottom", F.col("density"))).alias("_bottom"),
        )
    )
    return _verdict(means, key)


def canvas_diagnostics(profile: DataFrame, framed: DataFrame, key: Sequence[str]) -> DataFrame:
    """The diagnostics of pages as printed; page_index counts from 1.

    ``framed`` has the place of each page on its canvas (``frame_pages``) and y_start.
    Canvas rows beside the page are blank, and a density is a share of the canvas width.
    """
    key = list(key)
    edge = F.least(F.lit(C.PAGE_EDGE_ROWS), F.col("canvas_h"))
    end = F.least(F.col("y0") + F.col("draw_h"), F.col("canvas_h"))

    def rows(first, last):
        return F.when(first < last, F.sequence(first, last - 1)).otherwise(F.array().cast("array<int>"))

    bands = F.array(
        F.struct(F.lit("top").alias("edge"), rows(F.col("y0"), F.least(end, edge)).alias("ys")),
        F.struct(F.lit("bottom").alias("edge"), rows(F.greatest(F.col("y0"), F.col("canvas_h") - edge), end).alias("ys")),
    )
    placed = framed.select(
        *key, "page_index", "y_start", "height", "y0", "draw_h", edge.alias("_rows"),
        (F.col("draw_w") / F.col("canvas_w")).alias("_share"), F.inline(bands),
    ).withColumn("_line", F.explode("ys"))
    source = F.floor((F.col("_line") - F.col("y0")) * F.col("height") / F.col("draw_h"))
    placed = placed.withColumn("y", (F.col("y_start") + source).cast("int"))
    met = placed.join(profile.select(*key, "y", "density"), [*key, "y"])
    ink = F.col("density") * F.col("_share") / F.col("_rows")
    sums = met.groupBy(*key, "page_index").agg(
        F.sum(F.when(F.col("edge") == "top", ink)).alias("_top"), F.sum(F.when(F.col("edge") == "bottom", ink)).alias("_bottom")
    )
    means = framed.select(*key, "page_index").join(sums, [*key, "page_index"], "left")
    zero = F.lit(0.0)
    means = means.withColumns({"_top": F.coalesce("_top", zero), "_bottom": F.coalesce("_bottom", zero), "page_index": F.col("page_index") + 1})
    return _verdict(means, key)


def _verdict(means: DataFrame, key: Sequence[str]) -> DataFrame:
    top, bottom = F.col("_top") > C.PAGE_EDGE_CUT, F.col("_bottom") > C.PAGE_EDGE_CUT
    reasons = F.array_compact(F.array(F.when(top, F.lit("top_edge_busy")), F.when(bottom, F.lit("bottom_edge_busy"))))
    return means.select(
        *key,
        "page_index",
        F.bround("_top", 5).alias("top_edge_density"),
        F.bround("_bottom", 5).alias("bottom_edge_density"),
        (top | bottom).alias("suspicious"),
        reasons.alias("warning_reasons"),
    )
