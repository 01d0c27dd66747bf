"""Region-of-interest geometry as Column functions on ARRAY<ARRAY<DOUBLE>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import constants as C
from folioflow.functions.numbers import try_number


def _axis(roi: Column, i: int) -> Column:
    return F.transform(roi, lambda p: p[i])


def _edge(a: Column, b: Column) -> Column:
    dx, dy = a[0] - b[0], a[1] - b[1]
    return F.sqrt(dx * dx + dy * dy)


def order_roi_points(roi: Column) -> Column:
    """Top-left, top-right, bottom-right, bottom-left; the first point wins a tie."""
    total = F.transform(roi, lambda p: p[0] + p[1])
    slope = F.transform(roi, lambda p: p[1] - p[0])

    def at(values: Column, extreme) -> Column:
        return F.element_at(roi, F.array_position(values, extreme(values)).cast("int"))

    return F.array(at(total, F.array_min), at(slope, F.array_min), at(total, F.array_max), at(slope, F.array_max))


def roi_large_enough(ordered: Column) -> Column:
    """False when the summed widths or heights of an ordered region are at most 2."""
    tl, tr, br, bl = (ordered[i] for i in range(4))
    return ((_edge(tl, tr) + _edge(br, bl)) > 2.0) & ((_edge(tl, bl) + _edge(tr, br)) > 2.0)


def roi_rect(roi: Column, width: Column, height: Column) -> Column:
    """Whole-pixel rectangle clamped into the frame, at least one pixel each way."""
    xs, ys = _axis(roi, 0), _axis(roi, 1)

    def low(values, size):
        return F.greatest(F.lit(0), F.least(size - 1, F.bround(F.array_min(values)).cast("int")))

    def high(values, size, first):
        return F.greatest(first + 1, F.least(size, F.bround(F.array_max(values)).cast("int")))

    x1, y1 = low(xs, width), low(ys, height)
    return F.struct(
        x1.alias("x1"), y1.alias("y1"), high(xs, width, x1).alias("x2"), high(ys, height, y1).alias("y2")
    )


def crop_box(roi: Column, width: Column, height: Column, min_side: int = 16) -> Column:
    """Struct(x1, y1, x2, y2, reason); reason is null when the crop can be made."""

    def inside(values, size):
        return F.transform(values, lambda v: F.greatest(F.lit(0.0), F.least(size.cast("double"), v)))

    xs, ys = inside(_axis(roi, 0), width), inside(_axis(roi, 1), height)
    sides = [F.bround(f(v)).cast("int") for f in (F.array_min, F.array_max) for v in (xs, ys)]
    x1, y1, x2, y2 = sides
    reason = (
        F.when(roi.isNull() | (F.size(roi) != 4), F.lit("roi must be 4 points: [[x,y], ...]"))
        .when(F.exists(roi, lambda p: F.size(p) != 2), F.lit("each roi point must be [x, y]"))
        .when(
            F.exists(roi, lambda p: F.exists(p, lambda v: v.isNull() | F.isnan(v))),
            F.lit("roi includes invalid number"),
        )
        .when(((x2 - x1) < min_side) | ((y2 - y1) < min_side), F.lit("roi is too small for capture crop"))
    )
    fine = reason.isNull()
    return F.struct(
        *[F.when(fine, v).alias(n) for n, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))],
        reason.alias("reason"),
    )


def parse_roi(text: Column) -> Column:
    """JSON text of four [x, y] points of finite numbers, else null."""
    raw = F.from_json(F.trim(text), "array<array<string>>")
    points = F.transform(raw, lambda p: F.transform(p, try_number))

    def fine(roi: Column) -> Column:
        return (F.size(roi) == 4) & F.forall(roi, lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull()))

    # As an array of one, so that the text is parsed once and not for every use of the points.
    return F.get(F.filter(F.array(points), fine), 0)


def infer_layout(hint: Column, roi: Column, stitch: Column, source_type: Column) -> Column:
    """An explicit hint wins; a strip-shaped region, stitching, then the source type decide."""
    width = F.array_max(_axis(roi, 0)) - F.array_min(_axis(roi, 0))
    height = F.array_max(_axis(roi, 1)) - F.array_min(_axis(roi, 1))
    fallback = F.when(source_type == "youtube", F.lit("bottom_bar")).otherwise(F.lit("full_scroll"))
    usable = F.coalesce((F.size(roi) == 4) & (width > 2) & (height > 2), F.lit(False))
    return (
        F.when(hint.isin(*C.LAYOUTS), hint)
        .when(~usable, fallback)
        .when(width / F.greatest(F.lit(1.0), height) >= 2.25, F.lit("bottom_bar"))
        .when(stitch, F.lit("full_scroll"))
        .otherwise(fallback)
    )


def resolve_layout(hint: Column, source_type: Column, prefer_bottom: Column | None = None) -> Column:
    """Layout of a stitch step whose hint may be 'auto'."""
    out = F.when(hint.isin(*C.LAYOUTS), hint)
    if prefer_bottom is not None:
        out = out.when(prefer_bottom, F.lit("bottom_bar")).when(~prefer_bottom, F.lit("full_scroll"))
    return out.when(source_type == "youtube", F.lit("bottom_bar")).otherwise(F.lit("full_scroll"))


def inherit_hint(stitch_hint: Column, detect_hint: Column) -> Column:
    """A stitch hint of 'auto' takes the detection hint."""
    return F.when((stitch_hint == "auto") & (detect_hint != "auto"), detect_hint).otherwise(stitch_hint)


def roi_issues(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Codes of the geometry issues of a region drawn on a canvas, in fixed order."""
    w = (x2 - x1) / F.greatest(F.lit(1.0), width)
    h = (y2 - y1) / F.greatest(F.lit(1.0), height)
    top = y1 / F.greatest(F.lit(1.0), height)
    bottom = (height - y2) / F.greatest(F.lit(1.0), height)
    rules = [
        (w < 0.34, "width_low"),
        (w > 0.96, "width_high"),
        (h < 0.18, "height_low"),
        (h > 0.88, "height_high"),
        ((top < 0.015) | (bottom < 0.015), "margin_tight"),
        (top > 0.32, "top_margin_high"),
        (bottom > 0.32, "bottom_margin_high"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in rules]))
