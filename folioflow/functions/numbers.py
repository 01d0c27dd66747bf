"""Numeric Column functions: rounding rules, clamps, thresholds, sizes, progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import constants as C

_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_HEX = r"^0[xX][0-9a-fA-F]+$"


def col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def clamp(value: Column, low, high) -> Column:
    """max(low, min(high, value))"""
    return F.greatest(col(low), F.least(col(high), value))


def half_up(value: Column) -> Column:
    """Round half towards plus infinity to a whole number."""
    return F.floor(value + F.lit(0.5))


def truncate(value: Column) -> Column:
    return value.cast("int")


def round_tenth(value: Column) -> Column:
    return F.floor(value * 10.0 + 0.5) / 10.0


def _hex_double(digits: Column) -> Column:
    """The double nearest to a hexadecimal number of any length.

    The first 15 digits fill the mantissa and more; whether anything follows only
    decides ties, so it is kept as one sticky bit.
    """
    digits = F.ltrim(digits, F.lit("0"))
    rest = F.greatest(F.length(digits) - 15, F.lit(0))
    sticky = F.when(F.substr(digits, F.lit(16)).rlike("[1-9a-fA-F]"), 1).otherwise(0).cast("bigint")
    head = F.coalesce(F.conv(F.nullif(F.substring(digits, 1, 15), F.lit("")), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))
    return head.bitwiseOR(sticky).cast("double") * F.pow(F.lit(16.0), rest)


def try_number(text: Column) -> Column:
    """Trimmed text as a finite double, else null. Type suffixes and named specials are not numbers."""
    text = F.trim(text)
    value = F.when(text.rlike(_DECIMAL), text.cast("double")).when(text.rlike(_HEX), _hex_double(F.substr(text, F.lit(3))))
    # As an array of one: the number is made once, also inside lambdas, where Spark shares no common expressions.
    return F.get(F.filter(F.array(value), lambda v: F.abs(v) < F.lit(float("inf"))), 0)


def human_bytes(size: Column) -> Column:
    """B, KB, MB, GB, TB in steps of 1024: whole bytes, else one decimal."""
    size = F.greatest(size.cast("bigint"), F.lit(0))
    text = F.format_string("%d B", size)
    out = F.when(size < 1024, text)
    for power, unit in enumerate(("KB", "MB", "GB"), start=1):
        scaled = F.bround(size.cast("double") / F.lit(float(1024**power)), 1)
        out = out.when(size < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", scaled))
    return out.otherwise(F.format_string("%.1f TB", F.bround(size.cast("double") / F.lit(float(1024**4)), 1)))


def mmss(seconds: Column) -> Column:
    """MM:SS.s; '-' for null, negative or non-finite. Tenths may read 60.0, as in 00:59.96."""
    minutes = F.floor(seconds / 60.0)
    tenths = F.floor((seconds - minutes * 60.0) * 10.0 + 0.5).cast("bigint")
    text = F.concat(
        _pad2(minutes.cast("string")),
        F.lit(":"),
        _pad2((tenths - F.pmod(tenths, F.lit(10))).cast("double").__truediv__(10.0).cast("bigint").cast("string")),
        F.lit("."),
        F.pmod(tenths, F.lit(10)).cast("string"),
    )
    bad = seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == F.lit(float("inf")))
    return F.when(bad, F.lit("-")).otherwise(text)


def _pad2(text: Column) -> Column:
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def level_threshold(level: Column, values) -> Column:
    """Pick from an (aggressive, normal, sensitive) row; normal is the default."""
    aggressive, normal, sensitive = (F.lit(v) for v in values)
    return F.when(level == "aggressive", aggressive).when(level == "sensitive", sensitive).otherwise(normal)


def scroll_minimum(level: Column) -> Column:
    return level_threshold(level, C.SCROLL_MIN)


def effective_overlap(raw: Column, layout: Column) -> Column:
    raw = clamp(raw, 0.0, 1.0)

    def line(base, slope, low, high):
        return F.greatest(F.lit(low), F.least(F.lit(high), F.lit(base) + raw * F.lit(slope)))

    out = None
    for name, row in C.EFFECTIVE_OVERLAP.items():
        out = F.when(layout == name, line(*row)) if out is None else out.when(layout == name, line(*row))
    return out.otherwise(line(*C.EFFECTIVE_OVERLAP_OTHER))


def page_turn_similarity(overlap: Column) -> Column:
    return F.greatest(F.lit(0.88), F.least(F.lit(0.98), F.lit(1.0) - overlap * 0.25))


def pipeline_index(step: Column, progress: Column, remote: Column) -> Column:
    """0 download, 1 extract, 2 detect, 3 rectify, 4 upscale, 5 export."""
    step = F.lower(F.coalesce(step, F.lit("")))
    share = F.when(progress.isNull() | F.isnan(progress), F.lit(0.0)).otherwise(progress)
    return (
        F.when(step == "done", F.lit(5))
        .when(step.isin("initializing", "queued"), F.when(remote, F.lit(0)).otherwise(F.lit(1)))
        .when(step == "detecting", F.when(share < 0.36, F.lit(1)).otherwise(F.lit(2)))
        .when(step.isin("rectifying", "stitching"), F.lit(3))
        .when(step == "upscaling", F.lit(4))
        .when(step == "exporting", F.lit(5))
        .otherwise(F.lit(0))
    )


def percent(ratio: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(ratio * 100.0))).cast("int")


def target_side(side: Column, scale: Column) -> Column:
    return F.greatest(F.lit(2), F.bround(side * scale).cast("int"))


def pdf_side(side: Column, width: Column, height: Column, max_edge: int = C.PDF_MAX_EDGE) -> Column:
    """Side after fitting the long edge into ``max_edge``."""
    long_edge = F.greatest(width, height)
    scaled = F.greatest(F.lit(1), F.bround(side * (F.lit(float(max_edge)) / long_edge)).cast("int"))
    return F.when(long_edge > max_edge, scaled).otherwise(side)
