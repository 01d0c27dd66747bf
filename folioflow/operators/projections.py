"""Presets, time ranges, sampling and row validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as C
from folioflow.runs import Ordered


def expand_presets(df: DataFrame, preset: str, *, fps: str | None = None) -> DataFrame:
    """Add the settings of a preset; an explicit fps above 0 wins, unknown names fall back.

    The two tables have three rows each, so broadcasting them is safe at any scale.
    """
    spark = df.sparkSession
    presets = spark.createDataFrame(
        C.PRESETS,
        "_preset string, sensitivity string, stitch boolean, overlap double, upscale boolean, upscale_factor double",
    )
    rates = spark.createDataFrame(C.SENSITIVITY, "sensitivity string, _fps double, dedupe_level string")
    names = [row[0] for row in C.PRESETS]
    known = F.when(F.col(preset).isin(*names), F.col(preset)).otherwise(F.lit("basic"))
    out = df.withColumn("_preset", known).join(F.broadcast(presets), "_preset", "left").drop("_preset")
    out = out.join(F.broadcast(rates), "sensitivity", "left")
    given = F.when(F.col(fps) > 0, F.col(fps)) if fps else F.lit(None).cast("double")
    return out.withColumns(
        {
            "capture_fps": F.coalesce(given, "_fps", F.lit(1.0)),
            "dedupe_level": F.coalesce("dedupe_level", F.lit("normal")),
        }
    ).drop("_fps")


def clip_time_range(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """Rows with start <= ts < end; a bound that is None (or a null column) is open."""

    def bound(value):
        return value if isinstance(value, Column) else F.lit(value)

    if start is not None:
        s = bound(start)
        df = df.filter((F.col(ts) >= s) | s.isNull() if isinstance(start, Column) else F.col(ts) >= s)
    if end is not None:
        e = bound(end)
        df = df.filter((F.col(ts) < e) | e.isNull() if isinstance(end, Column) else F.col(ts) < e)
    return df


def sample_frames(
    df: DataFrame, key: Sequence[str], ts: str, fps: float | Column, *, tie: Sequence[str] = (), fill: bool = False
) -> DataFrame:
    """First row of every slot of 1/fps seconds since the key's first row, with its ``slot``.

    ``ts`` is in seconds; ``fps`` may be a column that is the same for all rows of a key. ``fill`` repeats
    the last row for empty slots.
    """
    key = list(key)
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    payload = F.struct(*[c for c in df.columns if c not in key])
    first = df.groupBy(*key).agg(F.min(ts).alias("_t0"))
    slots = df.join(first, key).withColumn("slot", F.floor((F.col(ts) - F.col("_t0")) * rate))
    picked = slots.groupBy(*key, "slot").agg(F.min_by(payload, F.struct(ts, *tie)).alias("_row"))
    if fill:
        # Each picked row covers the slots up to the next picked one.
        rows = Ordered(picked, key, ["slot"]).neighbour("_next", F.col("slot"), 1).result()
        until = F.coalesce(F.col("_next") - 1, F.col("slot"))
        picked = rows.withColumn("_from", F.col("slot")).withColumn("slot", F.explode(F.sequence("_from", until)))
        return picked.select(*key, "slot", (F.col("slot") != F.col("_from")).alias("filled"), "_row.*")
    return picked.select(*key, "slot", "_row.*")


def _host(url: Column) -> Column:
    """Lower-case host of an address without user, password and port."""
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    place = F.regexp_replace(place, r"^.*@", "")
    return F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1))


def validate_sources(
    df: DataFrame,
    *,
    source_type: str = "source_type",
    path: str = "file_path",
    url: str = "url",
    hosts: Sequence[str] = C.SOURCE_HOSTS,
    exists: Column | None = None,
) -> DataFrame:
    """Add ``source_value`` (trimmed) and ``reason`` (null when the source is fine)."""
    kind = F.col(source_type)
    file_path, address = F.trim(F.coalesce(F.col(path), F.lit(""))), F.trim(F.coalesce(F.col(url), F.lit("")))
    scheme = F.lower(F.regexp_extract(address, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    reason = (
        F.when(~kind.isin("file", "youtube") | kind.isNull(), F.concat(F.lit("unsupported source_type: "), F.coalesce(kind, F.lit(""))))
        .when((kind == "file") & (file_path == ""), F.lit("file_path is required when source_type is file"))
        .when((kind == "file") & ~(exists if exists is not None else F.lit(True)), F.lit("file_path does not exist"))
        .when((kind == "youtube") & (address == ""), F.lit("youtube_url is required when source_type is youtube"))
        .when((kind == "youtube") & ~scheme.isin("http", "https"), F.lit("youtube_url must use http or https"))
        .when((kind == "youtube") & ~_host(address).isin(*hosts), F.lit("youtube_url must point to a supported host"))
    )
    value = F.when(kind == "file", file_path).otherwise(address)
    return df.withColumns({"source_value": F.when(reason.isNull(), value), "reason": reason})


OPTION_RULES = (
    ("end_not_after_start", lambda o: o["end_sec"] <= o["start_sec"]),
    ("start_negative", lambda o: o["start_sec"] < 0),
    ("end_negative", lambda o: o["end_sec"] < 0),
    ("fps_not_positive", lambda o: o["fps"] <= 0),
    ("roi_not_four_points", lambda o: (F.size(o["roi"]) != 4) | F.exists(o["roi"], lambda p: F.size(p) != 2)),
    ("overlap_out_of_range", lambda o: (o["overlap_threshold"] < 0) | (o["overlap_threshold"] > 1)),
    ("scale_out_of_range", lambda o: (o["scale"] < 1) | (o["scale"] > 4)),
    ("scale_needs_more_than_one", lambda o: o["upscale"] & (o["scale"] <= 1)),
    ("format_unknown", lambda o: F.exists(o["formats"], lambda f: ~f.isin(*C.FORMATS))),
)
OPTION_FIELDS = ("start_sec", "end_sec", "fps", "roi", "overlap_threshold", "scale", "upscale", "formats")


def validate_options(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Add ``broken``: names of the broken rules in fixed order. Fields left out are not given (null)."""
    types = {"roi": "array<array<double>>", "formats": "array<string>", "upscale": "boolean"}
    options = {f: fields.get(f, F.lit(None)).cast(types.get(f, "double")) for f in OPTION_FIELDS}
    checks = [F.when(F.coalesce(test(options), F.lit(False)), F.lit(name)) for name, test in OPTION_RULES]
    return df.withColumn("broken", F.array_compact(F.array(*checks)))


def preferred_captures(df: DataFrame, keys: Sequence[str]) -> Column:
    """First non-empty of several array columns, else an empty array."""
    return F.coalesce(*[F.when(F.size(F.col(k)) > 0, F.col(k)) for k in keys], F.array().cast("array<string>"))


def preferred_rows(captures: DataFrame, key: Sequence[str], role: str, roles: Sequence[str]) -> DataFrame:
    """Long form: rows of the most preferred role that a key has at all."""
    rank = F.array_position(F.array(*[F.lit(r) for r in roles]), F.col(role))
    ranked = captures.filter(F.col(role).isin(*roles)).withColumn("_rank", rank)
    best = ranked.groupBy(*key).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [*key, "_rank"], "left_semi").drop("_rank")


def resolve_paths(
    df: DataFrame,
    path: str,
    root: Column,
    *,
    jobs_root: str = "/jobs",
    prefix: str = "jobs-files/",
    suffixes: Sequence[str] = C.CAPTURE_SUFFIXES,
) -> DataFrame:
    """Add ``resolved`` and ``reason``: public prefix stripped, '.' and '..' folded, kept under ``root``."""
    raw = F.trim(F.coalesce(F.col(path), F.lit("")))
    public = F.startswith(raw, F.lit("/" + prefix)) | F.startswith(raw, F.lit(prefix))
    inner = F.regexp_replace(raw, f"^/?{prefix}/*", "")
    full = F.when(public, F.concat(F.lit(jobs_root + "/"), inner)).otherwise(raw)

    def push(done, part):
        up = F.regexp_replace(done, "/[^/]*$", "")
        return F.when(part == "..", up).when(part.isin("", "."), done).otherwise(F.concat(done, F.lit("/"), part))

    resolved = F.aggregate(F.split(full, "/"), F.lit(""), push)
    low = F.lower(resolved)
    known = F.lit(False)
    for suffix in suffixes:
        known = known | F.endswith(low, F.lit("." + suffix))
    out = df.withColumn("_resolved", resolved)
    inside = (F.col("_resolved") == root) | F.startswith(F.col("_resolved"), F.concat(root, F.lit("/")))
    reason = (
        F.when(~inside, F.lit("capture path must be inside this job directory"))
        .when(~known, F.lit("unsupported capture format"))
    )
    return out.withColumns({"resolved": F.when(reason.isNull(), F.col("_resolved")), "reason": reason}).drop("_resolved")
