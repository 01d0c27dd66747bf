"""Grouped facts: region health, caches, renditions, attempts, reviews, representatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow import constants as C
from folioflow import messages as M
from folioflow.functions.numbers import human_bytes


def _finding(level, code: str, hits: Column | None = None) -> Column:
    title, detail = M.ROI_FINDINGS[code]
    text = F.lit(detail)
    if hits is not None:
        before, after = detail.split("{hits}")
        text = F.concat(F.lit(before), hits.cast("string"), F.lit(after))
    level = level if isinstance(level, Column) else F.lit(level)
    return F.struct(level.alias("level"), F.lit(code).alias("code"), F.lit(title).alias("title"), text.alias("detail"))


def roi_health(measures: DataFrame, rects: DataFrame, key: Sequence[str]) -> DataFrame:
    """Health of each source's region from its sampled frames.

    ``measures`` (key, density, top_density, bottom_density) has one row per sampled
    frame; ``rects`` (key, width, height, x1, y1, x2, y2) one row per source.
    """
    key = list(key)
    hit = {
        "top_edge_hits": F.col("top_density") > C.EDGE_HIT,
        "bottom_edge_hits": F.col("bottom_density") > C.EDGE_HIT,
        "low_density_hits": F.col("density") < C.SPARSE,
    }
    seen = measures.groupBy(*key).agg(
        F.count("density").alias("sampled_frames"),
        F.avg("density").alias("_density"),
        *[F.count_if(test).alias(name) for name, test in hit.items()],
    )
    rows = rects.join(seen, key, "left").fillna(0, ["sampled_frames", "_density", *hit])
    w = F.greatest(F.lit(1), F.col("x2") - F.col("x1")) / F.greatest(F.lit(1), F.col("width"))
    h = F.greatest(F.lit(1), F.col("y2") - F.col("y1")) / F.greatest(F.lit(1), F.col("height"))
    top = F.col("y1") / F.greatest(F.lit(1), F.col("height"))
    bottom = (F.col("height") - F.col("y2")) / F.greatest(F.lit(1), F.col("height"))
    rows = rows.withColumns({"_w": w, "_h": h, "_top": top, "_bottom": bottom})
    most = F.greatest(F.lit(1), F.col("sampled_frames") - 1)

    def busy(name):
        return F.when(F.col(name) >= most, F.lit("critical")).otherwise(F.lit("warning"))

    findings = F.array_compact(
        F.array(
            F.when(F.col("_w") < 0.34, _finding("warning", "roi_width_low")).when(
                F.col("_w") > 0.96, _finding("warning", "roi_width_high")
            ),
            F.when(F.col("_h") < 0.18, _finding("warning", "roi_height_low")).when(
                F.col("_h") > 0.88, _finding("warning", "roi_height_high")
            ),
            F.when((F.col("_top") < 0.015) | (F.col("_bottom") < 0.015), _finding("critical", "roi_margin_tight")),
            F.when(F.col("top_edge_hits") > 0, _finding(busy("top_edge_hits"), "top_edge_busy", F.col("top_edge_hits"))),
            F.when(
                F.col("bottom_edge_hits") > 0,
                _finding(busy("bottom_edge_hits"), "bottom_edge_busy", F.col("bottom_edge_hits")),
            ),
            F.when(F.col("low_density_hits") >= most, _finding("warning", "content_sparse")),
        )
    )
    some = F.col("sampled_frames") > 0
    rows = rows.withColumn("_found", findings)
    none_found = F.array(_finding("info", "roi_healthy"))
    rows = rows.withColumn(
        "diagnostics",
        F.when(~some, F.slice(none_found, 1, 0)).when(F.size("_found") == 0, none_found).otherwise(F.col("_found")),
    )

    def has(level):
        return F.exists("diagnostics", lambda d: d["level"] == level)

    risk = F.when(has("critical"), F.lit("critical")).when(has("warning"), F.lit("warning")).otherwise(F.lit("info"))
    before, after = M.ROI_SUMMARY.split("{n}")
    summary = F.when(some, F.concat(F.lit(before), F.col("sampled_frames").cast("string"), F.lit(after))).otherwise(
        F.lit(M.ROI_SUMMARY_EMPTY)
    )

    def metric(name):
        return F.when(some, F.bround(name, 5))

    return rows.select(
        *key,
        risk.alias("risk_level"),
        summary.alias("summary"),
        "diagnostics",
        "sampled_frames",
        metric("_w").alias("width_ratio"),
        metric("_h").alias("height_ratio"),
        metric("_top").alias("top_margin_ratio"),
        metric("_bottom").alias("bottom_margin_ratio"),
        metric("_density").alias("average_content_density"),
        *hit,
    )


def cache_usage(assets: DataFrame, *, child: str = "child", size: str = "length") -> DataFrame:
    """(child, files, total_bytes, total_paths, total_human) per top-level child and, with child null, in total."""
    usage = assets.groupBy(child).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("total_bytes"))
    total = usage.agg(
        F.sum("files").alias("files"), F.sum("total_bytes").alias("total_bytes"), F.count(F.lit(1)).alias("total_paths")
    ).select(F.lit(None).cast("string").alias(child), "files", "total_bytes", "total_paths")
    out = usage.withColumn("total_paths", F.lit(1).cast("bigint")).unionByName(total)
    out = out.withColumn("total_bytes", F.greatest(F.lit(0), F.coalesce("total_bytes", F.lit(0))))
    return out.withColumn("total_human", human_bytes(F.col("total_bytes")))


ACTIVE = ("queued", "running")


def reclaim_plan(
    assets: DataFrame, jobs: DataFrame, *, mode: str = "global", child: str = "child", owner: str = "job_id", size: str = "length"
) -> DataFrame:
    """(child, reclaimed_bytes, reclaimed_human) of what may be cleared.

    'global': nothing while any job is active. 'owner': children without an active job of their own.
    """
    usage = assets.groupBy(child).agg(F.sum(size).alias("reclaimed_bytes"))
    active = jobs.filter(F.col("status").isin(*ACTIVE))
    if mode == "global":
        free = usage.filter(~active.select(owner).exists())
    else:
        free = usage.join(active.select(F.col(owner).alias(child)).distinct(), child, "left_anti")
    return free.withColumn("reclaimed_human", human_bytes(F.col("reclaimed_bytes")))


def low_quality(width: Column, height: Column) -> Column:
    return F.when(height > 0, height <= C.LOW_HEIGHT).when(width > 0, width <= C.LOW_WIDTH).otherwise(F.lit(False))


def best_rendition(
    files: DataFrame, key: Sequence[str], *, path: str = "path", suffix: Column | None = None
) -> DataFrame:
    """(key, path, width, height, status): highest (height, width, mtime); 'rejected' when of low quality."""
    rows = files if suffix is None else files.filter(suffix.isin(*C.VIDEO_SUFFIXES))
    best = rows.groupBy(*key).agg(
        F.max_by(F.struct(path, "width", "height"), F.struct("height", "width", "mtime", path)).alias("_best")
    )
    best = best.select(*key, "_best.*")
    status = F.when(low_quality(F.col("width"), F.col("height")), F.lit("rejected")).otherwise(F.lit("hit"))
    return best.withColumn("status", status)


def rendition_status(requests: DataFrame, files: DataFrame, key: Sequence[str], **kwargs) -> DataFrame:
    """Every requested key with its best rendition; keys without a file are a 'miss'."""
    found = requests.select(*key).distinct().join(best_rendition(files, key, **kwargs), list(key), "left")
    return found.withColumn("status", F.coalesce("status", F.lit("miss")))


def resolve_resolution(probes: DataFrame, key: Sequence[str], *, rank: str = "rank") -> DataFrame:
    """(key, width, height) of the first probe with both sides known, else 0 x 0."""
    valid = (F.col("width") > 0) & (F.col("height") > 0)
    first = F.min_by(F.when(valid, F.struct("width", "height")), F.when(valid, F.col(rank)))
    out = probes.groupBy(*key).agg(first.alias("_first"))
    return out.select(
        *key,
        F.coalesce("_first.width", F.lit(0)).alias("width"),
        F.coalesce("_first.height", F.lit(0)).alias("height"),
    )


def format_resolution(formats: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, width, height): the largest width and the largest height over the parts of a source."""
    side = lambda c: F.greatest(F.lit(0), F.max(F.coalesce(c, F.lit(0)))).alias(c)
    return formats.groupBy(*key).agg(side("width"), side("height"))


def first_success(
    attempts: DataFrame,
    key: Sequence[str],
    *,
    rank: str = "rank",
    ok: Column | None = None,
    error: str = "error",
    last_n: int = 4,
) -> DataFrame:
    """(key, rank, succeeded, errors): lowest-rank success, else the last n errors joined in order.

    At most ``last_n`` errors of a key leave a task, whatever the number of attempts; to
    report all errors of a fixed list of strategies, pass its length.
    """
    key = list(key)
    ok = F.col("ok") if ok is None else ok
    rows = attempts.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    won = rows.groupBy(*key).agg(F.min(F.when(F.col("_ok"), F.col(rank))).alias("won_rank"))
    failed = rows.filter(F.col(error).isNotNull() & ~F.col("_ok")).join(won.filter("won_rank is null"), key, "left_semi")
    recent = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(rank)))
    failed = failed.withColumn("_n", recent).filter(F.col("_n") <= last_n)
    errors = failed.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(rank, error))).alias("_errors"))
    errors = errors.select(*key, F.array_join(F.transform("_errors", lambda e: e[error]), " | ").alias("errors"))
    out = won.join(errors, key, "left")
    return out.select(*key, F.col("won_rank").alias(rank), F.col("won_rank").isNotNull().alias("succeeded"), "errors")


PAGE_ROLES = ("page_diagnostics", "preview_images", "review_candidates", "images")


def job_page_summary(rows: DataFrame, key: Sequence[str], *, role: str = "role", roles: Sequence[str] = PAGE_ROLES) -> DataFrame:
    """(key, page_count, page_class): count of the first role that has rows; low <= 2, moderate <= 4, high."""
    counts = rows.groupBy(*key).agg(*[F.count_if(F.col(role) == r).alias(f"_{i}") for i, r in enumerate(roles)])
    pages = F.coalesce(*[F.nullif(F.col(f"_{i}"), F.lit(0)) for i in range(len(roles))], F.lit(0))
    size = F.when(F.col("page_count") <= 0, F.lit(None)).when(F.col("page_count") <= 2, F.lit("low"))
    return counts.select(*key, pages.alias("page_count")).withColumn(
        "page_class", size.when(F.col("page_count") <= 4, F.lit("moderate")).otherwise(F.lit("high"))
    )


def review_summary(captures: DataFrame, excluded: DataFrame, key: Sequence[str], *, idx: str = "idx") -> DataFrame:
    """Per key total, kept, excluded, suspicious_total, suspicious_kept, can_apply.

    Exclusions that name no capture are ignored.
    """
    key = list(key)
    out = excluded.select(*key, idx).distinct().withColumn("_out", F.lit(True))
    rows = captures.join(out, [*key, idx], "left").withColumn("_kept", F.col("_out").isNull())
    odd = F.coalesce("suspicious", F.lit(False))
    counted = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("_kept").alias("kept"),
        F.count_if(odd).alias("suspicious_total"),
        F.count_if(odd & F.col("_kept")).alias("suspicious_kept"),
    )
    counted = counted.withColumn("excluded", F.col("total") - F.col("kept"))
    return counted.withColumn("can_apply", (F.col("kept") > 0) & (F.col("excluded") > 0))


def nearest_to_mean(
    df: DataFrame, key: Sequence[str], order: Sequence[str], vector: str, *, first: int | None = None
) -> DataFrame:
    """(key, order columns, distance) of the row with the least squared distance to the key's mean vector.

    Means and distances are sums over (key, position), so a key of any size is
    combined before the shuffle. ``first`` looks at that many leading rows only.
    """
    key, order = list(key), list(order)
    rows = df.select(*key, *order, F.col(vector).alias("_v"))
    if first is not None:
        lead = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        rows = rows.withColumn("_n", lead).filter(F.col("_n") <= first).drop("_n")
    parts = rows.select(*key, F.posexplode("_v").alias("_i", "_x"))
    means = parts.groupBy(*key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    # One mean vector per key: its length is the length of a row's vector.
    means = means.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_mean"))
    square = F.zip_with("_v", "_mean", lambda x, m: (x - m["_m"]) * (x - m["_m"]))
    scored = rows.join(means, key).withColumn("distance", F.round(F.aggregate(square, F.lit(0.0), lambda a, v: a + v), 9))
    best = scored.groupBy(*key).agg(F.min_by(F.struct(*order, "distance"), F.struct("distance", *order)).alias("_b"))
    return best.select(*key, "_b.*")


def representative_frame(
    frames: DataFrame, key: Sequence[str], index: str, vector: str, *, batch: int = C.THUMBNAIL_BATCH
) -> DataFrame:
    """(key, batch, index, distance): most typical frame of each batch of consecutive frames."""
    rows = frames.withColumn("batch", F.floor(F.col(index) / batch))
    return nearest_to_mean(rows, [*key, "batch"], [index], vector)
