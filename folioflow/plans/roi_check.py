"""Region check: three sampled frames per request, cropped, measured and judged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow import constants as C
from folioflow import kernels as K
from folioflow.arrow import map_rows
from folioflow.functions.geometry import roi_rect
from folioflow.operators import aggregates as A
from folioflow.operators import frames as FR
from folioflow.operators import joins as J


def cropped_ink(frames: DataFrame) -> DataFrame:
    """Add row_density of the adaptive ink inside ``rect`` of each frame."""

    def measure(px, width, height, rect):
        gray = K.image(px, width, height)
        if gray is None or rect is None:
            return (None,)
        crop = gray[rect["y1"] : rect["y2"], rect["x1"] : rect["x2"]]
        return (None if crop.size == 0 else K.ink_mask(crop).mean(axis=1),)

    return map_rows(frames, ["px", "width", "height", "rect"], measure, [("row_density", "array<double>")])


def check_rois(requests: DataFrame, frames: DataFrame, *, tol: float = 0.5) -> DataFrame:
    """Health of every request's region.

    ``requests`` (source_id, request, start_sec, roi); ``frames`` (source_id,
    frame_index, ts_sec, width, height, px). Adds ``checked_seconds``.
    """
    offsets = F.array(*[F.lit(o) for o in C.ROI_SAMPLE_OFFSETS])
    base = F.greatest(F.lit(0.0), F.coalesce("start_sec", F.lit(0.0)))
    samples = requests.select("source_id", "request", F.posexplode(offsets).alias("sample", "_offset"), base.alias("_base"))
    samples = samples.select(
        "source_id", F.struct("request", "sample").alias("probe"), (F.col("_base") + F.col("_offset")).alias("sec")
    )
    found = J.seek_first_available(samples, frames, ["source_id"], "probe", frame="frame_index", tol=tol)
    found = found.filter("frame_index is not null").select("source_id", "probe.request", "sec", "frame_index")
    seen = found.join(requests.select("source_id", "request", "roi"), ["source_id", "request"])
    seen = seen.join(frames.select("source_id", "frame_index", "width", "height", "px"), ["source_id", "frame_index"])
    seen = seen.withColumn("rect", roi_rect(F.col("roi"), F.col("width"), F.col("height")))
    measures = FR.frame_density(cropped_ink(seen))
    measures = measures.select("source_id", "request", "sec", "width", "height", "rect", "density", "top_density", "bottom_density")
    first = F.min_by(F.struct("width", "height", "rect"), "sec").alias("_f")
    # Three samples per request at most.
    facts = measures.groupBy("source_id", "request").agg(first, F.sort_array(F.collect_list(F.bround("sec", 2))).alias("checked_seconds"))
    rects = requests.select("source_id", "request").join(facts, ["source_id", "request"], "left")
    rects = rects.select("source_id", "request", "checked_seconds", "_f.width", "_f.height", "_f.rect.*")
    health = A.roi_health(measures, rects, ["source_id", "request"])
    return health.join(rects.select("source_id", "request", "checked_seconds"), ["source_id", "request"])
