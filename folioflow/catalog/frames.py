"""Frame measures and ordered folds on the small frame corpus."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from folioflow import fixtures as X
from folioflow.catalog.base import joined, query, r6, r6s
from folioflow.functions import geometry as G
from folioflow.functions import hashing as H
from folioflow.operators import aggregates as A
from folioflow.operators import folds as Q
from folioflow.operators import frames as FR
from folioflow.operators import joins as J
from folioflow.operators import sets as U
from folioflow.runs import Ordered
from folioflow.session import scratch_path
from folioflow.sources import images as I
from folioflow.sources import readers as R
from folioflow.sources import writers as WR

KEY, ORDER = ["source_id"], ["frame_index"]
MF = X.micro_frames_sql()
PAIRS = """pr AS (SELECT source_id, frame_index, px, lag(px) OVER (PARTITION BY source_id ORDER BY frame_index) AS prev FROM mf)"""
DIFF = "list_transform(range(1, 65), lambda i: abs({a}[i] - {b}[i]))"
TOTAL = "list_sum(list_transform(range(1, 65), lambda i: abs({a}[i] - {b}[i])))"


def _pairs(spark, d, columns=("px",)):
    return FR.consecutive_pairs(X.micro_frames(spark, d), KEY, ORDER, columns)


# --- X: pixels -----------------------------------------------------------------------------


@query(
    "x1_normalize_tone",
    f"""WITH {MF}, q AS (SELECT source_id, frame_index, quantile_cont(v::DOUBLE, 0.01) AS lo, quantile_cont(v::DOUBLE, 0.99) AS hi
  FROM (SELECT source_id, frame_index, unnest(px) AS v FROM mf) GROUP BY ALL),
t AS (SELECT source_id, frame_index, list_transform(px, lambda v: CAST(round_even(greatest(0, least(255, floor((v::FLOAT - lo::FLOAT) * (255.0::DOUBLE / (hi - lo))::FLOAT))) * 1.06::DOUBLE + 6.0::DOUBLE, 0) AS INTEGER)) AS t
  FROM mf JOIN q USING (source_id, frame_index))
SELECT source_id, frame_index, array_to_string(list_transform(t, lambda v: least(255, v)), ',') AS tone FROM t""",
)
def x1(spark, d):
    return FR.normalize_tone(X.micro_frames(spark, d), median=False).select(*KEY, *ORDER, joined("tone").alias("tone"))


@query(
    "x2_ink_mask",
    f"""WITH {MF} SELECT source_id, frame_index, array_to_string(list_transform(px, lambda v: CASE WHEN v <= 120 THEN 1 ELSE 0 END), ',') AS ink FROM mf""",
)
def x2(spark, d):
    return FR.ink_mask(X.micro_frames(spark, d), threshold=120).select(*KEY, *ORDER, joined("ink").alias("ink"))


def _adaptive_sql(px: str, name: str, block: int = 5, c: int = 7) -> str:
    """CTE bodies: the adaptive mask of 8x8 ``px`` (m), eroded (t) and dilated (o) over 2x2."""
    half = block // 2
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    w = [math.exp(-((i - half) ** 2) / (2 * sigma * sigma)) for i in range(block)]
    w = [v / sum(w) for v in w]
    weights = "[" + ", ".join(f"{v!r}::DOUBLE" for v in w) + "]"
    at = f"{px}[least(7, greatest(0, i // 8 + j // {block} - {half})) * 8 + least(7, greatest(0, i % 8 + j % {block} - {half})) + 1]"
    mean = f"round_even(list_sum(list_transform(range(0, {block * block}), lambda j: {weights}[j // {block} + 1] * {weights}[j % {block} + 1] * {at})), 0)"
    four = "[i, CASE WHEN i >= 8 THEN i - 8 END, CASE WHEN i % 8 > 0 THEN i - 1 END, CASE WHEN i >= 8 AND i % 8 > 0 THEN i - 9 END]"
    near = f"list_filter({four}, lambda n: n IS NOT NULL)"
    return f"""{name}_m AS (SELECT source_id, frame_index, list_transform(range(0, 64), lambda i: {px}[i + 1] <= {mean} - {c}) AS m FROM mf),
{name}_t AS (SELECT source_id, frame_index, list_transform(range(0, 64), lambda i: len(list_filter({near}, lambda n: NOT m[n + 1])) = 0) AS t FROM {name}_m),
{name} AS (SELECT source_id, frame_index, list_transform(range(0, 64), lambda i: len(list_filter({near}, lambda n: t[n + 1])) > 0) AS o FROM {name}_t)"""


@query(
    "x2_ink_mask_adaptive",
    f"""WITH {MF}, {_adaptive_sql("px", "op")} SELECT source_id, frame_index, array_to_string(list_transform(o, lambda v: CASE WHEN v THEN 1 ELSE 0 END), ',') AS ink FROM op""",
)
def x2a(spark, d):
    out = FR.ink_mask(X.micro_frames(spark, d), block=5, c=7, opened=True)
    return out.select(*KEY, *ORDER, joined("ink").alias("ink"))


HASH = "CAST(list_sum(list_transform(range(0, 56), lambda j: CASE WHEN px[(j // 7) * 8 + j % 7 + 2] > px[(j // 7) * 8 + j % 7 + 1] THEN 1::BIGINT << (55 - j) ELSE 0::BIGINT END)) AS BIGINT)"


@query(
    "x3_dhash",
    f"""WITH {MF}, h AS (SELECT source_id, frame_index, {HASH} AS dhash FROM mf)
SELECT source_id, frame_index, dhash, CAST(bit_count(xor(dhash, lag(dhash) OVER (PARTITION BY source_id ORDER BY frame_index))) AS INTEGER) AS distance FROM h""",
)
def x3(spark, d):
    rows = X.micro_frames(spark, d).select(*KEY, *ORDER, H.gradient_hash(F.col("px"), 8).alias("dhash"))
    out = Ordered(rows, KEY, ORDER).neighbour("_prev", F.col("dhash")).result()
    return out.select(*KEY, *ORDER, "dhash", H.hamming(F.col("dhash"), F.col("_prev")).cast("int").alias("distance"))


# The three-fold frame is 12 wide and 16 high; cell (y, j) of the 9x8 hash grid covers two rows and 4/3 columns.
_CELL = "list_sum(list_transform(range(0, 24), lambda t: greatest(0, least(3 * (t % 12) + 3, 4 * (c % 9) + 4) - greatest(3 * (t % 12), 4 * (c % 9))) * p[(2 * (c // 9) + t // 12) * 12 + t % 12 + 1]))"


@query(
    "x3_frame_hash",
    f"""WITH {MF}, a AS (SELECT source_id, frame_index, list_concat(list_concat(px, px), px) AS p FROM mf),
g AS (SELECT source_id, frame_index, list_transform(range(0, 72), lambda c: round_even({_CELL} / 8.0::DOUBLE, 0)) AS g FROM a)
SELECT source_id, frame_index, CAST(list_sum(list_transform(range(0, 64), lambda b: CASE WHEN g[(b // 8) * 9 + b % 8 + 2] > g[(b // 8) * 9 + b % 8 + 1]
  THEN CASE WHEN b = 0 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(1::BIGINT << CAST(63 - b AS INTEGER) AS HUGEINT) END ELSE CAST(0 AS HUGEINT) END)) AS BIGINT) AS dhash FROM g""",
)
def x3b(spark, d):
    wide = X.micro_frames(spark, d).withColumn("px", F.concat("px", "px", "px")).withColumns({"width": F.lit(12), "height": F.lit(16)})
    return FR.frame_hash(wide).select(*KEY, *ORDER, "dhash")


@query(
    "x4_structure_diff",
    f"""WITH {MF}, {_adaptive_sql("px", "op")}, q AS (SELECT source_id, frame_index, o, lag(o) OVER (PARTITION BY source_id ORDER BY frame_index) AS p FROM op)
SELECT source_id, frame_index, CASE WHEN p IS NOT NULL THEN {r6s("len(list_filter(range(1, 65), lambda i: o[i] <> p[i])) / 64.0::DOUBLE")} END AS structure_diff FROM q""",
)
def x4(spark, d):
    out = FR.structure_diff(_pairs(spark, d), block=5, c=7)
    return out.select(*KEY, *ORDER, r6(F.col("structure_diff")).alias("structure_diff"))


@query(
    "x5_detect_playhead",
    f"""WITH {MF}, {PAIRS}, a AS (SELECT source_id, frame_index, list_filter(range(0, 64), lambda i: abs(px[i + 1] - prev[i + 1]) > 22) AS c, prev FROM pr),
b AS (SELECT *, list_filter(range(0, 8), lambda x: len(list_filter(c, lambda i: i % 8 = x)) / 8.0::DOUBLE > 0.45) AS dense,
  list_max(list_transform(c, lambda i: i % 8)) - list_min(list_transform(c, lambda i: i % 8)) + 1 AS bw, list_max(list_transform(c, lambda i: i // 8)) - list_min(list_transform(c, lambda i: i // 8)) + 1 AS bh FROM a)
SELECT source_id, frame_index, CASE WHEN prev IS NULL THEN NULL WHEN len(c) = 0 THEN false WHEN bw / 8.0::DOUBLE <= 0.22 AND bh / 8.0::DOUBLE >= 0.42 AND len(c) / 64.0::DOUBLE <= 0.25 THEN true
  WHEN len(dense) = 0 THEN false WHEN list_max(dense) - list_min(dense) + 1 > 6 THEN false
  ELSE len(list_filter(c, lambda i: list_contains(dense, i % 8))) / CAST(len(c) AS DOUBLE) > 0.52 END AS playhead FROM b""",
)
def x5(spark, d):
    return FR.detect_playhead(_pairs(spark, d)).select(*KEY, *ORDER, "playhead")


def _phase_sql() -> str:
    """CTE bodies: normalised cross power of the centred 8x8 frames, its inverse transform shifted by four, and the peak's neighbourhood."""
    sine = "[" + ", ".join(repr(math.sin(2 * math.pi * i / 8)) + "::DOUBLE" for i in range(8)) + "]"
    cosine = "[" + ", ".join(repr(math.cos(2 * math.pi * i / 8)) + "::DOUBLE" for i in range(8)) + "]"
    at = lambda k, i: f"((({k}) // 8) * (({i}) // 8) + (({k}) % 8) * (({i}) % 8)) % 8 + 1"
    part = lambda name, table: f"list_transform(range(0, 64), lambda k: list_sum(list_transform(range(0, 64), lambda i: {name}[i + 1] * {table}[{at('k', 'i')}])))"
    return f"""ce AS (SELECT source_id, frame_index, list_transform(prev, lambda v: v - list_avg(prev)) AS a, list_transform(px, lambda v: v - list_avg(px)) AS b,
  list_stddev_pop(prev) AS sa, list_stddev_pop(px) AS sb FROM pr),
tr AS (SELECT *, {part("a", cosine)} AS ac, {part("a", sine)} AS asn, {part("b", cosine)} AS bc, {part("b", sine)} AS bs FROM ce WHERE a IS NOT NULL),
cr AS (SELECT *, list_transform(range(1, 65), lambda k: ac[k] * bc[k] + asn[k] * bs[k]) AS re, list_transform(range(1, 65), lambda k: asn[k] * bc[k] - ac[k] * bs[k]) AS im FROM tr),
nm AS (SELECT source_id, frame_index, sa, sb, list_transform(range(1, 65), lambda k: CASE WHEN re[k] * re[k] + im[k] * im[k] > 1e-12 THEN re[k] / sqrt(re[k] * re[k] + im[k] * im[k]) ELSE 0.0::DOUBLE END) AS re,
  list_transform(range(1, 65), lambda k: CASE WHEN re[k] * re[k] + im[k] * im[k] > 1e-12 THEN im[k] / sqrt(re[k] * re[k] + im[k] * im[k]) ELSE 0.0::DOUBLE END) AS im FROM cr),
sf AS (SELECT source_id, frame_index, sa, sb, list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 64), lambda k:
  re[k + 1] * {cosine}[{at("k", "((i // 8 + 4) % 8) * 8 + (i % 8 + 4) % 8")}] - im[k + 1] * {sine}[{at("k", "((i // 8 + 4) % 8) * 8 + (i % 8 + 4) % 8")}])) / 64.0::DOUBLE) AS s FROM nm),
pk AS (SELECT *, CAST(list_position(list_transform(s, lambda v: v >= list_max(s) - 1e-12), true) - 1 AS INTEGER) AS p FROM sf),
nr AS (SELECT *, list_filter(range(0, 64), lambda i: abs(i // 8 - p // 8) <= 2 AND abs(i % 8 - p % 8) <= 2) AS n FROM pk),
wt AS (SELECT *, list_sum(list_transform(n, lambda i: s[i + 1])) AS w, list_sum(list_transform(n, lambda i: s[i + 1] * (i // 8))) AS wy FROM nr),
sh AS (SELECT source_id, frame_index, sa >= 1e-5 AND sb >= 1e-5 AND w <> 0 AS ok, greatest(-4.0::DOUBLE, least(4.0::DOUBLE, 4 - wy / w)) AS shift, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (w - 0.08::DOUBLE) / 0.76::DOUBLE)) AS conf FROM wt)"""


@query(
    "x6_phase_shift",
    f"""WITH {MF}, {PAIRS}, {_phase_sql()} SELECT pr.source_id, pr.frame_index, {r6s("CASE WHEN ok THEN shift ELSE 0.0::DOUBLE END")} AS phase_shift, {r6s("CASE WHEN ok THEN conf ELSE 0.0::DOUBLE END")} AS phase_conf
FROM pr JOIN sh USING (source_id, frame_index) UNION ALL SELECT source_id, frame_index, NULL, NULL FROM pr WHERE prev IS NULL""",
)
def x6(spark, d):
    out = FR.phase_shift(_pairs(spark, d), max_shift=4)
    return out.select(*KEY, *ORDER, r6(F.col("phase_shift")).alias("phase_shift"), r6(F.col("phase_conf")).alias("phase_conf"))


# Region (1,1)-(5,5): a 4x4 sheet whose cell (u, v) lies at 1 + u * 4/3.
_AT = "px[CAST({y} AS INTEGER) * 8 + CAST({x} AS INTEGER) + 1]"


def _bilinear_sql() -> str:
    cells = []
    for v in range(4):
        for u in range(4):
            (ny, ry), (nx, rx) = divmod(3 + 4 * v, 3), divmod(3 + 4 * u, 3)
            at = lambda y, x: f"px[{y * 8 + x + 1}]"
            n = f"({at(ny, nx)} * {(3 - ry) * (3 - rx)} + {at(ny, nx + 1)} * {(3 - ry) * rx} + {at(ny + 1, nx)} * {ry * (3 - rx)} + {at(ny + 1, nx + 1)} * {ry * rx})"
            cells.append(f"CAST(floor({n} / 9.0::DOUBLE + 0.5::DOUBLE) AS INTEGER)")
    return "[" + ", ".join(cells) + "]"


@query(
    "x7_rectify_frames",
    f"""WITH {MF} SELECT source_id, frame_index, CASE WHEN source_id = 9 THEN 8 ELSE 4 END AS sheet_width, array_to_string(CASE WHEN source_id = 9 THEN px ELSE {_bilinear_sql()} END, ',') AS sheet FROM mf""",
)
def x7(spark, d):
    corners = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((5.0, 5.0), (1.0, 1.0), (5.0, 1.0), (1.0, 5.0))])
    roi = F.when(F.col("source_id") != 9, G.order_roi_points(corners))
    out = FR.rectify_frames(X.micro_frames(spark, d).withColumn("roi", roi))
    return out.select(*KEY, *ORDER, "sheet_width", joined("sheet").alias("sheet"))


@query(
    "x8_align_width",
    f"""WITH {MF}, a AS (SELECT source_id, frame_index, 8 - 2 * (frame_index % 3) AS w, px FROM mf),
b AS (SELECT *, max(w) OVER (PARTITION BY source_id) AS t FROM a)
SELECT source_id, frame_index, t AS width, array_to_string(flatten(list_transform(range(0, 8), lambda y: list_concat(list_concat(
  list_transform(range(0, CAST((t - w) // 2 AS BIGINT)), lambda z: 255), px[y * w + 1 : y * w + w]), list_transform(range(0, CAST(t - w - (t - w) // 2 AS BIGINT)), lambda z: 255)))), ',') AS px FROM b""",
)
def x8(spark, d):
    w = F.lit(8) - 2 * F.pmod("frame_index", F.lit(3))
    rows = X.micro_frames(spark, d)
    rows = rows.withColumn("width", w).withColumn("px", F.slice("px", F.lit(1), F.col("width") * 8))
    return FR.align_width(rows, KEY).select(*KEY, *ORDER, "width", joined("px").alias("px"))


# --- W1, A: measures -------------------------------------------------------------------------


@query(
    "w1_frame_change",
    f"""WITH {MF}, {PAIRS}, a AS (SELECT source_id, frame_index, {TOTAL.format(a="px", b="prev")} / 64.0::DOUBLE AS m, len(list_filter({DIFF.format(a="px", b="prev")}, lambda v: v > 22)) / 64.0::DOUBLE AS c FROM pr WHERE prev IS NOT NULL)
SELECT source_id, frame_index, m AS mean_abs_diff, c AS changed_ratio, {r6s("greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - m / 255.0::DOUBLE))")} AS similarity, m < 5.8 AS near_same FROM a""",
)
def w1(spark, d):
    out = FR.frame_change(_pairs(spark, d)).filter("prev_px is not null")
    return out.select(*KEY, *ORDER, "mean_abs_diff", "changed_ratio", r6(F.col("similarity")).alias("similarity"), "near_same")


INK = """ink AS (SELECT source_id, frame_index,
  list_transform(range(0, 8), lambda y: len(list_filter(px[y * 8 + 1 : y * 8 + 8], lambda v: v <= {t})) / 8.0::DOUBLE) AS rows,
  list_transform(range(0, 8), lambda x: len(list_filter(range(0, 8), lambda y: px[y * 8 + x + 1] <= {t})) / 8.0::DOUBLE) AS cols FROM mf)"""


@query(
    "a1_ink_profile",
    f"""WITH {MF}, {INK.format(t=127)} SELECT source_id, frame_index, 'row' AS axis, CAST(unnest(range(0, 8)) AS INTEGER) AS pos, unnest(rows) AS density FROM ink
UNION ALL SELECT source_id, frame_index, 'col', CAST(unnest(range(0, 8)) AS INTEGER), unnest(cols) FROM ink""",
)
def a1(spark, d):
    prof = FR.ink_profile(X.micro_frames(spark, d))
    both = F.array(
        F.struct(F.lit("row").alias("axis"), F.col("row_density").alias("d")),
        F.struct(F.lit("col").alias("axis"), F.col("col_density").alias("d")),
    )
    return prof.select(*KEY, *ORDER, F.inline(both)).select(*KEY, *ORDER, "axis", F.posexplode("d").alias("pos", "density"))


DENS = """den AS (SELECT source_id, frame_index, list_sum(rows) / 8 AS density, list_sum(rows[1:4]) / 4 AS top_density, list_sum(rows[5:8]) / 4 AS bottom_density FROM ink)"""


@query("a2_frame_density", f"""WITH {MF}, {INK.format(t=127)}, {DENS} SELECT * FROM den""")
def a2(spark, d):
    out = FR.frame_density(FR.ink_profile(X.micro_frames(spark, d)))
    return out.select(*KEY, *ORDER, "density", "top_density", "bottom_density")


_W, _H, _TOP, _BOT = "(x2 - x1) / 8.0::DOUBLE", "(y2 - y1) / 8.0::DOUBLE", "y1 / 8.0::DOUBLE", "(8 - y2) / 8.0::DOUBLE"


@query(
    "a3_roi_health",
    f"""WITH {MF}, {INK.format(t=95)}, {DENS},
m AS (SELECT source_id, count(*) AS n, avg(density) AS dn, count(*) FILTER (top_density > 0.058) AS th, count(*) FILTER (bottom_density > 0.058) AS bh, count(*) FILTER (density < 0.018) AS lh FROM den GROUP BY source_id),
r AS (SELECT s.source_id, s.source_id % 3 AS x1, s.source_id % 2 AS y1, CASE WHEN s.source_id % 5 = 4 THEN s.source_id % 3 + 2 ELSE 8 - s.source_id % 2 END AS x2, CASE WHEN s.source_id = 5 THEN 2 ELSE 8 - s.source_id // 4 END AS y2 FROM (SELECT DISTINCT source_id FROM mf UNION ALL SELECT 99) s),
a AS (SELECT r.*, coalesce(n, 0) AS n, coalesce(dn, 0) AS dn, coalesce(th, 0) AS th, coalesce(bh, 0) AS bh, coalesce(lh, 0) AS lh FROM r LEFT JOIN m USING (source_id)),
b AS (SELECT *, CASE WHEN n = 0 THEN []::VARCHAR[] ELSE list_filter([
  CASE WHEN {_W} < 0.34 THEN 'warning:roi_width_low' WHEN {_W} > 0.96 THEN 'warning:roi_width_high' END, CASE WHEN {_H} < 0.18 THEN 'warning:roi_height_low' WHEN {_H} > 0.88 THEN 'warning:roi_height_high' END,
  CASE WHEN {_TOP} < 0.015 OR {_BOT} < 0.015 THEN 'critical:roi_margin_tight' END,
  CASE WHEN th > 0 THEN CASE WHEN th >= greatest(1, n - 1) THEN 'critical' ELSE 'warning' END || ':top_edge_busy' END, CASE WHEN bh > 0 THEN CASE WHEN bh >= greatest(1, n - 1) THEN 'critical' ELSE 'warning' END || ':bottom_edge_busy' END,
  CASE WHEN lh >= greatest(1, n - 1) THEN 'warning:content_sparse' END], lambda c: c IS NOT NULL) END AS f0 FROM a),
c AS (SELECT *, CASE WHEN n > 0 AND len(f0) = 0 THEN ['info:roi_healthy'] ELSE f0 END AS f FROM b)
SELECT source_id, CASE WHEN len(list_filter(f, lambda v: v LIKE 'critical%')) > 0 THEN 'critical' WHEN len(list_filter(f, lambda v: v LIKE 'warning%')) > 0 THEN 'warning' ELSE 'info' END AS risk_level,
  array_to_string(f, ',') AS findings, n AS sampled_frames, CASE WHEN n > 0 THEN round_even({_W}, 5) END AS width_ratio, CASE WHEN n > 0 THEN round_even({_BOT}, 5) END AS bottom_margin_ratio,
  CASE WHEN n > 0 THEN round_even(dn, 5) END AS average_content_density, th AS top_edge_hits, bh AS bottom_edge_hits, lh AS low_density_hits FROM c""",
)
def a3(spark, d):
    mf = X.micro_frames(spark, d)
    s = F.col("source_id")
    x1, y1 = F.pmod(s, F.lit(3)), F.pmod(s, F.lit(2))
    # Source 99 has a region but no frames.
    sources = mf.select("source_id").distinct().unionByName(spark.range(99, 100).select(F.col("id").cast("int").alias("source_id")))
    rects = sources.select(
        "source_id",
        F.lit(8).alias("width"),
        F.lit(8).alias("height"),
        x1.alias("x1"),
        y1.alias("y1"),
        F.when(F.pmod(s, F.lit(5)) == 4, x1 + 2).otherwise(8 - F.pmod(s, F.lit(2))).alias("x2"),
        F.when(s == 5, 2).otherwise(8 - F.floor(s / 4).cast("int")).alias("y2"),
    )
    measures = FR.frame_density(FR.ink_profile(mf, threshold=95))
    out = A.roi_health(measures, rects, KEY)
    text = F.transform("diagnostics", lambda f: F.concat(f["level"], F.lit(":"), f["code"]))
    return out.select(
        *KEY, "risk_level", F.array_join(text, ",").alias("findings"), "sampled_frames", "width_ratio", "bottom_margin_ratio",
        "average_content_density", "top_edge_hits", "bottom_edge_hits", "low_density_hits",
    )


@query(
    "a12_representative_frame",
    """WITH e AS (SELECT label AS source_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame_index, embedding FROM embeddings),
b AS (SELECT source_id, CAST(floor(frame_index / 20.0::DOUBLE) AS BIGINT) AS batch, frame_index, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM e),
m AS (SELECT source_id, batch, i, avg(x) AS m FROM b GROUP BY ALL),
s AS (SELECT source_id, batch, frame_index, round(sum((x - m) * (x - m)), 9) AS dist FROM b JOIN m USING (source_id, batch, i) GROUP BY ALL)
SELECT source_id, batch, arg_min(frame_index, ROW(dist, frame_index)) AS frame_index, """ + r6s("min(dist)") + """ AS distance FROM s GROUP BY ALL""",
)
def a12(spark, d):
    e = X.table(spark, d, "embeddings").select(
        F.col("label").alias("source_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec")
    )
    rows = Ordered(e, KEY, ["vec_id"]).position("frame_index").result()
    out = A.representative_frame(rows, KEY, "frame_index", "vec", batch=20)
    return out.select(*KEY, "batch", "frame_index", r6(F.col("distance")).alias("distance"))


@query(
    "a13_content_bbox",
    f"""WITH {MF}, {INK.format(t=90)}, a AS (SELECT source_id, frame_index, list_filter(range(0, 8), lambda i: rows[i + 1] > 0.003) AS r, list_filter(range(0, 8), lambda i: cols[i + 1] > 0.003) AS c FROM ink)
SELECT source_id, frame_index, CAST(CASE WHEN len(r) = 0 THEN 0 ELSE list_min(r) END AS INTEGER) AS y0, CAST(CASE WHEN len(r) = 0 THEN 8 ELSE list_max(r) + 1 END AS INTEGER) AS y1,
  CAST(CASE WHEN len(c) = 0 THEN 0 ELSE list_min(c) END AS INTEGER) AS x0, CAST(CASE WHEN len(c) = 0 THEN 8 ELSE list_max(c) + 1 END AS INTEGER) AS x1 FROM a""",
)
def a13(spark, d):
    out = FR.content_bbox(FR.ink_profile(X.micro_frames(spark, d), threshold=90), pad_min=0)
    return out.select(*KEY, *ORDER, "box.y0", "box.y1", "box.x0", "box.x1")


# --- J: frame joins ----------------------------------------------------------------------------


@query(
    "j1_attach_roi",
    f"""WITH {MF}, a AS (SELECT source_id, frame_index, CASE WHEN source_id % 2 = 0 THEN source_id + 1.0::DOUBLE ELSE 0.5::DOUBLE END AS x FROM mf)
SELECT source_id, frame_index, x AS left_x, x + 4 AS right_x, 1.0::DOUBLE AS score FROM a""",
)
def j1(spark, d):
    mf = X.micro_frames(spark, d)

    def box(x):
        return F.array(F.array(x + 4, F.lit(7.0)), F.array(x, F.lit(1.0)), F.array(x, F.lit(7.0)), F.array(x + 4, F.lit(1.0)))

    own = mf.select("source_id").distinct().filter(F.pmod("source_id", F.lit(2)) == 0)
    rois = own.withColumn("roi", box(F.col("source_id") + 1.0))
    out = J.attach_roi(mf.select(*KEY, *ORDER), rois, KEY, manual=box(F.lit(0.5)))
    return out.select(*KEY, *ORDER, F.col("roi")[0][0].alias("left_x"), F.col("roi")[2][0].alias("right_x"), "score")


@query(
    "j3_estimate_shift",
    f"""WITH {MF}, p AS (SELECT source_id, frame_index, list_transform(range(0, 8), lambda y: list_sum(px[y * 8 + 1 : y * 8 + 8]) / 8.0::DOUBLE) AS rm FROM mf),
z AS (SELECT source_id, frame_index, list_transform(rm, lambda v: v - list_avg(rm)) AS z FROM p),
q AS (SELECT source_id, frame_index, lag(z) OVER (PARTITION BY source_id ORDER BY frame_index) AS a, z AS b FROM z),
l AS (SELECT *, unnest(range(-3, 4)) AS lag FROM q WHERE a IS NOT NULL),
s AS (SELECT *, round(list_sum(list_transform(range(1, 9 - abs(lag)), lambda i: a[i + greatest(lag, 0)] * b[i + greatest(-lag, 0)])) / (8 - abs(lag)), 9) AS score FROM l),
t AS (SELECT source_id, frame_index, any_value(a) AS a, any_value(b) AS b, max(score) AS score, arg_min(lag, ROW(-score, lag)) AS lag FROM s GROUP BY ALL)
SELECT source_id, frame_index, CAST(lag AS INTEGER) AS shift, {r6s("score")} AS shift_score, {r6s("least(1.0::DOUBLE, greatest(0.0::DOUBLE, (score / greatest(1e-6::DOUBLE, sqrt(list_sum(list_transform(a, lambda v: v * v)) / 8) * sqrt(list_sum(list_transform(b, lambda v: v * v)) / 8)) - 0.16::DOUBLE) / 0.72::DOUBLE))")} AS shift_conf FROM t""",
)
def j3(spark, d):
    rows = FR.row_mean_profile(X.micro_frames(spark, d)).select(*KEY, *ORDER, "row_mean")
    pairs = FR.consecutive_pairs(rows, KEY, ORDER, ["row_mean"]).filter("prev_row_mean is not null")
    out = FR.estimate_shift(pairs, "prev_row_mean", "row_mean", max_lag=3, min_seg=4)
    return out.select(*KEY, *ORDER, "shift", r6(F.col("shift_score")).alias("shift_score"), r6(F.col("shift_conf")).alias("shift_conf"))


@query(
    "x6_choose_shift",
    f"""WITH {MF}, {PAIRS}, {_phase_sql()}, p AS (SELECT source_id, frame_index, list_transform(range(0, 8), lambda y: list_sum(px[y * 8 + 1 : y * 8 + 8]) / 8.0::DOUBLE) AS rm FROM mf),
z AS (SELECT source_id, frame_index, list_transform(rm, lambda v: v - list_avg(rm)) AS z FROM p),
q AS (SELECT source_id, frame_index, lag(z) OVER (PARTITION BY source_id ORDER BY frame_index) AS a, z AS b FROM z),
l AS (SELECT *, unnest(range(-3, 4)) AS lag FROM q WHERE a IS NOT NULL),
s AS (SELECT *, round(list_sum(list_transform(range(1, 9 - abs(lag)), lambda i: a[i + greatest(lag, 0)] * b[i + greatest(-lag, 0)])) / (8 - abs(lag)), 9) AS score FROM l),
t AS (SELECT source_id, frame_index, any_value(a) AS a, any_value(b) AS b, max(score) AS score, arg_min(lag, ROW(-score, lag)) AS lag FROM s GROUP BY ALL),
u AS (SELECT source_id, frame_index, lag, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (score / greatest(1e-6::DOUBLE, sqrt(list_sum(list_transform(a, lambda v: v * v)) / 8) * sqrt(list_sum(list_transform(b, lambda v: v * v)) / 8)) - 0.16::DOUBLE) / 0.72::DOUBLE)) AS sure FROM t),
v AS (SELECT source_id, frame_index, lag, sure, CASE WHEN ok THEN shift ELSE 0.0::DOUBLE END AS ph, CASE WHEN ok THEN conf ELSE 0.0::DOUBLE END AS phs FROM u JOIN sh USING (source_id, frame_index)),
w AS (SELECT *, phs >= greatest(0.38::DOUBLE, sure + 0.12::DOUBLE) OR (sure < 0.24 AND phs >= 0.3) AS phase FROM v)
SELECT source_id, frame_index, phase AS by_phase, {r6s("CASE WHEN phase THEN ph ELSE CAST(lag AS DOUBLE) END")} AS shift, {r6s("CASE WHEN phase THEN phs ELSE sure END")} AS conf FROM w""",
)
def x6_choice(spark, d):
    """Row correlation and phase correlation of neighbouring frames, and the one that counts."""
    rows = FR.row_mean_profile(X.micro_frames(spark, d))
    pairs = FR.consecutive_pairs(rows, KEY, ORDER, ["row_mean", "px"]).filter("prev_px is not null")
    both = FR.phase_shift(FR.estimate_shift(pairs, "prev_row_mean", "row_mean", max_lag=3, min_seg=4), max_shift=4)
    chosen = FR.choose_shift(F.col("shift"), F.col("shift_conf"), F.col("phase_shift"), F.col("phase_conf"))
    out = both.withColumn("_chosen", chosen).withColumn("by_phase", F.col("_chosen.conf") != F.col("shift_conf"))
    return out.select(*KEY, *ORDER, "by_phase", r6(F.col("_chosen.shift")).alias("shift"), r6(F.col("_chosen.conf")).alias("conf"))


def _overlaps(lo, hi, step=1, a="prev", b="px"):
    """Mean abs difference of the last n rows of a and the first n rows of b, for each n."""
    return (
        f"list_transform(range({lo}, {hi} + 1, {step}), lambda n: list_sum(list_transform(range(1, n * 8 + 1), lambda i: abs({a}[64 - n * 8 + i] - {b}[i]))) / CAST(n * 8 AS DOUBLE))"
    )


@query(
    "j4_estimate_overlap",
    f"""WITH {MF}, {PAIRS}, a AS (SELECT source_id, frame_index, {_overlaps(1, 6)} AS ds FROM pr WHERE prev IS NOT NULL)
SELECT source_id, frame_index, CASE WHEN list_min(ds) > 14 THEN 0 ELSE CAST(list_position(ds, list_min(ds)) AS INTEGER) END AS overlap, {r6s("list_min(ds)")} AS overlap_diff, {r6s("1.0::DOUBLE - list_min(ds) / 255.0::DOUBLE")} AS overlap_score FROM a""",
)
def j4(spark, d):
    pairs = _pairs(spark, d, ("px", "width", "height")).filter("prev_px is not null")
    out = FR.estimate_overlap(pairs, lo=1, hi=6, step=1, accept=14.0)
    return out.select(*KEY, *ORDER, "overlap", r6(F.col("overlap_diff")).alias("overlap_diff"), r6(F.col("overlap_score")).alias("overlap_score"))


# --- Q: folds -------------------------------------------------------------------------------------


def _greedy(state: str, first: str, test: str, rows: str = "mf", columns: str = "px") -> str:
    """Recursive walk: the state is replaced where ``test`` (r.state against g) holds."""
    return f"""walk AS (
  SELECT source_id, frame_index, {first} AS {state}, true AS hit FROM {rows} WHERE frame_index = 0
  UNION ALL
  SELECT g.source_id, g.frame_index, CASE WHEN x.t THEN g.{columns} ELSE r.{state} END, x.t
  FROM walk r JOIN {rows} g ON g.source_id = r.source_id AND g.frame_index = r.frame_index + 1, LATERAL (SELECT {test} AS t) x)"""


@query(
    "q1_dedupe_frames",
    f"""WITH RECURSIVE {MF}, {_greedy("kept", "px", "len(list_filter(" + DIFF.format(a="r.kept", b="g.px") + ", lambda v: v > 22)) / 64.0::DOUBLE >= 0.20")}
SELECT source_id, frame_index FROM walk WHERE hit""",
)
def q1(spark, d):
    kept = Q.dedupe_frames(
        X.micro_frames(spark, d), KEY, ORDER, layout="full_scroll", static=0.20, structure=0.0, min_side=0, blur=False
    )
    return kept.select(*KEY, *ORDER)


def _full_rule_sql(base: str = "mf", rule: str = "'bottom_bar' AS layout, 0.045 AS st, 0.085 AS sr, 0.22 AS pl, 8 AS hd") -> str:
    """CTE bodies for 24x24 frames (each cell of the 8x8 frame three times): blurred gray, opened ink mask, gradient grid, and the walk.

    ``base`` has frames numbered from 0; ``rule`` gives the layout and cuts of each.
    """
    block, half = 31, 15
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    w = [math.exp(-((i - half) ** 2) / (2 * sigma * sigma)) for i in range(block)]
    weights = "[" + ", ".join(f"{v / sum(w)!r}::DOUBLE" for v in w) + "]"
    mirror = lambda v: f"(23 - abs(23 - abs({v})))"
    clip = lambda v: f"least(23, greatest(0, {v}))"
    y, x, cells = "(i // 24)", "(i % 24)", "range(0, 576)"
    up, left = f"CASE WHEN {y} > 0 THEN i - 24 END", f"CASE WHEN {x} > 0 THEN i - 1 END"
    four = f"list_filter([i, {up}, {left}, CASE WHEN {y} > 0 AND {x} > 0 THEN i - 25 END], lambda n: n IS NOT NULL)"
    cell = "list_sum(list_transform(range(0, 8), lambda j: greatest(0, least(9 * j + 9, 8 * (c % 9) + 8) - greatest(9 * j, 8 * (c % 9))) * px[(c // 9) * 8 + j + 1]))"
    columns = "list_transform(range(0, 24), lambda u: len(list_filter(ch, lambda p: p % 24 = u)))"
    dense = "list_filter(range(0, 24), lambda u: cols[u + 1] / 24.0::DOUBLE > 0.45)"
    bar = """len(ch) > 0 AND ((list_max(list_transform(ch, lambda p: p % 24)) - list_min(list_transform(ch, lambda p: p % 24)) + 1) / 24.0::DOUBLE <= 0.22
      AND (list_max(ch) // 24 - list_min(ch) // 24 + 1) / 24.0::DOUBLE >= 0.42 AND len(ch) / 576.0::DOUBLE <= 0.25
      OR len(dense) > 0 AND list_max(dense) - list_min(dense) + 1 <= 6 AND list_sum(list_transform(dense, lambda u: cols[u + 1])) / CAST(len(ch) AS DOUBLE) > 0.52)"""
    return f"""bg AS (SELECT source_id, frame_index, px, list_transform({cells}, lambda i: px[(i // 72) * 8 + (i % 24) // 3 + 1]) AS p FROM {base}),
b1 AS (SELECT *, list_transform({cells}, lambda i: p[{mirror(y + " - 1")} * 24 + {x} + 1] + 2 * p[i + 1] + p[{mirror(y + " + 1")} * 24 + {x} + 1]) AS r FROM bg),
b2 AS (SELECT source_id, frame_index, px, list_transform({cells}, lambda i: (r[{y} * 24 + {mirror(x + " - 1")} + 1] + 2 * r[i + 1] + r[{y} * 24 + {mirror(x + " + 1")} + 1] + 8) // 16) AS g FROM b1),
m1 AS (SELECT *, list_transform({cells}, lambda i: list_sum(list_transform(range(0, {block}), lambda j: {weights}[j + 1] * g[{clip(y + f" + j - {half}")} * 24 + {x} + 1]))) AS v FROM b2),
m2 AS (SELECT *, list_transform({cells}, lambda i: g[i + 1] <= round_even(list_sum(list_transform(range(0, {block}), lambda j: {weights}[j + 1] * v[{y} * 24 + {clip(x + f" + j - {half}")} + 1])), 0) - 7) AS m FROM m1),
m3 AS (SELECT source_id, frame_index, px, g, list_transform({cells}, lambda i: len(list_filter({four}, lambda n: NOT m[n + 1])) = 0) AS t FROM m2),
m4 AS (SELECT source_id, frame_index, g, list_transform({cells}, lambda i: len(list_filter({four}, lambda n: t[n + 1])) > 0) AS k, list_transform(range(0, 72), lambda c: round_even({cell} / 8.0::DOUBLE, 0)) AS q FROM m3),
rl AS (SELECT source_id, frame_index, {rule} FROM {base}),
ft AS (SELECT source_id, frame_index, g, k, list_transform(range(0, 64), lambda b: q[(b // 8) * 9 + b % 8 + 2] > q[(b // 8) * 9 + b % 8 + 1]) AS mark FROM m4),
walk AS (
  SELECT source_id, frame_index, g, k, [mark] AS ring, CAST(NULL AS VARCHAR) AS drop_reason FROM ft WHERE frame_index = 0
  UNION ALL
  SELECT source_id, frame_index, CASE WHEN why IS NULL THEN ng ELSE g END, CASE WHEN why IS NULL THEN nk ELSE k END,
    CASE WHEN why IS NULL THEN list_concat(CASE WHEN len(ring) = 8 THEN ring[2:8] ELSE ring END, [mark]) ELSE ring END, why
  FROM (SELECT *, CASE WHEN len(ch) / 576.0::DOUBLE < st THEN 'static' WHEN len(list_filter(range(1, 577), lambda i: k[i] <> nk[i])) / 576.0::DOUBLE < sr THEN 'structure'
      WHEN layout = 'bottom_bar' AND len(ch) / 576.0::DOUBLE < pl AND ({bar}) THEN 'playhead'
      WHEN layout <> 'full_scroll' AND list_min(list_transform(ring, lambda o: len(list_filter(range(1, 65), lambda i: o[i] <> mark[i])))) <= hd THEN 'recent' END AS why
    FROM (SELECT *, {dense} AS dense FROM (SELECT *, {columns} AS cols FROM (
      SELECT n.source_id, n.frame_index, r.g, r.k, r.ring, n.g AS ng, n.k AS nk, n.mark, rl.layout, rl.st, rl.sr, rl.pl, rl.hd, list_filter({cells}, lambda i: abs(r.g[i + 1] - n.g[i + 1]) > 22) AS ch
      FROM walk r JOIN ft n ON n.source_id = r.source_id AND n.frame_index = r.frame_index + 1 JOIN rl ON rl.source_id = n.source_id AND rl.frame_index = n.frame_index) AS a) AS b) AS c) AS d)"""


def big_frames(spark, d):
    """The 8x8 frames enlarged to 24x24."""
    side = F.sequence(F.lit(0), F.lit(23))
    big = F.flatten(F.transform(side, lambda y: F.transform(side, lambda x: F.get("px", F.floor(y / 3).cast("int") * 8 + F.floor(x / 3).cast("int")))))
    return X.micro_frames(spark, d).withColumn("px", big).withColumns({"width": F.lit(24), "height": F.lit(24)})


@query("q1_dedupe_frames_full", f"WITH RECURSIVE {MF}, {_full_rule_sql()} SELECT source_id, frame_index, drop_reason IS NULL AS keep, drop_reason FROM walk")
def q1b(spark, d):
    """All rules of the strip layout, on frames enlarged to 24x24."""
    frames = big_frames(spark, d)
    out = Q.dedupe_frames(frames, KEY, ORDER, layout="bottom_bar", level="aggressive", flags=True)
    return out.select(*KEY, *ORDER, "keep", "drop_reason")


@query(
    "q2_recent_hash_filter",
    f"""WITH RECURSIVE {MF}, h AS (SELECT source_id, frame_index, {HASH} AS dh FROM mf), walk AS (
  SELECT source_id, frame_index, [dh] AS ring, true AS hit FROM h WHERE frame_index = 0
  UNION ALL
  SELECT g.source_id, g.frame_index, CASE WHEN x.t THEN list_slice(list_append(r.ring, g.dh), -8, -1) ELSE r.ring END, x.t
  FROM walk r JOIN h g ON g.source_id = r.source_id AND g.frame_index = r.frame_index + 1, LATERAL (SELECT list_min(list_transform(r.ring, lambda q: bit_count(xor(q, g.dh)))) > 20 AS t) x)
SELECT source_id, frame_index FROM walk WHERE hit""",
)
def q2(spark, d):
    rows = X.micro_frames(spark, d).select(*KEY, *ORDER, H.gradient_hash(F.col("px"), 8).alias("dhash"))
    return Q.recent_hash_filter(rows, KEY, ORDER, "dhash", max_dist=20).select(*KEY, *ORDER)


@query(
    "q3_filter_scroll",
    f"""WITH RECURSIVE {X.SIGNAL_SQL}, s AS (SELECT source_id, event_id, row_number() OVER w - 1 AS frame_index, (value - lag(value) OVER w) / 20.0::DOUBLE AS sh, k / 100.0::DOUBLE AS cf FROM sg WINDOW w AS (PARTITION BY source_id ORDER BY ts, event_id)),
walk AS (SELECT source_id, frame_index, 0 AS dir, true AS keep FROM s WHERE frame_index = 0
  UNION ALL
  SELECT g.source_id, g.frame_index, CASE WHEN NOT x.keep OR NOT x.moved THEN r.dir ELSE x.way END, x.keep
  FROM walk r JOIN s g ON g.source_id = r.source_id AND g.frame_index = r.frame_index + 1, LATERAL (
    SELECT sign(g.sh)::INTEGER AS way, g.cf >= 0.4 AND abs(g.sh) >= 1.0 AS moved,
      NOT (g.cf >= 0.34 AND abs(g.sh) < 3.2) AND NOT (g.cf >= 0.4 AND abs(g.sh) >= 1.0 AND r.dir <> 0 AND sign(g.sh)::INTEGER <> r.dir AND abs(g.sh) < 3.2::DOUBLE * 1.8::DOUBLE) AS keep) x)
SELECT event_id, walk.keep, walk.dir AS direction FROM walk JOIN s USING (source_id, frame_index)""",
)
def q3(spark, d):
    rows = X.signal(spark, d).select("source_id", "ts", "event_id", "value", "k")
    rows = Ordered(rows, KEY, ["ts", "event_id"]).neighbour("_prev", F.col("value")).result()
    rows = rows.withColumns({"shift": (F.col("value") - F.col("_prev")) / 20.0, "conf": F.col("k") / 100.0})
    return Q.filter_scroll(rows, KEY, ["ts", "event_id"], "shift", "conf").select("event_id", "keep", "direction")


TURN = "1.0::DOUBLE - " + TOTAL.format(a="r.cur", b="g.px") + " / 64.0::DOUBLE / 255.0::DOUBLE < 0.95"
TURNS = _greedy("cur", "px", TURN) + """, turns AS (
  SELECT source_id, frame_index, hit AS new_page, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY frame_index) AS BIGINT) AS page_no FROM walk)"""


@query("q4_collapse_page_turns", f"""WITH RECURSIVE {MF}, {TURNS} SELECT source_id, frame_index, new_page, page_no FROM turns""")
def q4(spark, d):
    return Q.collapse_page_turns(X.micro_frames(spark, d), KEY, ORDER).select(*KEY, *ORDER, "new_page", "page_no")


STITCH = f"""{PAIRS}, ov AS (SELECT source_id, frame_index, {_overlaps(1, 6)} AS ds, prev IS NULL AS head FROM pr),
sc AS (SELECT *, 1.0::DOUBLE - list_min(ds) / 255.0::DOUBLE AS score, CAST(list_position(ds, list_min(ds)) AS INTEGER) AS o FROM ov),
np AS (SELECT source_id, frame_index, head OR score < 0.95 AS new_page, CASE WHEN head OR score < 0.95 THEN 0 ELSE o END AS overlap FROM sc),
pn AS (SELECT *, CAST(sum(CASE WHEN new_page THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY frame_index) AS BIGINT) AS page_no FROM np),
plan AS (SELECT *, CAST(sum(CASE WHEN new_page THEN 0 ELSE 8 - overlap END) OVER (PARTITION BY source_id, page_no ORDER BY frame_index) AS BIGINT) AS y_offset FROM pn)"""


def _stitch(spark, d):
    return Q.stitch_plan(X.micro_frames(spark, d), KEY, ORDER, threshold=0.95, bounds=(1, 6, 1))


@query("q5_stitch_plan", f"""WITH {MF}, {STITCH} SELECT source_id, frame_index, overlap, new_page, page_no, y_offset FROM plan""")
def q5(spark, d):
    return _stitch(spark, d).select(*KEY, *ORDER, "overlap", "new_page", "page_no", "y_offset")


_SQUEEZED = """list_transform(range(0, 64), lambda i: CAST(round_even(
  buf[CAST(floor(greatest(0.0::DOUBLE, least(h - 1.0::DOUBLE, (i // 8 + 0.5::DOUBLE) * h / 8.0::DOUBLE - 0.5::DOUBLE))) AS INTEGER) * 8 + i % 8 + 1] * (1.0::DOUBLE - (greatest(0.0::DOUBLE, least(h - 1.0::DOUBLE, (i // 8 + 0.5::DOUBLE) * h / 8.0::DOUBLE - 0.5::DOUBLE)) - floor(greatest(0.0::DOUBLE, least(h - 1.0::DOUBLE, (i // 8 + 0.5::DOUBLE) * h / 8.0::DOUBLE - 0.5::DOUBLE)))))
  + buf[CAST(least(h - 1, floor(greatest(0.0::DOUBLE, least(h - 1.0::DOUBLE, (i // 8 + 0.5::DOUBLE) * h / 8.0::DOUBLE - 0.5::DOUBLE))) + 1) AS INTEGER) * 8 + i % 8 + 1] * (greatest(0.0::DOUBLE, least(h - 1.0::DOUBLE, (i // 8 + 0.5::DOUBLE) * h / 8.0::DOUBLE - 0.5::DOUBLE)) - floor(greatest(0.0::DOUBLE, least(h - 1.0::DOUBLE, (i // 8 + 0.5::DOUBLE) * h / 8.0::DOUBLE - 0.5::DOUBLE)))), 0) AS INTEGER))"""
_FADED = """list_transform(range(0, 64), lambda i: CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE,
  buf[(h - 8) * 8 + i + 1] * (1.0::DOUBLE - (i // 8) / 7.0::DOUBLE) + px[i + 1] * (1.0::DOUBLE - (1.0::DOUBLE - (i // 8) / 7.0::DOUBLE))))) AS INTEGER))"""


@query(
    "q5_stitch_buffer",
    f"""WITH RECURSIVE {MF}, walk AS (
  SELECT source_id, frame_index, px AS buf, 8 AS h, 0 AS overlap, true AS new_page, CAST(0 AS BIGINT) AS y_offset FROM mf WHERE frame_index = 0
  UNION ALL
  SELECT source_id, frame_index, CASE WHEN same THEN list_concat(buf[1 : (h - o) * 8], {_FADED}) ELSE px END, CASE WHEN same THEN h - o + 8 ELSE 8 END,
    CASE WHEN same THEN o ELSE 0 END, NOT same, CAST(CASE WHEN same THEN h - o ELSE 0 END AS BIGINT)
  FROM (SELECT *, 1.0::DOUBLE - list_min(ds) / 255.0::DOUBLE >= 0.9 AS same, CAST(list_position(ds, list_min(ds)) AS INTEGER) AS o
    FROM (SELECT *, {_overlaps(1, 6, a="sq")} AS ds
      FROM (SELECT r.source_id, g.frame_index, r.buf, r.h, g.px, {_SQUEEZED} AS sq
        FROM walk r JOIN mf g ON g.source_id = r.source_id AND g.frame_index = r.frame_index + 1) AS a) AS b) AS c)
SELECT source_id, frame_index, overlap, new_page, CAST(sum(CASE WHEN new_page THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY frame_index) AS BIGINT) AS page_no, y_offset FROM walk""",
)
def q5_buffer(spark, d):
    out = Q.stitch_plan(X.micro_frames(spark, d), KEY, ORDER, threshold=0.9, bounds=(1, 6, 1), whole_sheet=True)
    return out.select(*KEY, *ORDER, "overlap", "new_page", "page_no", "y_offset")


@query(
    "q6_merge_plan",
    f"""WITH RECURSIVE {MF}, {_greedy("cur", "px", TOTAL.format(a="r.cur", b="g.px") + " / 64.0::DOUBLE >= 12.5")},
kf AS (SELECT source_id, frame_index, cur AS px, lag(cur) OVER (PARTITION BY source_id ORDER BY frame_index) AS prev FROM walk WHERE hit),
ov AS (SELECT source_id, frame_index, prev, {_overlaps(1, 3)} AS ds FROM kf),
o2 AS (SELECT source_id, frame_index, prev, CASE WHEN prev IS NULL OR list_min(ds) > 11 THEN 0 ELSE CAST(list_position(ds, list_min(ds)) AS INTEGER) END AS overlap FROM ov)
SELECT source_id, frame_index, overlap, CAST(sum(CASE WHEN prev IS NULL THEN 0 ELSE 8 - overlap + CASE WHEN overlap = 0 THEN 12 ELSE 0 END END) OVER (PARTITION BY source_id ORDER BY frame_index) AS BIGINT) AS y_offset FROM o2""",
)
def q6(spark, d):
    out = Q.merge_plan(X.micro_frames(spark, d), KEY, ORDER, tone=False, near_cut=12.5, min_side=0, bounds=(1, 3, 1), accept=11.0)
    return out.select(*KEY, *ORDER, "overlap", "y_offset")


@query(
    "q13_compose_rows",
    f"""WITH {MF}, {STITCH}, st AS (SELECT plan.*, mf.px, lead(overlap) OVER w AS no, lead(frame_index) OVER w AS nfi FROM plan JOIN mf USING (source_id, frame_index) WINDOW w AS (PARTITION BY source_id, page_no ORDER BY frame_index)),
ss AS (SELECT *, CASE WHEN overlap > 0 THEN least(greatest(10, least(overlap, 42)), 8) ELSE 0 END AS seam, CASE WHEN no > 0 THEN least(greatest(10, least(no, 42)), 8) ELSE 0 END AS nseam FROM st),
ln AS (SELECT *, unnest(range(0, 8)) AS l FROM ss),
own AS (SELECT source_id, page_no, frame_index, y_offset + l AS y, l, seam, px[l * 8 + 1 : l * 8 + 8] AS row FROM ln WHERE l < 8 - coalesce(no, 0)),
ab AS (SELECT source_id, page_no, nfi AS frame_index, l - (8 - nseam) AS l, px[l * 8 + 1 : l * 8 + 8] AS above FROM ln WHERE l >= 8 - nseam),
jn AS (SELECT own.*, above, CASE WHEN seam > 1 THEN 1.0::DOUBLE - l / CAST(seam - 1 AS DOUBLE) ELSE 1.0::DOUBLE END AS al FROM own LEFT JOIN ab USING (source_id, page_no, frame_index, l))
SELECT source_id, page_no, CAST(y AS BIGINT) AS y, array_to_string(CASE WHEN above IS NULL THEN row ELSE list_transform(range(1, 9), lambda i: CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, above[i] * al + row[i] * (1.0::DOUBLE - al)))) AS INTEGER)) END, ',') AS row FROM jn""",
)
def q13(spark, d):
    out = Q.compose_rows(X.micro_frames(spark, d), _stitch(spark, d), KEY, ORDER)
    return out.select(*KEY, "page_no", F.col("y").cast("bigint").alias("y"), joined("row").alias("row"))


# --- S, U: images in, manifests out -------------------------------------------------------------------


@query(
    "s1_read_frames",
    f"""WITH {MF} SELECT CAST(source_id AS VARCHAR) AS source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY frame_index) - 1 AS INTEGER) AS frame_index, frame_index AS name_index,
  8 AS width, 8 AS height, CAST(list_sum(px) AS BIGINT) AS total FROM mf WHERE frame_index % 10 <> 7""",
)
def s1(spark, d):
    """Frames of the whole table as PNG files, every tenth unreadable, read back as images."""
    path = scratch_path(spark, "frames")
    files = I.png_frames(X.micro_frames(spark, d))
    spoiled = F.pmod("frame_index", F.lit(10)) == 7
    name = F.format_string("%d/frame_%06d.png", "source_id", "frame_index")
    I.write_files(files.select(name.alias("path"), F.when(spoiled, F.encode(F.lit("not an image"), "utf-8")).otherwise(F.col("content")).alias("content")), path)
    rows = R.read_frames(spark, path)
    rows = rows.withColumn("_hex", F.hex("px"))
    step = F.length("_hex") / F.lit(64)
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.conv(F.substr(F.col("_hex"), (i * step).cast("int") + 1, F.lit(2)), 16, 10).cast("bigint"),
    )
    rows = rows.withColumn("total", F.aggregate(cells, F.lit(0).cast("bigint"), lambda a, v: a + v)).drop("px", "_hex", "channels")
    out = Ordered(rows, KEY, ["name_index"]).position("frame_index").result()
    return out.select("source_id", "frame_index", "name_index", "width", "height", "total")


@query(
    "s4_write_pages",
    f"""WITH RECURSIVE {MF}, {TURNS}, pg AS (SELECT source_id, page_no - 1 AS page_index FROM turns WHERE new_page), n AS (SELECT source_id, count(*) AS used FROM pg GROUP BY source_id),
rn AS (SELECT source_id, used, CASE source_id % 4 WHEN 0 THEN ['png'] WHEN 1 THEN ['jpg','pdf'] WHEN 2 THEN ['png','pdf'] ELSE ['png','jpg','pdf'] END AS f FROM n),
im AS (SELECT source_id, page_index, unnest(f) AS fm FROM pg JOIN rn USING (source_id))
SELECT source_id, 'images' AS role, fm AS format, CAST(page_index + 1 AS INTEGER) AS item_index, printf('page_%04d.', page_index + 1) || fm AS name FROM im WHERE fm <> 'pdf'
UNION ALL SELECT source_id, 'full_sheet', 'png', 0, 'sheet_complete.png' FROM rn WHERE list_contains(f, 'png') AND used >= 2
UNION ALL SELECT source_id, 'pdf', 'pdf', 0, 'sheet_export.pdf' FROM rn WHERE list_contains(f, 'pdf')
UNION ALL SELECT source_id, 'raw_frames', 'png', frame_index, printf('raw_%05d.png', frame_index) FROM mf WHERE source_id = 3""",
)
def s4(spark, d):
    mf = X.micro_frames(spark, d)
    turns = Q.page_turn_pages(Q.collapse_page_turns(mf, KEY, ORDER))
    pages = turns.select("source_id", (F.col("page_no") - 1).alias("page_index"))
    s = F.pmod("source_id", F.lit(4))
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    formats = F.when(s == 0, arr("png")).when(s == 1, arr("JPEG ", "pdf")).when(s == 2, arr("bad")).otherwise(arr("png", "jpg", "pdf"))
    runs = pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("used_frames")).withColumns(
        {"formats": formats, "include_raw": F.col("source_id") == 3}
    )
    manifest = WR.export_manifest(pages, runs, KEY, raw=mf.select(*KEY, *ORDER))
    path = scratch_path(spark, "pages")
    WR.write_pages(manifest, path)
    back = spark.read.parquet(path)
    return back.select(*KEY, "role", "format", "item_index", "name")


@query(
    "u1_combine_outputs",
    f"""WITH {X.CAPTURES_SQL} SELECT job_id, idx, path, 'images' AS role FROM cp WHERE kept UNION ALL SELECT job_id, idx, path, 'preview_images' FROM cp WHERE suspicious
UNION ALL SELECT job_id, idx, path, 'raw_frames' FROM cp UNION ALL SELECT job_id, NULL, '/jobs-files/' || job_id || '/sheet_export.pdf', 'pdf' FROM (SELECT DISTINCT job_id FROM cp)""",
)
def u1(spark, d):
    c = X.captures(spark, d)
    cols = ["job_id", "idx", "path"]
    book = c.select("job_id").distinct().withColumn("path", F.concat(F.lit("/jobs-files/"), "job_id", F.lit("/sheet_export.pdf")))
    return U.combine_outputs(
        images=c.filter("kept").select(*cols), preview_images=c.filter("suspicious").select(*cols), raw_frames=c.select(*cols), pdf=book
    )
