"""Pagination on sheet profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import constants as C
from folioflow import fixtures as X
from folioflow.catalog.base import query, r10, r10s, r6, r6s
from folioflow.operators import pagination as P
from folioflow.runs import Ordered, fits

KEY = ["sheet_id"]
SP = X.sheet_profile_sql()
Q = "quantile_cont(density, {p})"
QUANT = """qt AS (SELECT sheet_id, quantile_cont(density::DOUBLE, 0.72) AS p72, quantile_cont(density::DOUBLE, 0.28) AS p28, quantile_cont(density::DOUBLE, 0.01) AS p1, quantile_cont(density::DOUBLE, 0.99) AS p99, count(*) AS h FROM {t} GROUP BY sheet_id)"""
BANDS = """act AS (SELECT t.sheet_id, t.y, y - row_number() OVER (PARTITION BY t.sheet_id ORDER BY y) AS isl FROM {t} t JOIN qt USING (sheet_id) WHERE density > greatest(0.004::DOUBLE, least(0.03::DOUBLE, p72 * 0.34::DOUBLE))),
bands AS (SELECT sheet_id, CAST(min(y) AS INTEGER) AS band_start, CAST(max(y) + 1 AS INTEGER) AS band_end FROM act GROUP BY sheet_id, isl HAVING count(*) >= {m})"""


def _bands(profile, min_len, small=None):
    small = fits(profile, KEY) if small is None else small
    cuts = P.density_quantiles(profile, KEY, {"p72": 0.72}, small=small).withColumn("cut", P.band_threshold(F.col("p72")))
    return P.active_bands(profile.join(cuts, KEY), KEY, threshold=F.col("cut"), min_len=F.lit(min_len), small=small)


@query(
    "a14_density_quantiles",
    f"""WITH {SP}, {QUANT.format(t="sp")} SELECT sheet_id, {r6s("p72")} AS p72, {r6s("p28")} AS p28, {r6s("p1")} AS p1, {r6s("p99")} AS p99,
  {r6s("greatest(0.004::DOUBLE, least(0.03::DOUBLE, p72 * 0.34::DOUBLE))")} AS band_cut, {r6s("greatest(0.0025::DOUBLE, least(0.018::DOUBLE, p28 * 1.35::DOUBLE))")} AS blank_cut FROM qt""",
)
def a14(spark, d):
    q = P.density_quantiles(X.sheet_profile(spark, d), KEY, {"p72": 0.72, "p28": 0.28, "p1": 0.01, "p99": 0.99})
    cols = {c: r6(F.col(c)) for c in ("p72", "p28", "p1", "p99")}
    return q.withColumns({"band_cut": r6(P.band_threshold(F.col("p72"))), "blank_cut": r6(P.blank_threshold(F.col("p28")))}).withColumns(cols)


@query("w2_active_bands", f"""WITH {SP}, {QUANT.format(t="sp")}, {BANDS.format(t="sp", m=9)} SELECT * FROM bands""")
def w2(spark, d):
    return _bands(X.sheet_profile(spark, d), 9)


@query("w2_text_bands", f"""WITH {X.TEXT_SHEET_SQL}, {QUANT.format(t="tsp")}, {BANDS.format(t="tsp", m=1)} SELECT * FROM bands""")
def w2b(spark, d):
    return _bands(X.text_sheet(spark, d), 1)


@query(
    "w3_boundary_score",
    f"""WITH {SP} SELECT sheet_id, y, {r10s("avg(density) OVER (PARTITION BY sheet_id ORDER BY y ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)")} AS boundary_score FROM sp""",
)
def w3(spark, d):
    out = P.boundary_score(X.sheet_profile(spark, d), KEY, block=512)
    return out.select("sheet_id", "y", r10(F.col("boundary_score")).alias("boundary_score"))


@query(
    "w4_page_gaps",
    f"""WITH {SP}, {QUANT.format(t="sp")}, {BANDS.format(t="sp", m=9)}, g AS (SELECT sheet_id, lead(band_start) OVER (PARTITION BY sheet_id ORDER BY band_start) - band_end AS gap FROM bands)
SELECT sheet_id, bool_or(coalesce(gap > 15 + sheet_id * 10, false)) AS has_gap FROM g GROUP BY sheet_id""",
)
def w4(spark, d):
    bands = _bands(X.sheet_profile(spark, d), 9)
    pages = bands.select("sheet_id", F.col("band_start").alias("y_start"), F.col("band_end").alias("y_end"))
    return P.page_gaps(pages, KEY, max_gap=15 + F.col("sheet_id") * 10)


# Fixed pages of 350 rows for the edge check; the factor keeps means away from rounding ties.
@query(
    "a4_page_diagnostics",
    f"""WITH {SP}, h AS (SELECT sheet_id, max(y) + 1 AS h FROM sp GROUP BY sheet_id), pg AS (SELECT sheet_id, h, CAST(unnest(range(0, CAST(ceil(h / 350.0::DOUBLE) AS BIGINT))) AS INTEGER) AS page_index FROM h),
pr AS (SELECT sheet_id, page_index, page_index * 350 AS s, least(h, page_index * 350 + 350) AS e FROM pg),
m AS (SELECT pr.sheet_id, page_index, avg(density * 0.91731::DOUBLE) FILTER (y < s + least(48, e - s)) AS t, avg(density * 0.91731::DOUBLE) FILTER (y >= e - least(48, e - s)) AS b FROM pr JOIN sp ON sp.sheet_id = pr.sheet_id AND y >= s AND y < e GROUP BY ALL)
SELECT sheet_id, page_index, round_even(t, 5) AS top_edge_density, round_even(b, 5) AS bottom_edge_density, t > 0.02 OR b > 0.02 AS suspicious,
  array_to_string(list_filter([CASE WHEN t > 0.02 THEN 'top_edge_busy' END, CASE WHEN b > 0.02 THEN 'bottom_edge_busy' END], lambda c: c IS NOT NULL), ',') AS reasons FROM m""",
)
def a4(spark, d):
    prof = X.sheet_profile(spark, d).withColumn("density", F.col("density") * 0.91731)
    h = prof.groupBy("sheet_id").agg((F.max("y") + 1).alias("h"))
    pages = h.select("sheet_id", "h", F.explode(F.sequence(F.lit(0), F.ceil(F.col("h") / 350).cast("int") - 1)).alias("page_index"))
    pages = pages.select(
        "sheet_id", "page_index", (F.col("page_index") * 350).alias("y_start"), F.least("h", F.col("page_index") * 350 + 350).alias("y_end")
    )
    out = P.page_diagnostics(prof, pages, KEY)
    return out.select(
        "sheet_id", "page_index", "top_edge_density", "bottom_edge_density", "suspicious", F.array_join("warning_reasons", ",").alias("reasons")
    )


# Packing at a target of 700 rows: pad 8, soft 714, hard 770, underfill 630.
PACK = """bn AS (SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY band_start) AS n, greatest(0, band_start - 8) AS s, least(h, band_end + 8) AS e FROM bands JOIN qt USING (sheet_id)),
pk AS (SELECT sheet_id, n, s AS cs, e AS ce, true AS np FROM bn WHERE n = 1
  UNION ALL
  SELECT b.sheet_id, b.n, CASE WHEN x.ext THEN r.cs ELSE b.s END, b.e, NOT x.ext FROM pk r JOIN bn b ON b.sheet_id = r.sheet_id AND b.n = r.n + 1,
  LATERAL (SELECT b.e - r.cs <= 714 OR (r.ce - r.cs < 630 AND b.e - r.cs <= 770) AS ext) x),
pn AS (SELECT *, sum(CASE WHEN np THEN 1 ELSE 0 END) OVER (PARTITION BY sheet_id ORDER BY n) - 1 AS pg FROM pk),
ranges AS (SELECT sheet_id, CAST(pg AS INTEGER) AS range_no, CAST(min(cs) AS INTEGER) AS y_start, CAST(max(ce) AS INTEGER) AS y_end FROM pn GROUP BY sheet_id, pg)"""


def _ranges(prof, min_len=9):
    sheets = prof.groupBy("sheet_id").agg((F.max("y") + 1).alias("h"))
    small = fits(prof, KEY)
    bands = _bands(prof, min_len, small).join(sheets, KEY)
    return P.pack_bands(bands, KEY, height=F.col("h"), target=F.lit(700), small=small), sheets


@query("q7_pack_bands", f"""WITH RECURSIVE {SP}, {QUANT.format(t="sp")}, {BANDS.format(t="sp", m=9)}, {PACK} SELECT * FROM ranges""")
def q7(spark, d):
    return _ranges(X.sheet_profile(spark, d))[0]


# Ranges stretched by 40 rows each way overlap their neighbours.
@query(
    "q8_resolve_overlaps",
    f"""WITH RECURSIVE {SP}, {QUANT.format(t="sp")}, {BANDS.format(t="sp", m=9)}, {PACK},
st AS (SELECT sheet_id, range_no, greatest(0, y_start - 40) AS s, CAST(least(h, y_end + 40) AS INTEGER) AS e FROM ranges JOIN qt USING (sheet_id)),
pv AS (SELECT *, lag(e) OVER (PARTITION BY sheet_id ORDER BY range_no) AS pe FROM st),
ca AS (SELECT pv.sheet_id, range_no, arg_min(y, ROW(density, y)) AS c FROM pv JOIN sp ON sp.sheet_id = pv.sheet_id AND y >= s AND y < pe GROUP BY ALL),
al AS (SELECT pv.*, c FROM pv LEFT JOIN ca USING (sheet_id, range_no)),
wk AS (SELECT sheet_id, range_no, s AS ns, e, NULL::INTEGER AS cut FROM al WHERE range_no = 0
  UNION ALL
  SELECT a.sheet_id, a.range_no, CASE WHEN x.ok THEN CAST(x.b AS INTEGER) ELSE a.s END, a.e, CASE WHEN x.ok THEN CAST(x.b AS INTEGER) END FROM wk r JOIN al a ON a.sheet_id = r.sheet_id AND a.range_no = r.range_no + 1,
  LATERAL (SELECT coalesce(a.s < a.pe AND greatest(r.ns + 1, a.s) <= least(a.pe - 1, a.e - 1), false) AS ok, least(greatest(a.c, greatest(r.ns + 1, a.s)), least(a.pe - 1, a.e - 1)) AS b) x)
SELECT sheet_id, range_no, ns AS y_start, coalesce(lead(cut) OVER (PARTITION BY sheet_id ORDER BY range_no), e) AS y_end FROM wk""",
)
def q8(spark, d):
    prof = X.sheet_profile(spark, d)
    ranges, sheets = _ranges(prof)
    wide = ranges.join(sheets, KEY).select(
        "sheet_id", "range_no", "h", F.greatest(F.lit(0), F.col("y_start") - 40).alias("y_start"), F.least("h", F.col("y_end") + 40).alias("y_end")
    )
    return P.resolve_overlaps(wide, prof, KEY, height=F.col("h"))


def _slice_sql(target: int, mode: str) -> str:
    """Whitespace slicing as a recursive walk over per-sheet density lists (dn), with seam means (sm)."""
    p = C.PAGINATION[mode]
    min_h = max(180, int(target * p["min_page"]))
    back, ahead, close = int(target * p["back"]), int(target * p["forward"]), int(target * 0.09)
    tail = max(84, int(target * p["tail"]))
    hard, soft = int(target * p["tail_hard"]), int(target * p["tail_soft"])
    lit = lambda v: f"{v!r}::DOUBLE"
    early = "list_position(bk, list_min(bk)) - 1"
    near = "nr"
    if mode == "performance":
        early = f"coalesce(list_max(list_filter(range(0, len(bk)), lambda i: bk[i + 1] <= b * 0.96::DOUBLE)), {early})"
        near = f"CASE WHEN len(list_filter(nr, lambda y: y >= greatest(s + {min_h}, hd - {close}))) > 0 THEN list_filter(nr, lambda y: y >= greatest(s + {min_h}, hd - {close})) ELSE nr END"
    return f"""WITH RECURSIVE {SP}, {QUANT.format(t="sp")},
sd AS (SELECT sheet_id, y, density, avg(density) OVER (PARTITION BY sheet_id ORDER BY y ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS sm FROM sp),
ls AS (SELECT sheet_id, CAST(count(*) AS INTEGER) AS h, list(density ORDER BY y) AS dn, list(sm ORDER BY y) AS sm, greatest(0.0025::DOUBLE, least(0.018::DOUBLE, any_value(p28) * 1.35::DOUBLE)) AS b FROM sd JOIN qt USING (sheet_id) GROUP BY sheet_id),
wk AS (SELECT sheet_id, 0 AS s, 0 AS e FROM ls
  UNION ALL
  SELECT w.sheet_id, w.e AS s, CASE WHEN f.hd >= h THEN h ELSE CAST(z.cut AS INTEGER) END AS e FROM (SELECT * FROM wk) w JOIN ls USING (sheet_id),
  LATERAL (SELECT w.e AS s, least(h, w.e + {target}) AS hd) f,
  LATERAL (SELECT greatest(f.s + {min_h}, hd - {back}) AS lo, least(h - 1, hd + {ahead}) AS hi) g,
  LATERAL (SELECT dn[lo + 1 : hd] AS bk, dn[hd + 1 : hi + 1] AS fw) i,
  LATERAL (SELECT lo + {early} AS early) j,
  LATERAL (SELECT CASE WHEN hd > lo AND (dn[early + 1] <= b * {lit(p["back_blank"])} OR dn[early + 1] < dn[hd] * {lit(p["back_ratio"])}) THEN early ELSE hd END AS c1) k,
  LATERAL (SELECT hd + list_position(fw, list_min(fw)) - 1 AS late) l,
  LATERAL (SELECT CASE WHEN (c1 - f.s < {min_h} OR dn[c1] > b * 1.25::DOUBLE) AND hi > hd AND dn[late + 1] <= dn[c1] * 0.94::DOUBLE THEN late ELSE c1 END AS c2) m,
  LATERAL (SELECT least(greatest(c2, f.s + {min_h}), h) AS c3) n,
  LATERAL (SELECT list_filter(range(lo, hi + 1), lambda y: dn[y + 1] <= b) AS nr) o,
  LATERAL (SELECT {near.replace("s +", "f.s +")} AS nq) q,
  LATERAL (SELECT list_transform(nq, lambda y: abs(y - hd)) AS far) r,
  LATERAL (SELECT nq[list_position(far, list_min(far))] AS pick) t,
  LATERAL (SELECT CASE WHEN dn[c3] > b * 1.12::DOUBLE AND len(nr) > 0 AND pick - f.s >= {max(96, int(min_h * 0.42))} THEN pick ELSE c3 END AS c4) u,
  LATERAL (SELECT list_transform(range(greatest(f.s + {min_h}, lo), hi + 1), lambda y: sm[y + 1] + abs(y - hd) * 0.00018::DOUBLE) AS sc) v,
  LATERAL (SELECT CASE WHEN c4 - f.s < {min_h} OR sm[c4 + 1] <= 0.0105 OR hi <= greatest(f.s + {min_h}, lo) THEN c4
     WHEN list_min(sc) < sm[c4 + 1] + abs(c4 - hd) * 0.00018::DOUBLE AND list_min(sc) < sm[c4 + 1] * 0.92::DOUBLE THEN greatest(f.s + {min_h}, lo) + list_position(sc, list_min(sc)) - 1 ELSE c4 END AS cut) z
  WHERE w.e < h),
pgs AS (SELECT sheet_id, h, CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY e) - 1 AS INTEGER) AS page_index, s AS y_start, e AS y_end FROM wk JOIN ls USING (sheet_id) WHERE e > 0),
n AS (SELECT sheet_id, max(page_index) AS last FROM pgs GROUP BY sheet_id),
up AS (SELECT p.sheet_id, p.page_index, p.y_start AS ts, true AS go, h FROM pgs p JOIN n ON n.sheet_id = p.sheet_id AND page_index = last
  UNION ALL
  SELECT p.sheet_id, p.page_index, CASE WHEN x.ok THEN p.y_start ELSE u.ts END, x.ok, u.h FROM up u JOIN pgs p ON p.sheet_id = u.sheet_id AND p.page_index = u.page_index - 1,
  LATERAL (SELECT u.go AND u.h - u.ts < {tail} AND (u.h - p.y_start <= {hard} OR (u.h - u.ts <= {int(tail * 0.62)} AND u.h - p.y_start <= {soft})) AS ok) x),
tl AS (SELECT sheet_id, min(ts) AS ts FROM up GROUP BY sheet_id)
SELECT sheet_id, page_index, y_start, CASE WHEN y_start = ts THEN h ELSE y_end END AS y_end FROM pgs JOIN tl USING (sheet_id) WHERE y_start <= ts"""


@query("q9_slice_by_whitespace", _slice_sql(600, "performance"))
def q9(spark, d):
    return P.slice_by_whitespace(X.sheet_profile(spark, d), KEY, target=F.lit(600), mode="performance")


@query("q9_slice_balanced", _slice_sql(500, "balanced"))
def q9b(spark, d):
    return P.slice_by_whitespace(X.sheet_profile(spark, d), KEY, target=F.lit(500), mode="balanced")


# Sheets cut every 300 + 31 * sheet rows; the tail joins the page before while it is short.
TILES = """h AS (SELECT sheet_id, max(y) + 1 AS h FROM sp GROUP BY sheet_id),
tl AS (SELECT sheet_id, h, unnest(range(0, CAST(ceil(h / CAST(60 + 97 * sheet_id AS DOUBLE)) AS BIGINT))) AS page_index, 60 + 97 * sheet_id AS p FROM h),
pgs AS (SELECT sheet_id, h, CAST(page_index AS INTEGER) AS page_index, CAST(page_index * p AS INTEGER) AS y_start, CAST(least(h, page_index * p + p) AS INTEGER) AS y_end FROM tl)"""


@query(
    "q10_merge_short_tail",
    f"""WITH RECURSIVE {SP}, {TILES}, n AS (SELECT sheet_id, max(page_index) AS last FROM pgs GROUP BY sheet_id),
up AS (SELECT p.sheet_id, p.page_index, p.y_start AS ts, true AS go, h FROM pgs p JOIN n ON n.sheet_id = p.sheet_id AND page_index = last
  UNION ALL
  SELECT p.sheet_id, p.page_index, CASE WHEN x.ok THEN p.y_start ELSE u.ts END, x.ok, u.h FROM up u JOIN pgs p ON p.sheet_id = u.sheet_id AND p.page_index = u.page_index - 1,
  LATERAL (SELECT u.go AND u.h - u.ts < 252 AND (u.h - p.y_start <= 708 OR (u.h - u.ts <= 156 AND u.h - p.y_start <= 744)) AS ok) x),
tail AS (SELECT sheet_id, min(ts) AS ts FROM up GROUP BY sheet_id)
SELECT sheet_id, page_index, y_start, CASE WHEN y_start = ts THEN CAST(h AS INTEGER) ELSE y_end END AS y_end FROM pgs JOIN tail USING (sheet_id) WHERE y_start <= ts""",
)
def q10(spark, d):
    h = X.sheet_profile(spark, d).groupBy("sheet_id").agg((F.max("y") + 1).alias("h"))
    step = 60 + 97 * F.col("sheet_id")
    pages = h.select("sheet_id", "h", F.explode(F.sequence(F.lit(0), F.ceil(F.col("h") / step).cast("int") - 1)).alias("page_index"))
    pages = pages.select(
        "sheet_id", "h", "page_index", (F.col("page_index") * step).alias("y_start"), F.least("h", F.col("page_index") * step + step).alias("y_end")
    )
    return P.merge_short_tail(pages, KEY, target=F.lit(600), height=F.col("h"))


def _split(spark, d, mode):
    prof = X.sheet_profile(spark, d)
    # Some sheets wide enough for one page, the others narrow.
    width = F.when(F.col("sheet_id") == 3, 1900).otherwise(450 + F.col("sheet_id") * 20)
    sheets = prof.groupBy("sheet_id").agg((F.max("y") + 1).alias("height")).withColumn("width", width)
    return P.split_pages(prof, sheets, KEY, mode=mode)


def _scale_sql(h: str, w: str) -> str:
    """Scale at which a page fits its own print canvas."""
    mx = f"greatest(10, CAST(floor({w} * 0.015::DOUBLE) AS INTEGER))"
    ends = f"(greatest(14, CAST(floor({h} * 0.026::DOUBLE) AS INTEGER)) + greatest(24, CAST(floor({h} * 0.056::DOUBLE) AS INTEGER)))"
    ch = f"greatest({ends} + 1, CAST(round_even(({w} + 2 * {mx}) / (1.0::DOUBLE / 1.4142::DOUBLE), 0) AS INTEGER))"
    return f"least(1.0::DOUBLE, greatest(1, {ch} - {ends}) / CAST({h} AS DOUBLE))"


def _split_sql(mode: str) -> str:
    """The whole page decision: bands packed and parted, checked, and sliced at whitespace where that fails."""
    p = C.PAGINATION[mode]
    part = lambda share, of="t": f"CAST(floor({of} * {share!r}::DOUBLE) AS INTEGER)"
    lit = lambda v: f"{v!r}::DOUBLE"
    pad = f"greatest(6, {part(0.012)})" if mode == "performance" else f"greatest(8, {part(0.012, 'h')})"
    early = "list_position(bk, list_min(bk)) - 1"
    near = "nr"
    if mode == "performance":
        early = f"coalesce(list_max(list_filter(range(0, len(bk)), lambda i: bk[i + 1] <= b * 0.96::DOUBLE)), {early})"
        near = "CASE WHEN len(list_filter(nr, lambda y: y >= greatest(f.s + min_h, hd - n_close))) > 0 THEN list_filter(nr, lambda y: y >= greatest(f.s + min_h, hd - n_close)) ELSE nr END"
    one = lit(p["single"])
    return f"""WITH RECURSIVE {SP},
sh AS (SELECT *, greatest(900, least(2600, CAST(round_even(w / (1.0::DOUBLE / 1.4142::DOUBLE), 0) AS INTEGER))) AS t FROM (
  SELECT sheet_id, CAST(max(y) + 1 AS INTEGER) AS h, CASE WHEN sheet_id = 3 THEN 1900 ELSE 450 + sheet_id * 20 END AS w FROM sp GROUP BY sheet_id) AS a),
ta AS (SELECT * FROM sh WHERE {_scale_sql("h", "w")} < {one}),
qu AS (SELECT sheet_id, quantile_cont(density::DOUBLE, 0.72) AS p72 FROM sp GROUP BY sheet_id),
act AS (SELECT sp.sheet_id, sp.y, y - row_number() OVER (PARTITION BY sp.sheet_id ORDER BY y) AS isl, h FROM sp JOIN ta USING (sheet_id) JOIN qu USING (sheet_id) WHERE density > greatest(0.004::DOUBLE, least(0.03::DOUBLE, p72 * 0.34::DOUBLE))),
bands AS (SELECT sheet_id, CAST(min(y) AS INTEGER) AS band_start, CAST(max(y) + 1 AS INTEGER) AS band_end FROM act GROUP BY sheet_id, isl, h HAVING count(*) >= greatest(6, {part(0.004, 'h')})),
bn AS (SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY band_start) AS n, greatest(0, band_start - {pad}) AS s, least(h, band_end + {pad}) AS e, {part(p["soft"])} AS soft, {part(p["hard"])} AS hard, {part(p["underfill"])} AS under FROM bands JOIN ta USING (sheet_id)),
pk AS (SELECT sheet_id, n, s AS cs, e AS ce, true AS np FROM bn WHERE n = 1
  UNION ALL
  SELECT b.sheet_id, b.n, CASE WHEN x.ext THEN r.cs ELSE b.s END, b.e, NOT x.ext FROM pk r JOIN bn b ON b.sheet_id = r.sheet_id AND b.n = r.n + 1,
  LATERAL (SELECT b.e - r.cs <= b.soft OR (b.under > 0 AND r.ce - r.cs < b.under AND b.e - r.cs <= b.hard) AS ext) x),
pn AS (SELECT *, sum(CASE WHEN np THEN 1 ELSE 0 END) OVER (PARTITION BY sheet_id ORDER BY n) - 1 AS pg FROM pk),
rg AS (SELECT sheet_id, CAST(pg AS INTEGER) AS range_no, CAST(min(cs) AS INTEGER) AS s, CAST(max(ce) AS INTEGER) AS e FROM pn GROUP BY sheet_id, pg),
pv AS (SELECT *, lag(e) OVER (PARTITION BY sheet_id ORDER BY range_no) AS pe FROM rg),
ca AS (SELECT pv.sheet_id, range_no, arg_min(y, ROW(density, y)) AS c FROM pv JOIN sp ON sp.sheet_id = pv.sheet_id AND y >= s AND y < pe GROUP BY ALL),
al AS (SELECT pv.*, c FROM pv LEFT JOIN ca USING (sheet_id, range_no)),
sg AS (SELECT sheet_id, range_no, s AS ns, e, NULL::INTEGER AS cut FROM al WHERE range_no = 0
  UNION ALL
  SELECT a.sheet_id, a.range_no, CASE WHEN x.ok THEN CAST(x.b AS INTEGER) ELSE a.s END, a.e, CASE WHEN x.ok THEN CAST(x.b AS INTEGER) END FROM sg r JOIN al a ON a.sheet_id = r.sheet_id AND a.range_no = r.range_no + 1,
  LATERAL (SELECT coalesce(a.s < a.pe AND greatest(r.ns + 1, a.s) <= least(a.pe - 1, a.e - 1), false) AS ok, least(greatest(a.c, greatest(r.ns + 1, a.s)), least(a.pe - 1, a.e - 1)) AS b) x),
rr AS (SELECT sheet_id, range_no, ns AS ys, CAST(coalesce(lead(cut) OVER (PARTITION BY sheet_id ORDER BY range_no), e) AS INTEGER) AS ye FROM sg),
gp AS (SELECT rr.*, h, w, t, lead(ys) OVER (PARTITION BY sheet_id ORDER BY ys, ye) - ye AS gap, ye - ys > {part(C.OVERSIZE)} AS big FROM rr JOIN ta USING (sheet_id)),
vd AS (SELECT sheet_id, bool_or(coalesce(gap > greatest(6, {part(0.004)}), false)) OR (count(*) = 1 AND NOT bool_or(big) AND max({_scale_sql("(ye - ys)", "w")}) < {one}) AS whole FROM gp GROUP BY sheet_id),
pa AS (SELECT sheet_id, h, w, t, 0 AS lo_y, h AS hi_y FROM ta LEFT JOIN vd USING (sheet_id) WHERE coalesce(whole, true)
  UNION ALL SELECT sheet_id, h, w, t, ys, ye FROM gp JOIN vd USING (sheet_id) WHERE NOT whole AND big),
pc AS (SELECT pa.sheet_id, lo_y, w, t, y - lo_y AS y, density FROM pa JOIN sp ON sp.sheet_id = pa.sheet_id AND y >= lo_y AND y < hi_y),
sd AS (SELECT *, avg(density) OVER (PARTITION BY sheet_id, lo_y ORDER BY y ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS sm FROM pc),
l0 AS (SELECT sheet_id, lo_y, w, t, CAST(count(*) AS INTEGER) AS h, list(density ORDER BY y) AS dn, list(sm ORDER BY y) AS sm, greatest(0.0025::DOUBLE, least(0.018::DOUBLE, quantile_cont(density::DOUBLE, 0.28) * 1.35::DOUBLE)) AS b FROM sd GROUP BY sheet_id, lo_y, w, t),
l1 AS (SELECT *, greatest(180, {part(p["min_page"])}) AS min_h, {part(p["back"])} AS n_back, {part(p["forward"])} AS n_ahead, {part(0.09)} AS n_close, greatest(84, {part(p["tail"])}) AS n_tail, {part(p["tail_hard"])} AS n_hard, {part(p["tail_soft"])} AS n_soft FROM l0),
ls AS (SELECT *, greatest(96, {part(0.42, 'min_h')}) AS n_least FROM l1),
wk AS (SELECT sheet_id, lo_y, 0 AS s, 0 AS e FROM ls
  UNION ALL
  SELECT w0.sheet_id, w0.lo_y, w0.e AS s, CASE WHEN f.hd >= h THEN h ELSE CAST(z.cut AS INTEGER) END AS e FROM (SELECT * FROM wk) w0 JOIN ls USING (sheet_id, lo_y),
  LATERAL (SELECT w0.e AS s, least(h, w0.e + t) AS hd) f,
  LATERAL (SELECT greatest(f.s + min_h, hd - n_back) AS lo, least(h - 1, hd + n_ahead) AS hi) g,
  LATERAL (SELECT dn[lo + 1 : hd] AS bk, dn[hd + 1 : hi + 1] AS fw) i,
  LATERAL (SELECT lo + {early} AS early) j,
  LATERAL (SELECT CASE WHEN hd > lo AND (dn[early + 1] <= b * {lit(p["back_blank"])} OR dn[early + 1] < dn[hd] * {lit(p["back_ratio"])}) THEN early ELSE hd END AS c1) k,
  LATERAL (SELECT hd + list_position(fw, list_min(fw)) - 1 AS late) l,
  LATERAL (SELECT CASE WHEN (c1 - f.s < min_h OR dn[c1] > b * 1.25::DOUBLE) AND hi > hd AND dn[late + 1] <= dn[c1] * 0.94::DOUBLE THEN late ELSE c1 END AS c2) m,
  LATERAL (SELECT least(greatest(c2, f.s + min_h), h) AS c3) n,
  LATERAL (SELECT list_filter(range(lo, hi + 1), lambda y: dn[y + 1] <= b) AS nr) o,
  LATERAL (SELECT {near} AS nq) q,
  LATERAL (SELECT list_transform(nq, lambda y: abs(y - hd)) AS far) r,
  LATERAL (SELECT nq[list_position(far, list_min(far))] AS pick) x,
  LATERAL (SELECT CASE WHEN dn[c3] > b * 1.12::DOUBLE AND len(nr) > 0 AND pick - f.s >= n_least THEN pick ELSE c3 END AS c4) u,
  LATERAL (SELECT list_transform(range(greatest(f.s + min_h, lo), hi + 1), lambda y: sm[y + 1] + abs(y - hd) * 0.00018::DOUBLE) AS sc) v,
  LATERAL (SELECT CASE WHEN c4 - f.s < min_h OR sm[c4 + 1] <= 0.0105 OR hi <= greatest(f.s + min_h, lo) THEN c4
     WHEN list_min(sc) < sm[c4 + 1] + abs(c4 - hd) * 0.00018::DOUBLE AND list_min(sc) < sm[c4 + 1] * 0.92::DOUBLE THEN greatest(f.s + min_h, lo) + list_position(sc, list_min(sc)) - 1 ELSE c4 END AS cut) z
  WHERE w0.e < h),
pgs AS (SELECT sheet_id, lo_y, h, w, n_tail, n_hard, n_soft, CAST(row_number() OVER (PARTITION BY sheet_id, lo_y ORDER BY e) - 1 AS INTEGER) AS page_index, s AS y_start, e AS y_end FROM wk JOIN ls USING (sheet_id, lo_y) WHERE e > 0),
ln AS (SELECT sheet_id, lo_y, max(page_index) AS last FROM pgs GROUP BY sheet_id, lo_y),
up AS (SELECT p.sheet_id, p.lo_y, p.page_index, p.y_start AS ts, true AS go FROM pgs p JOIN ln USING (sheet_id, lo_y) WHERE page_index = last
  UNION ALL
  SELECT p.sheet_id, p.lo_y, p.page_index, CASE WHEN x.ok THEN p.y_start ELSE u.ts END, x.ok FROM up u JOIN pgs p ON p.sheet_id = u.sheet_id AND p.lo_y = u.lo_y AND p.page_index = u.page_index - 1,
  LATERAL (SELECT u.go AND p.h - u.ts < n_tail AND (p.h - p.y_start <= n_hard OR (p.h - u.ts <= {part(0.62, 'n_tail')} AND p.h - p.y_start <= n_soft)) AND {_scale_sql("(p.h - p.y_start)", "p.w")} >= {one} AS ok) x),
tl AS (SELECT sheet_id, lo_y, min(ts) AS ts FROM up GROUP BY sheet_id, lo_y),
fin AS (SELECT sheet_id, y_start + lo_y AS y_start, CASE WHEN y_start = ts THEN h ELSE y_end END + lo_y AS y_end FROM pgs JOIN tl USING (sheet_id, lo_y) WHERE y_start <= ts
  UNION ALL SELECT sheet_id, 0, h FROM sh WHERE {_scale_sql("h", "w")} >= {one}
  UNION ALL SELECT sheet_id, ys, ye FROM gp JOIN vd USING (sheet_id) WHERE NOT whole AND NOT big)
SELECT sheet_id, CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY y_start) - 1 AS INTEGER) AS page_index, CAST(y_start AS INTEGER) AS y_start, CAST(y_end AS INTEGER) AS y_end FROM fin"""


@query("q11_split_balanced", _split_sql("balanced"))
def q11c(spark, d):
    return _split(spark, d, "balanced")


@query("q11_split_pages", _split_sql("performance"))
def q11(spark, d):
    return _split(spark, d, "performance")


@query(
    "q11_pages_ordered",
    f"""WITH {SP} SELECT sheet_id, CAST(0 AS BIGINT) AS overlaps, CAST(0 AS BIGINT) AS wide_gaps, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS empty FROM sp GROUP BY sheet_id""",
)
def q11b(spark, d):
    """Pages of a sheet are disjoint, ordered, inside the sheet, and leave no gap wider than allowed."""
    prof = X.sheet_profile(spark, d)
    h = prof.groupBy("sheet_id").agg((F.max("y") + 1).alias("h"))
    pages = Ordered(_split(spark, d, "balanced"), KEY, ["y_start"]).neighbour("_before", F.col("y_end")).result().join(h, KEY)
    gap = F.col("y_start") - F.col("_before")
    return pages.groupBy("sheet_id").agg(
        F.count_if(gap < 0).alias("overlaps"),
        F.count_if(gap > 10).alias("wide_gaps"),
        F.count_if((F.col("y_start") < 0) | (F.col("y_end") > F.col("h"))).alias("outside"),
        F.count_if(F.col("y_end") <= F.col("y_start")).alias("empty"),
    )


# The same pages as printed: widths of 300, 48 canvas rows at either end.
@query(
    "a4_canvas_diagnostics",
    f"""WITH {SP}, h AS (SELECT sheet_id, max(y) + 1 AS h FROM sp GROUP BY sheet_id), pg AS (SELECT sheet_id, h, CAST(unnest(range(0, CAST(ceil(h / 350.0::DOUBLE) AS BIGINT))) AS INTEGER) AS page_index FROM h),
pr AS (SELECT sheet_id, page_index, page_index * 350 AS s, least(h, page_index * 350 + 350) - page_index * 350 AS n FROM pg),
l AS (SELECT sheet_id, max(n) AS h, 300 AS w FROM pr GROUP BY sheet_id),
c AS (SELECT *, greatest(10, CAST(floor(w * 0.015::DOUBLE) AS INTEGER)) AS mx, greatest(14, CAST(floor(h * 0.026::DOUBLE) AS INTEGER)) AS mt, greatest(24, CAST(floor(h * 0.056::DOUBLE) AS INTEGER)) AS mb FROM l),
e AS (SELECT *, w + 2 * mx AS cw, greatest(mt + mb + 1, CAST(round_even((w + 2 * mx) / (1.0::DOUBLE / 1.4142::DOUBLE), 0) AS INTEGER)) AS ch FROM c),
sc AS (SELECT *, least(1.0::DOUBLE, (cw - 2 * mx) / CAST(w AS DOUBLE), greatest(1, ch - mt - mb) / CAST(h AS DOUBLE)) AS sc FROM e),
d AS (SELECT pr.*, cw, ch, mt, mb, CASE WHEN sc < 0.999 THEN greatest(1, CAST(round_even(300 * sc, 0) AS INTEGER)) ELSE 300 END AS dw, CASE WHEN sc < 0.999 THEN greatest(1, CAST(round_even(n * sc, 0) AS INTEGER)) ELSE n END AS dh FROM pr JOIN sc USING (sheet_id)),
f AS (SELECT *, CASE WHEN mt + dh > ch - mb THEN greatest(mt, ch - mb - dh) ELSE mt END AS y0 FROM d),
r AS (SELECT *, unnest(range(y0, least(y0 + dh, ch))) AS line FROM f),
g AS (SELECT r.*, density * 0.91731::DOUBLE * dw / cw / least(48, ch) AS ink FROM r JOIN sp ON sp.sheet_id = r.sheet_id AND sp.y = s + CAST(floor((line - y0) * n / CAST(dh AS DOUBLE)) AS INTEGER)),
m AS (SELECT sheet_id, page_index, coalesce(sum(ink) FILTER (line < 48), 0) AS t, coalesce(sum(ink) FILTER (line >= ch - 48), 0) AS b FROM g GROUP BY ALL)
SELECT sheet_id, page_index + 1 AS page_index, round_even(t, 5) AS top_edge_density, round_even(b, 5) AS bottom_edge_density, t > 0.02 OR b > 0.02 AS suspicious FROM m""",
)
def a4b(spark, d):
    prof = X.sheet_profile(spark, d).withColumn("density", F.col("density") * 0.91731)
    h = prof.groupBy("sheet_id").agg((F.max("y") + 1).alias("h"))
    pages = h.select("sheet_id", "h", F.explode(F.sequence(F.lit(0), F.ceil(F.col("h") / 350).cast("int") - 1)).alias("page_index"))
    start = F.col("page_index") * 350
    pages = pages.select("sheet_id", "page_index", start.alias("y_start"), (F.least("h", start + 350) - start).alias("height"), F.lit(300).alias("width"))
    out = P.canvas_diagnostics(prof, P.frame_pages(pages, KEY), KEY)
    return out.select("sheet_id", "page_index", "top_edge_density", "bottom_edge_density", "suspicious")


@query(
    "q12_frame_pages",
    """WITH p AS (SELECT p_brand, p_partkey, CAST(p_size * 40 + 600 AS INTEGER) AS width, CAST(900 + p_partkey % 1900 AS INTEGER) AS height FROM part),
l AS (SELECT p_brand, max(width) AS w, max(height) AS h FROM p GROUP BY p_brand),
c AS (SELECT *, greatest(10, CAST(floor(w * 0.015::DOUBLE) AS INTEGER)) AS mx, greatest(14, CAST(floor(h * 0.026::DOUBLE) AS INTEGER)) AS mt, greatest(24, CAST(floor(h * 0.056::DOUBLE) AS INTEGER)) AS mb FROM l),
e AS (SELECT *, w + 2 * mx AS cw, greatest(mt + mb + 1, CAST(round_even((w + 2 * mx) / (1.0::DOUBLE / 1.4142::DOUBLE), 0) AS INTEGER)) AS ch FROM c),
s AS (SELECT *, least(1.0::DOUBLE, (cw - 2 * mx) / CAST(w AS DOUBLE), greatest(1, ch - mt - mb) / CAST(h AS DOUBLE)) AS sc FROM e),
d AS (SELECT p_partkey, p.p_brand, cw, ch, mx, mt, mb, sc, CASE WHEN sc < 0.999 THEN greatest(1, CAST(round_even(width * sc, 0) AS INTEGER)) ELSE width END AS dw, CASE WHEN sc < 0.999 THEN greatest(1, CAST(round_even(height * sc, 0) AS INTEGER)) ELSE height END AS dh FROM p JOIN s USING (p_brand))
SELECT p_partkey, cw AS canvas_w, ch AS canvas_h, """ + r6s("sc") + """ AS scale, dw AS draw_w, dh AS draw_h, mx + greatest(0, CAST(floor((greatest(1, cw - 2 * mx) - dw) / 2.0::DOUBLE) AS INTEGER)) AS x0,
  CASE WHEN mt + dh > ch - mb THEN greatest(mt, ch - mb - dh) ELSE mt END AS y0 FROM d""",
)
def q12(spark, d):
    pages = X.table(spark, d, "part").select(
        "p_brand", "p_partkey", (F.col("p_size") * 40 + 600).cast("int").alias("width"), (900 + F.pmod("p_partkey", F.lit(1900))).cast("int").alias("height")
    )
    out = P.frame_pages(pages, ["p_brand"])
    return out.select("p_partkey", "canvas_w", "canvas_h", r6(F.col("scale")).alias("scale"), "draw_w", "draw_h", "x0", "y0")
