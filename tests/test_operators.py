"""Single operators on small made inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow import constants as C
from folioflow import kernels as K
from folioflow.functions import geometry as G
from folioflow.functions import numbers as N
from folioflow.functions import text as T
from folioflow.operators import aggregates as A
from folioflow.operators import folds as Q
from folioflow.operators import frames as FR
from folioflow.operators import joins as J
from folioflow.operators import pagination as P
from folioflow.operators import projections as PR
from folioflow.operators import windows as W
from folioflow.runs import Fold, Ordered, ordered_fold
from folioflow.sources import readers as R
from folioflow.sources import writers as WR

RNG = np.random.default_rng(7)


def staff_page(h, w, tops, lines=5, gap=10):
    """White image with groups of five dark lines."""
    img = np.full((h, w), 255, np.uint8)
    for top in tops:
        for i in range(lines):
            y = top + i * gap
            if y + 2 <= h:
                img[y : y + 2, 20 : w - 20] = 0
    return img


def frames_df(spark, images, key="a", start=0):
    rows = [
        (key, start + i, float(i), None if img is None else bytearray(img.tobytes()), 0 if img is None else img.shape[1], 0 if img is None else img.shape[0])
        for i, img in enumerate(images)
    ]
    return spark.createDataFrame(rows, "source_id string, frame_index int, ts_sec double, px binary, width int, height int")


def profile_df(spark, density, key=1):
    return spark.createDataFrame(
        [(key, y, float(v)) for y, v in enumerate(density)], "sheet_id int, y int, density double"
    )


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# --- pagination ---------------------------------------------------------------------------


def test_page_sets_share_one_portrait_canvas(spark):
    pages = spark.createDataFrame([(1, 0, 1800, 1500), (1, 1, 1800, 2100)], "k int, page_index int, width int, height int")
    rows = P.frame_pages(pages, ["k"]).collect()
    assert len({(r.canvas_w, r.canvas_h) for r in rows}) == 1 and rows[0].canvas_h > rows[0].canvas_w
    assert all(r.x0 >= r.margin_x and r.y0 >= r.margin_top for r in rows)


def test_overlapping_ranges_become_disjoint(spark):
    density = np.full(7444, 0.02)
    for lo, hi in ((2190, 2230), (4375, 4405), (6640, 6670)):
        density[lo:hi] = 0.0009
    ranges = spark.createDataFrame(
        [(1, i, s, e) for i, (s, e) in enumerate([(0, 2259), (2172, 4440), (4347, 6726), (6628, 7444)])],
        "sheet_id int, range_no int, y_start int, y_end int",
    )
    out = P.resolve_overlaps(ranges, profile_df(spark, density), ["sheet_id"], height=F.lit(7444)).orderBy("range_no").collect()
    assert len(out) == 4 and out[0].y_start == 0 and out[-1].y_end == 7444
    assert all(a.y_end == b.y_start for a, b in zip(out, out[1:]))
    assert 2190 <= out[0].y_end <= 2230


def slices(spark, density, target, mode="performance", **kw):
    out = P.slice_by_whitespace(profile_df(spark, density), ["sheet_id"], target=F.lit(target), mode=mode, **kw)
    return [(r.y_start, r.y_end) for r in out.orderBy("page_index").collect()]


def test_slices_fall_into_valleys_and_tile(spark):
    density = np.full(6200, 0.02)
    for y in (2050, 4100):
        density[y - 12 : y + 12] = 0.0008
    pages = slices(spark, density, 2000)
    assert len(pages) >= 3 and sum(e - s for s, e in pages) == 6200
    assert all(a[1] == b[0] for a, b in zip(pages, pages[1:]))


def test_performance_pages_are_fuller_than_balanced(spark):
    density = np.full(6000, 0.02)
    for lo, hi, v in ((1490, 1510, 0.0010), (3490, 3510, 0.0010), (1940, 1960, 0.0022), (3940, 3960, 0.0022)):
        density[lo:hi] = v
    tight, loose = slices(spark, density, 2000), slices(spark, density, 2000, "balanced")
    assert tight[0][1] >= 1800 and tight[0][1] > loose[0][1]


def test_lone_blank_row_in_a_dense_band_is_not_a_seam(spark):
    density = np.full(4300, 0.018)
    density[1936:1964], density[1948:1952], density[2050:2080] = 0.028, 0.0010, 0.0010
    assert slices(spark, density, 2000)[0][1] >= 2045


def naive_slices(d, target, mode, fits_page=lambda rows: True):
    """The cut rules written out over the whole array, as a check on the streaming form."""
    p, tight = C.PAGINATION[mode], mode == "performance"
    h, start, pages = len(d), 0, []
    min_h = max(180, int(target * p["min_page"]))
    blank = min(max(np.percentile(d, 28) * 1.35, 0.0025), 0.018)
    seam = lambda y: d[max(0, y - 12) : min(h, y + 12)].mean()
    while start < h:
        hard = min(h, start + target)
        if hard >= h:
            pages.append((start, h))
            break
        lo, hi = max(start + min_h, hard - int(target * p["back"])), min(h - 1, hard + int(target * p["forward"]))
        cut = hard
        if hard > lo:
            back = d[lo:hard]
            hits = np.flatnonzero(back <= blank * 0.96)
            i = hits[-1] if tight and hits.size else back.argmin()
            if d[lo + i] <= blank * p["back_blank"] or d[lo + i] < d[hard - 1] * p["back_ratio"]:
                cut = lo + i
        edge = d[cut - 1]
        if (cut - start < min_h or edge > blank * 1.25) and hi > hard:
            i = hard + d[hard : hi + 1].argmin()
            cut = i if d[i] <= edge * 0.94 else cut
        cut = min(max(cut, start + min_h), h)
        if d[cut - 1] > blank * 1.12:
            near = lo + np.flatnonzero(d[lo : hi + 1] <= blank)
            if near.size:
                if tight:
                    late = near[near >= max(start + min_h, hard - int(target * 0.09))]
                    near = late if late.size else near
                pick = near[np.abs(near - hard).argmin()]
                cut = pick if pick - start >= max(96, int(min_h * 0.42)) else cut
        if cut - start >= min_h and seam(cut) > 0.0105 and min(h - 1, hi) > max(start + min_h, lo):
            ys = np.arange(max(start + min_h, lo), hi + 1)
            scores = np.array([seam(y) + abs(y - hard) * 0.00018 for y in ys])
            if scores.min() < seam(cut) + abs(cut - hard) * 0.00018 and scores.min() < seam(cut) * 0.92:
                cut = ys[scores.argmin()]
        pages.append((start, int(cut)))
        start = int(cut)
    tail, hard_cap, soft_cap = max(84, int(target * p["tail"])), int(target * p["tail_hard"]), int(target * p["tail_soft"])
    while len(pages) >= 2:
        t, both = pages[-1][1] - pages[-1][0], pages[-1][1] - pages[-2][0]
        if t >= tail or not (both <= hard_cap or (t <= int(tail * 0.62) and both <= soft_cap)) or not fits_page(both):
            break
        pages[-2:] = [(pages[-2][0], pages[-1][1])]
    return pages


@pytest.mark.parametrize("mode", ["performance", "balanced"])
@pytest.mark.parametrize("runs", [None, "400"])
def test_slices_equal_the_written_out_rule(spark, mode, runs):
    density = np.round(RNG.gamma(1.2, 0.012, 5200), 6)
    for y in RNG.integers(0, 5100, 14):
        density[y : y + RNG.integers(3, 40)] = 0.0005
    if runs:
        spark.conf.set("spark.folioflow.runRows", runs)
    try:
        assert slices(spark, density, 700, mode) == naive_slices(density, 700, mode)
    finally:
        spark.conf.unset("spark.folioflow.runRows")


def test_sparse_notation_between_systems_is_kept(spark):
    density = np.zeros(6200)
    for top in range(60, 6000, 720):
        density[top : top + 180] = 0.05
        density[top + 300 : top + 304] = 0.01
    sheets = spark.createDataFrame([(1, 1800, 6200)], "sheet_id int, width int, height int")
    pages = P.split_pages(profile_df(spark, density), sheets, ["sheet_id"]).collect()
    assert len(pages) >= 3 and sum(p.y_end - p.y_start for p in pages) == 6200


def test_slightly_oversized_sheet_is_cut(spark):
    density = np.zeros(3050)
    for top in np.linspace(60, 2850, 7).astype(int):
        density[top : top + 180] = 0.05
    sheets = spark.createDataFrame([(1, 1800, 3050)], "sheet_id int, width int, height int")
    assert P.split_pages(profile_df(spark, density), sheets, ["sheet_id"]).count() >= 2


def naive_scale(h, w, ratio):
    mx, mt, mb = max(10, int(w * 0.015)), max(14, int(h * 0.026)), max(24, int(h * 0.056))
    ch = max(mt + mb + 1, round((w + 2 * mx) / max(0.6, ratio)))
    return min(1.0, w / w, max(1, ch - mt - mb) / h)


def naive_split(d, w, mode, ratio=C.PAGE_RATIO):
    """The whole page decision for one sheet, written out step by step."""
    p, h = C.PAGINATION[mode], len(d)
    target = int(min(max(round(w / max(0.35, ratio)), 900), 2600))
    if naive_scale(h, w, ratio) >= p["single"]:
        return [(0, h)]

    def sliced(part):
        pages = naive_slices(part, target, mode, lambda rows: naive_scale(rows, w, ratio) >= p["single"])
        return pages

    cut = min(max(np.percentile(d, 72) * 0.34, 0.004), 0.03)
    edges = np.flatnonzero(np.diff(np.r_[0, (d > cut).astype(int), 0]))
    bands = [(s, e) for s, e in zip(edges[::2], edges[1::2]) if e - s >= max(6, int(h * 0.004))]
    if not bands:
        return sliced(d)
    pad = max(6, int(target * 0.012)) if mode == "performance" else max(8, int(h * 0.012))
    soft, hard, under = int(target * p["soft"]), int(target * p["hard"]), int(target * p["underfill"])
    pages = []
    for s, e in [(max(0, s - pad), min(h, e + pad)) for s, e in bands]:
        if pages:
            top, bottom = pages[-1]
            if e - top <= soft or (under > 0 and bottom - top < under and e - top <= hard):
                pages[-1] = (top, e)
                continue
        pages.append((s, e))
    apart = []
    for s, e in pages:
        if apart and s < apart[-1][1]:
            ps, pe = apart[-1]
            lo, hi = max(ps + 1, s), min(pe - 1, e - 1)
            if lo <= hi:
                s2 = int(min(max(s + d[s:pe].argmin(), lo), hi))
                apart[-1], s = (ps, s2), s2
        apart.append((s, e))
    if any(b[0] - a[1] > max(6, int(target * 0.004)) for a, b in zip(apart, apart[1:])):
        return sliced(d)
    out = []
    for s, e in apart:
        if e - s > int(target * C.OVERSIZE):
            out += [(s + a, s + b) for a, b in sliced(d[s:e])]
        else:
            out.append((s, e))
    if len(out) == 1 and naive_scale(out[0][1] - out[0][0], w, ratio) < p["single"]:
        return sliced(d)
    return out


@pytest.mark.parametrize("mode", ["performance", "balanced"])
def test_page_decision_equals_the_written_out_rules(spark, mode):
    sheets, rows, want = [], [], {}
    for key in range(14):
        h, w = int(RNG.integers(900, 5200)), int(RNG.integers(420, 900))
        d = np.round(RNG.random(h) * 0.002, 6)
        y = int(RNG.integers(0, 80))
        while y < h - 60:
            n = int(RNG.integers(40, [260, 1500][key % 2]))
            d[y : y + n] = np.round(0.02 + RNG.random(len(d[y : y + n])) * 0.04, 6)
            y += n + int(RNG.integers(3, [30, 14, 160][key % 3]))
        if key == 13:
            d[:] = 0.0
        sheets.append((key, w, h))
        rows += [(key, i, float(v)) for i, v in enumerate(d)]
        want[key] = [(int(a), int(b)) for a, b in naive_split(d, w, mode)]
    profile = spark.createDataFrame(rows, "sheet_id int, y int, density double")
    sized = spark.createDataFrame(sheets, "sheet_id int, width int, height int")
    got: dict = {}
    for r in P.split_pages(profile, sized, ["sheet_id"], mode=mode).orderBy("sheet_id", "page_index").collect():
        got.setdefault(r.sheet_id, []).append((r.y_start, r.y_end))
    assert got == want


def test_short_sheet_is_one_page(spark):
    sheets = spark.createDataFrame([(1, 1800, 1500)], "sheet_id int, width int, height int")
    pages = P.split_pages(profile_df(spark, np.full(1500, 0.02)), sheets, ["sheet_id"]).collect()
    assert [(p.y_start, p.y_end) for p in pages] == [(0, 1500)]


def test_quantiles_equal_numpy(spark):
    data = np.round(RNG.random(501), 3)
    probs = {"a": 0.72, "b": 0.28, "c": 0.01, "d": 1.0}
    row = P.density_quantiles(profile_df(spark, data), ["sheet_id"], probs).first()
    assert all(math.isclose(row[n], np.percentile(data, q * 100), rel_tol=1e-12) for n, q in probs.items())


# --- frames -------------------------------------------------------------------------------


def test_adaptive_ink_equals_the_direct_sum(spark):
    img = RNG.integers(0, 256, (9, 11)).astype(np.uint8)
    block, c = 5, 7
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(block) - 2) ** 2) / (2 * sigma**2))
    w = np.outer(w, w) / w.sum() ** 2
    want = np.zeros(img.shape, bool)
    for y in range(9):
        for x in range(11):
            near = [[img[min(8, max(0, y + i - 2)), min(10, max(0, x + j - 2))] for j in range(block)] for i in range(block)]
            want[y, x] = img[y, x] <= round(float((w * near).sum())) - c
    got = FR.ink_mask(frames_df(spark, [img]), block=block, c=c).first()["ink"]
    assert np.array_equal(np.frombuffer(bytes(got), np.uint8).reshape(9, 11), want)


def test_structure_diff_is_the_share_of_changed_ink(spark):
    a = staff_page(60, 80, [10])
    b = staff_page(60, 80, [12])
    pairs = FR.consecutive_pairs(frames_df(spark, [a, b]), ["source_id"], ["frame_index"], ["px"])
    row = FR.structure_diff(pairs).orderBy("frame_index").collect()[1]
    want = (K.ink_mask(a, opened=True) ^ K.ink_mask(b, opened=True)).mean()
    assert row.structure_diff == pytest.approx(want) and want > 0


@pytest.mark.parametrize("shift", [-7, 0, 5])
def test_known_shift_is_found(spark, shift):
    tall = RNG.integers(0, 256, (160, 64)).astype(np.uint8)
    a, b = tall[40:140], tall[40 + shift : 140 + shift]
    pairs = FR.consecutive_pairs(frames_df(spark, [a, b]), ["source_id"], ["frame_index"], ["px"])
    row = FR.phase_shift(pairs, max_shift=22).orderBy("frame_index").collect()[1]
    assert row.phase_shift == pytest.approx(shift, abs=0.3) and row.phase_conf > 0.5
    assert K.best_lag(a.mean(axis=1), b.mean(axis=1), 22)[0] == shift


def test_dhash_of_a_ramp_and_of_small_frames(spark):
    ramp = np.tile(np.arange(0, 180, 10, dtype=np.uint8), (16, 1))
    out = FR.frame_hash(frames_df(spark, [ramp, ramp[:, ::-1].copy(), ramp[:4], None])).orderBy("frame_index").collect()
    assert [r.dhash for r in out] == [-1, 0, None, None]


def test_playhead_bar_is_recognised():
    mask = np.zeros((40, 100), bool)
    mask[2:38, 50:54] = True
    assert K.moving_bar(mask) and not K.moving_bar(np.ones((40, 100), bool)) and not K.moving_bar(np.zeros((4, 4), bool))


def test_warp_of_a_tilted_region_and_passthrough(spark):
    img = RNG.integers(0, 256, (50, 60)).astype(np.uint8)
    roi = F.when(F.col("frame_index") == 0, G.order_roi_points(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((10.0, 5.0), (39.0, 5.0), (39.0, 34.0), (10.0, 34.0))])))
    out = FR.rectify_frames(frames_df(spark, [img, img, None]).withColumn("roi", roi)).orderBy("frame_index").collect()
    assert [(r.sheet_width, r.sheet_height) for r in out] == [(29, 29), (60, 50)]
    warped = np.frombuffer(bytes(out[0].sheet), np.uint8).reshape(29, 29)
    assert warped[0, 0] == img[5, 10] and warped[28, 28] == img[34, 39]


def test_duplicates_are_dropped_against_the_last_kept_frame(spark):
    base = RNG.integers(0, 2, (48, 64)).astype(np.uint8) * 255
    other = RNG.integers(0, 2, (48, 64)).astype(np.uint8) * 255
    seq = [base, base, None, other, other, base]
    df = frames_df(spark, seq)
    flags = Q.dedupe_frames(df, ["source_id"], ["frame_index"], layout="page_turn", flags=True).orderBy("frame_index").collect()
    assert [r.keep for r in flags] == [True, False, False, True, False, False]
    assert [r.drop_reason for r in flags][-1] == "recent" and flags[2].drop_reason == "unreadable"
    kept = Q.dedupe_frames(df, ["source_id"], ["frame_index"], layout="full_scroll")
    assert sorted(r.frame_index for r in kept.collect()) == [0, 3, 5]


def test_unreadable_first_frame_switches_filtering_off(spark):
    img = staff_page(48, 64, [4])
    out = Q.dedupe_frames(frames_df(spark, [None, img, img]), ["source_id"], ["frame_index"])
    assert out.count() == 3


def test_scrolling_page_is_stitched_back(spark):
    tall = RNG.integers(0, 256, (400, 80)).astype(np.uint8)
    tall = np.repeat(tall[:, ::8], 8, axis=1)
    frames = frames_df(spark, [tall[y : y + 160] for y in (0, 30, 60, 90, 120)])
    plan = Q.stitch_plan(frames, ["source_id"], ["frame_index"], threshold=0.9).orderBy("frame_index").collect()
    assert [r.y_offset for r in plan] == [0, 30, 60, 90, 120] and not any(r.new_page for r in plan[1:])
    rows = Q.compose_rows(frames, Q.stitch_plan(frames, ["source_id"], ["frame_index"], threshold=0.9), ["source_id"], ["frame_index"])
    assert rows.count() == 280


def test_disabled_stitching_gives_a_page_per_frame(spark):
    frames = frames_df(spark, [staff_page(40, 60, [5])] * 3)
    plan = Q.stitch_plan(frames, ["source_id"], ["frame_index"], threshold=0.9, enable=False)
    assert sorted(r.page_no for r in plan.collect()) == [1, 2, 3]


def test_merge_without_overlap_leaves_a_gap(spark):
    a, b = np.full((100, 60), 255, np.uint8), np.zeros((100, 60), np.uint8)
    a[::2] = 10
    b[::7] = 200
    plan = Q.merge_plan(frames_df(spark, [a, a, b]), ["source_id"], ["frame_index"], tone=False).orderBy("frame_index").collect()
    assert [(r.frame_index, r.y_offset) for r in plan] == [(0, 0), (2, 112)]


def test_two_strips_make_one_page_with_one_diagnostic(spark):
    from folioflow.plans.export import export

    frames = frames_df(spark, [staff_page(980, 1800, [120]), staff_page(980, 1800, [610])])
    runs = spark.createDataFrame([("a", ["pdf"], False)], "source_id string, formats array<string>, include_raw boolean")
    out = export(frames, runs, ["source_id"], ["frame_index"])
    assert out.pages.count() == 1 and out.diagnostics.count() == 1
    assert [r.role for r in out.manifest.collect()] == ["pdf"]


@pytest.mark.parametrize(
    "tops,risk,code", [(range(180, 640, 110), "info", "roi_healthy"), (range(104, 560, 104), "critical", "top_edge_busy"), ([], "warning", "content_sparse")]
)
def test_region_check(spark, tops, risk, code):
    from folioflow.plans.roi_check import check_rois

    img = np.full((800, 800), 255, np.uint8)
    for top in tops:
        for i in range(5):
            img[top + i * 9 : top + i * 9 + 2, 120:680] = 0
    frames = frames_df(spark, [img] * 4).withColumn("ts_sec", F.col("ts_sec") * 0.8)
    roi = [[100.0, 100.0], [700.0, 100.0], [700.0, 700.0], [100.0, 700.0]]
    requests = spark.createDataFrame([("a", 1, 0.0, roi)], "source_id string, request int, start_sec double, roi array<array<double>>")
    row = check_rois(requests, frames).first()
    assert row.risk_level == risk and code in [d.code for d in row.diagnostics]
    assert row.sampled_frames == 3 and row.checked_seconds == [0.0, 0.8, 1.6]


def test_capture_plan_end_to_end(spark):
    from folioflow.plans.capture import CaptureOptions, capture

    pages = [staff_page(300, 400, tops) for tops in ([20, 150], [40, 200], [80, 230])]
    frames = frames_df(spark, [pages[i // 3] for i in range(9)])
    rois = spark.createDataFrame([("a", [[0.0, 0.0], [399.0, 0.0], [399.0, 299.0], [0.0, 299.0]])], "source_id string, roi array<array<double>>")
    out = capture(frames, rois, CaptureOptions(layout="page_turn", formats=("png", "pdf"), include_raw=True))
    assert out.plan.count() == 3
    roles = {r.role: r["count"] for r in out.manifest.groupBy("role").count().collect()}
    assert roles["raw_frames"] == 9 and roles["pdf"] == 1 and roles["full_sheet"] == 1 and roles["images"] == out.pages.count()


def test_review_exports_only_accepted_jobs(spark):
    from folioflow.plans.review import review

    img = staff_page(120, 300, [20])
    jobs = spark.createDataFrame([("j1", "done", False, ["png"]), ("j2", "running", False, ["png"]), ("j3", "done", True, ["png"])], "job_id string, status string, reviewed boolean, formats array<string>")
    caps = spark.createDataFrame([(j, f"{j}/{i}.png") for j in ("j1", "j2", "j3") for i in range(2)], "job_id string, path string")
    asked = spark.createDataFrame([(j, f"{j}/0.png", 0) for j in ("j1", "j2", "j3")], "job_id string, path string, pos int")
    px = caps.withColumns({"width": F.lit(300), "height": F.lit(120), "px": F.lit(bytearray(img.tobytes()))})
    verdicts, out = review(jobs, asked, caps, px)
    reasons = {r.job_id: r.reason for r in verdicts.collect()}
    assert reasons == {"j1": None, "j2": "job is still running", "j3": "review export is already applied"}
    assert {r.job_id for r in out.manifest.collect()} == {"j1"} and out.pages.count() == 1


# --- jobs, sources, functions ----------------------------------------------------------------


def test_job_documents(spark, tmp_path):
    docs = {
        "one": '{"id": "one", "status": "done", "progress": 1.0, "log": ["x"], "options": {"a": {"b": 1}}}',
        "two": '{"id": "two", "status": "running",\n "progress": 0.4}',
        "three": '{"id": "three", "sta',
    }
    for name, text in docs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(text)
    jobs = R.read_jobs(spark, f"{tmp_path}/*/job.json").withColumn("updated_at", F.lit(0.0))
    rows = {r.id: r for r in W.recover_jobs(jobs).collect()}
    assert rows["one"].status == "done" and rows["one"].error_code is None
    assert rows["two"].error_code == "RECOVERED_AFTER_RESTART" and rows["two"].recovered_log
    assert rows["three"].error_code == "RECOVERED_CORRUPT_METADATA" and rows["three"].source_type == "file"


def test_file_inventory_reads_no_content(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.PNG").write_bytes(b"12345")
    (tmp_path / "c.json").write_bytes(b"1")
    df = R.list_assets(spark, str(tmp_path))
    got = {(r.child, r.extension, r.length) for r in df.collect()}
    assert got == {("a", "png", 5), ("c.json", "json", 1)}
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan.split("ReadSchema")[-1]


def test_written_jobs_replace_their_bucket(spark, tmp_path):
    a = spark.createDataFrame([(i, "running") for i in range(50)], "job_id int, status string")
    WR.write_jobs(a, f"{tmp_path}/t")
    WR.write_jobs(a.withColumn("status", F.lit("done")), f"{tmp_path}/t")
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.count() == 50 and {r.status for r in back.select("status").distinct().collect()} == {"done"}


def test_renditions_prefer_height_and_reject_small(spark):
    files = spark.createDataFrame(
        [("a", "lo.mp4", 640, 360, 9), ("a", "hi.mp4", 1920, 1080, 1), ("b", "lo.mp4", 640, 360, 1), ("c", "x.txt", 1920, 1080, 1)],
        "key string, path string, width int, height int, mtime int",
    )
    out = A.rendition_status(files.select("key"), files, ["key"], suffix=T.path_suffix(F.col("path"))).collect()
    assert {(r.key, r.path, r.status) for r in out} == {("a", "hi.mp4", "hit"), ("b", "lo.mp4", "rejected"), ("c", None, "miss")}


def test_seek_candidates(spark):
    assert value(spark, J.seek_candidates(F.lit(0.0))) == [0.0, 0.8, 1.8, 3.5, 6.0]
    assert value(spark, J.seek_candidates(F.lit(2.0))) == [2.0, 2.8, 3.8, 5.5, 8.0, 1.0, 0.0]


def test_capture_key_precedence(spark):
    df = spark.createDataFrame([([], ["u"], ["s"], ["i"]), (["r"], ["u"], [], []), ([], [], [], [])], "review_candidates array<string>, upscaled_frames array<string>, stitched_frames array<string>, images array<string>")
    keys = ("review_candidates", "upscaled_frames", "stitched_frames", "images")
    assert [r.v for r in df.select(PR.preferred_captures(df, keys).alias("v")).collect()] == [["u"], ["r"], []]


@pytest.mark.parametrize("url,fine", [("https://www.youtube.com/watch?v=1", True), ("https://youtu.be/1", True), ("ftp://youtu.be/1", False), ("https://example.com", False), ("", False)])
def test_hosts(spark, url, fine):
    df = spark.createDataFrame([("youtube", None, url)], "source_type string, file_path string, url string")
    assert (PR.validate_sources(df).first().reason is None) == fine


def test_text_functions(spark):
    assert value(spark, N.mmss(F.lit(75.25))) == "01:15.3" and value(spark, N.mmss(F.lit(-1.0))) == "-"
    assert value(spark, N.human_bytes(F.lit(1536))) == "1.5 KB" and value(spark, N.human_bytes(F.lit(12))) == "12 B"
    assert value(spark, T.path_basename(F.lit("C:\\a\\b.png"))) == "b.png"
    assert value(spark, N.try_number(F.lit(" 1e2 "))) == 100.0 and value(spark, N.try_number(F.lit("1d"))) is None
    assert value(spark, T.normalize_locale(F.lit(""), F.lit("ko-KR"))) == "ko"
    assert value(spark, T.render_template(F.lit("{{a}}-{{b}}"), F.create_map(F.lit("a"), F.lit("1")))) == "1-"


# --- ordered work: independence of layout, empty and odd inputs -----------------------------------


def last_kept():
    # Defined inside: the workers cannot import this test module.
    class LastKept(Fold):
        columns = ("v",)
        outputs = (("keep", "boolean"),)

        def step(self, state, v):
            keep = state is None or abs(v - state) > 20
            return (v if keep else state), (keep,)

    return LastKept()


def greedy(values):
    kept, flags = None, []
    for v in values:
        keep = kept is None or abs(v - kept) > 20
        kept = v if keep else kept
        flags.append(keep)
    return flags


@pytest.mark.parametrize("runs", ["1000000", "37", "7"])
@pytest.mark.parametrize("kind", ["noise", "steps", "static"])
def test_fold_is_independent_of_the_layout(spark, runs, kind):
    n = 600
    data = {"noise": RNG.random(n) * 100, "steps": np.repeat(RNG.random(n // 20) * 100, 20), "static": np.full(n, 5.0)}[kind]
    rows = [("hot", i, float(v)) for i, v in enumerate(data)] + [("cold", i, float(v)) for i, v in enumerate(data[:9])]
    order = RNG.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "k string, i int, v double").repartition(5)
    spark.conf.set("spark.folioflow.runRows", runs)
    try:
        out = ordered_fold(df, ["k"], ["i"], last_kept()).orderBy("k", "i").collect()
        both = Ordered(df, ["k"], ["i"]).neighbour("p", F.col("v")).neighbour("n", F.col("v"), 1).running("s", F.lit(1)).position("at").result()
        hot = both.filter("k = 'hot'").orderBy("i").collect()
    finally:
        spark.conf.unset("spark.folioflow.runRows")
    assert [r.keep for r in out if r.k == "hot"] == greedy(data) and [r.keep for r in out if r.k == "cold"] == greedy(data[:9])
    assert [r.p for r in hot] == [None, *data[:-1]] and [r.n for r in hot] == [*data[1:], None]
    assert [r.s for r in hot] == list(range(1, n + 1)) and [r.at for r in hot] == list(range(n))


def test_empty_and_single_inputs(spark):
    none = frames_df(spark, [])
    key, order = ["source_id"], ["frame_index"]
    assert Q.dedupe_frames(none, key, order).count() == 0
    assert Q.collapse_page_turns(none, key, order).count() == 0
    assert Q.merge_plan(none, key, order).count() == 0
    assert P.density_quantiles(profile_df(spark, []), ["sheet_id"], {"a": 0.5}).count() == 0
    assert slices(spark, [], 700) == []
    one = frames_df(spark, [staff_page(40, 60, [5])])
    assert Q.dedupe_frames(one, key, order).count() == 1
    assert Q.merge_plan(one, key, order).first().y_offset == 0
    assert slices(spark, [0.01], 700) == [(0, 1)]


# --- streams --------------------------------------------------------------------------------------


def test_stream_state_survives_batches(spark, tmp_path):
    from folioflow.streaming import streams as S

    S.use_rocksdb(spark)
    base = [RNG.integers(0, 2, (24, 32)).astype(np.uint8) * 255 for _ in range(4)]
    seq = [base[i] for i in (0, 0, 1, 1, 0, 2, 2, 3, 3, 0, 1, 2)]
    df = frames_df(spark, seq)
    schema = df.schema
    out, ckpt = f"{tmp_path}/out", f"{tmp_path}/ckpt"
    for part in range(3):
        df.filter((F.col("frame_index") >= part * 4) & (F.col("frame_index") < part * 4 + 4)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        kept = S.stream_dedupe(stream, ["source_id"], ["frame_index"], layout="page_turn")
        S.run_available(kept, out, mode="append", checkpoint=ckpt)
    got = sorted(r.frame_index for r in spark.read.parquet(out).collect())
    want = sorted(r.frame_index for r in Q.dedupe_frames(df, ["source_id"], ["frame_index"], layout="page_turn").collect())
    assert got == want == [0, 2, 5, 7]


# --- export surface ------------------------------------------------------------------


def test_faint_images_have_ink_in_the_export_profile(spark):
    from folioflow.plans.export import export

    img = np.full((300, 200), 250, np.uint8)
    img[100:110, 20:180] = 244
    frames = frames_df(spark, [img])
    runs = spark.createDataFrame([("a", ["png"], False)], "source_id string, formats array<string>, include_raw boolean")
    out = export(frames, runs, ["source_id"], ["frame_index"])
    assert out.profile.agg(F.sum("density")).first()[0] > 1


def test_narrow_frames_count_as_a_share_of_the_widest(spark):
    from folioflow.plans.export import sheet_profile

    rows = [("a", 0, 600, [0.5] * 4), ("a", 1, 300, [0.5] * 4)]
    toned = spark.createDataFrame(rows, "source_id string, frame_index int, width int, row_density array<double>")
    plan = spark.createDataFrame([("a", 0, 0), ("a", 1, 4)], "source_id string, frame_index int, y_offset int")
    got = [r.density for r in sheet_profile(toned, plan, ["source_id"], ["frame_index"]).orderBy("y").collect()]
    assert got == [0.5] * 4 + [0.25] * 4


def test_diagnostics_see_the_printed_canvas(spark):
    """The top band of 48 canvas rows holds the margin and 48 - margin page rows, as a share of the canvas width."""
    from folioflow.operators import pagination as PG

    pages = spark.createDataFrame([("a", 0, 0, 1000, 1000), ("a", 1, 1000, 1900, 900)], "source_id string, page_index int, y_start int, y_end int, height int")
    framed = PG.frame_pages(pages.withColumn("width", F.lit(1000)), ["source_id"])
    ys = spark.range(1900).select(F.lit("a").alias("source_id"), F.col("id").cast("int").alias("y"), F.when(F.col("id") < 1000, 0.3).otherwise(0.0).alias("density"))
    got = {r.page_index: r for r in PG.canvas_diagnostics(ys, framed, ["source_id"]).collect()}
    place = {r.page_index + 1: r for r in framed.collect()}
    assert set(got) == {1, 2}
    one = place[1]
    top = sum(one.y0 <= y < one.y0 + one.draw_h for y in range(48)) * 0.3 * one.draw_w / one.canvas_w / 48
    assert abs(got[1].top_edge_density - round(top, 5)) < 2e-5 and got[1].suspicious == (top > 0.02 or got[1].bottom_edge_density > 0.02)
    assert got[2].top_edge_density == 0.0 and not got[2].suspicious


def test_raw_copies_are_the_sampled_frames(spark):
    from folioflow.plans.capture import CaptureOptions, capture

    frames = frames_df(spark, [staff_page(300, 400, [20 + 30 * i]) for i in range(5)])
    rois = spark.createDataFrame([], "source_id string, roi array<array<double>>")
    out = capture(frames, rois, CaptureOptions(fps=0.5, include_raw=True, formats=("png",)))
    names = sorted(r.name for r in out.manifest.filter("role = 'raw_frames'").collect())
    assert names == ["raw_00000.png", "raw_00001.png", "raw_00002.png"]


def test_review_lists_previews_and_no_complete_sheet(spark):
    from folioflow.sources.writers import export_manifest

    pages = spark.createDataFrame([(j, i, 0, 9) for j in ("a", "b") for i in range(2)], "job_id string, page_index int, y_start int, y_end int")
    runs = spark.createDataFrame([("a", ["png", "pdf"], 3, False), ("b", ["pdf"], 3, False)], "job_id string, formats array<string>, used_frames int, include_raw boolean")
    rows = {(r.job_id, r.role, r.name) for r in export_manifest(pages, runs, ["job_id"], review=True).collect()}
    assert {(j, r) for j, r, _ in rows} == {("a", "images"), ("a", "pdf"), ("a", "preview_images"), ("b", "pdf"), ("b", "preview_images")}
    assert {n for j, r, n in rows if r == "preview_images"} == {"page_0001.png", "page_0002.png", "preview_0001.png", "preview_0002.png"}


def test_seek_finds_a_frame_at_the_far_edge(spark):
    frames = spark.createDataFrame([("a", 7, 0.4)], "source_id string, frame_id int, ts_sec double")
    asked = spark.createDataFrame([("a", 1, 0.3)], "source_id string, request int, sec double")
    assert J.seek_first_available(asked, frames, ["source_id"], "request", tol=0.1).first().frame_id == 7


def test_long_hex_numbers(spark):
    values = ["0x1", "0xFFFFFFFFFFFFFFFFF", "0x10000000000000800", "0x10000000000000801", "0x" + "0" * 40 + "f", "0x" + "f" * 300, "0x0", "0xg"]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "t string").select(N.try_number(F.col("t")).alias("v")).collect()]
    want = []
    for v in values[:-1]:
        try:
            want.append(float(int(v, 16)))
        except OverflowError:
            want.append(None)
    assert got == [*want, None]


def test_state_crosses_more_than_eight_runs(spark):
    """A state that only the first row sets travels through every run; no task ever takes the whole key."""

    class First(Fold):
        columns = ("v",)
        outputs = (("first", "bigint"),)

        def step(self, state, v):
            state = v if state is None else state
            return state, (state,)

    spark.conf.set("spark.folioflow.runRows", "15")
    try:
        rows = spark.createDataFrame([("a", i, 1000 + i) for i in range(200)], "k string, i int, v long")
        out = ordered_fold(rows, ["k"], ["i"], First())
        sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert {r.first for r in out.collect()} == {1000} and out.count() == 200
        assert max(r["count"] for r in sizes) < 60
    finally:
        spark.conf.unset("spark.folioflow.runRows")


def test_border_states_move_in_waves(spark, monkeypatch):
    from folioflow import runs as RUNS

    monkeypatch.setattr(RUNS, "BORDER_BYTES", 1)
    spark.conf.set("spark.folioflow.runRows", "30")
    try:
        values = [int(v) for v in RNG.integers(0, 200, 150)]
        rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i int, v long")
        got = [r.keep for r in ordered_fold(rows, ["k"], ["i"], last_kept()).orderBy("i").collect()]
        assert got == greedy(values)
    finally:
        spark.conf.unset("spark.folioflow.runRows")


def test_stitching_scrolled_frames_joins_them_by_their_overlap(spark):
    from folioflow.plans.capture import CaptureOptions, capture

    sheet = np.full((900, 400), 255, np.uint8)
    for top in range(0, 900, 7):
        at = int(RNG.integers(20, 300))
        sheet[top : top + 3, at : at + 60] = 0
    frames = frames_df(spark, [sheet[y : y + 300] for y in (0, 120, 240, 360)])
    rois = spark.createDataFrame([], "source_id string, roi array<array<double>>")
    options = {"layout": "full_scroll", "formats": ("png",), "fps": 10.0}
    stitched = capture(frames, rois, CaptureOptions(stitch=True, **options))
    plain = capture(frames, rois, CaptureOptions(stitch=False, **options))
    got = stitched.plan.orderBy("frame_index").collect()
    assert [r.y_offset for r in got] == [sum(300 - x.overlap + (0 if not x.new_page or x.overlap else 12) for x in got[1 : i + 1]) for i in range(len(got))]
    assert sum(r.new_page for r in got) < len(got)
    assert "new_page" not in plain.plan.columns and stitched.pages.count() >= 1


def test_stitched_pages_follow_each_other_with_a_gap(spark):
    stitch = spark.createDataFrame([("a", 0, True, 0), ("a", 1, False, 40), ("a", 2, True, 0)], "source_id string, frame_index int, new_page boolean, overlap int")
    a, b = np.full((100, 60), 255, np.uint8), np.zeros((100, 60), np.uint8)
    a[::2] = 10
    b[::7] = 200
    plan = Q.stitched_sheet_plan(frames_df(spark, [a, a, b]), stitch, ["source_id"], ["frame_index"], tone=False).orderBy("frame_index").collect()
    assert [(r.y_offset, r.overlap) for r in plan] == [(0, 0), (60, 40), (172, 0)]


def plain_whole_sheet(images, threshold):
    """Every frame against the page stitched so far, held whole."""
    from folioflow import kernels as K

    sheet, out = None, []
    for image in images:
        score, rows = (None, 0) if sheet is None else K.stitch_overlap(sheet, image)[:2]
        if score is None or score < threshold:
            out.append((True, 0, 0))
            sheet = image
            continue
        rows = max(0, min(rows, len(sheet) - 1, len(image) - 1))
        out.append((False, rows, len(sheet) - rows))
        sheet = K.stitch_pair(*(K.pad_white(a, max(sheet.shape[1], image.shape[1])) for a in (sheet, image)), rows)
    return out


def scrolled_frames(count, height=48, width=64, seed=3):
    rng = np.random.default_rng(seed)
    tall = np.repeat(np.repeat(rng.integers(0, 256, (count * 3, width // 8)), 8, axis=0), 8, axis=1).astype(np.uint8)
    return [tall[y : y + height, : width - 8 * (i % 3 == 2)] for i, y in enumerate(np.cumsum(rng.integers(0, 20, count)).tolist())]


def test_whole_sheet_stitch_equals_the_plain_form(spark):
    images = [*scrolled_frames(200), *scrolled_frames(300, seed=8)]
    frames = frames_df(spark, images)
    got = Q.stitch_plan(frames, ["source_id"], ["frame_index"], threshold=0.8, whole_sheet=True).orderBy("frame_index").collect()
    want = plain_whole_sheet(images, 0.8)
    assert [(r.new_page, r.overlap, r.y_offset) for r in got] == want
    pages = [w[0] for w in want]
    assert 1 < sum(pages) < len(pages) / 2  # pages of several frames, and more than one of them


def test_whole_sheet_stitch_over_several_runs(spark, small_runs):
    images = [*scrolled_frames(25), *scrolled_frames(25, seed=8)]
    got = Q.stitch_plan(frames_df(spark, images), ["source_id"], ["frame_index"], threshold=0.8, whole_sheet=True).orderBy("frame_index").collect()
    assert [(r.new_page, r.overlap, r.y_offset) for r in got] == plain_whole_sheet(images, 0.8)


def test_held_rows_of_a_sheet_are_bounded():
    from folioflow import kernels as K

    images = [i[:, :56] for i in scrolled_frames(300)]
    sheet, whole = K.Sheet(images[0], 400), images[0]
    for image in images[1:]:
        sheet, whole = sheet.stitched(image, 20), K.stitch_pair(whole, image, 20)
        assert sheet.shape == whole.shape and len(sheet.head) + len(sheet.tail) <= 400
    assert np.array_equal(sheet.tail, whole[-len(sheet.tail) :])
    mean = np.abs(K.resize(sheet, 56, 48).astype(int) - K.resize(whole, 56, 48).astype(int)).mean()
    assert mean < 40 and sheet.step > 1
    exact = K.Sheet(images[0], 100_000)
    for image in images[1:]:
        exact = exact.stitched(image, 20)
    assert np.array_equal(K.resize(exact, 56, 48), K.resize(whole, 56, 48))


def test_whole_sheet_skips_unreadable_frames(spark):
    images = scrolled_frames(6)
    got = Q.stitch_plan(frames_df(spark, [images[0], None, *images[1:]]), ["source_id"], ["frame_index"], threshold=0.8, whole_sheet=True)
    assert sorted(r.frame_index for r in got.collect()) == [0, 2, 3, 4, 5, 6]
