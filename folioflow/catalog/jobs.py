"""Job, log, review, cache and rendition tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import fixtures as X
from folioflow.catalog.base import ORACLES, query
from folioflow.functions.text import path_suffix
from folioflow.operators import aggregates as A
from folioflow.operators import joins as J
from folioflow.operators import projections as P
from folioflow.operators import sets as U
from folioflow.operators import windows as W
from folioflow.session import scratch_path
from folioflow.sources import readers as R
from folioflow.sources import writers as WR

CP, JP = X.CAPTURES_SQL, X.JOB_PATCHES_SQL
JOBS = """jobs AS (SELECT job_id, arg_max(status, ROW(ts, seq)) AS status, max(ts) AS updated_at,
  arg_max(greatest(0.0::DOUBLE, least(1.0::DOUBLE, progress)), ROW(ts, seq)) FILTER (progress IS NOT NULL) AS progress,
  arg_max(current_step, ROW(ts, seq)) FILTER (current_step IS NOT NULL) AS current_step, arg_max(message, ROW(ts, seq)) FILTER (message IS NOT NULL) AS message,
  arg_max(error_code, ROW(ts, seq)) FILTER (error_code IS NOT NULL) AS error_code FROM jp GROUP BY job_id)"""
HUMAN = """CASE WHEN {b} < 1024 THEN CAST({b} AS VARCHAR) || ' B' WHEN {b} < 1048576 THEN printf('%.1f KB', {b} / 1024.0::DOUBLE)
 WHEN {b} < 1073741824 THEN printf('%.1f MB', {b} / 1048576.0::DOUBLE) ELSE printf('%.1f GB', {b} / 1073741824.0::DOUBLE) END"""


def _jobs(spark, d):
    return W.current_jobs(X.job_patches(spark, d))


def _micros(name):
    return F.unix_micros(name).alias(name)


# --- current state ---------------------------------------------------------------------


@query("w7_current_jobs", f"""WITH {JP}, {JOBS} SELECT * REPLACE (epoch_us(updated_at) AS updated_at) FROM jobs""")
def w7(spark, d):
    return _jobs(spark, d).withColumn("updated_at", F.unix_micros("updated_at"))


STALE = 1706400000  # 2024-01-28


@query(
    "t5_recover_jobs",
    f"""WITH {JP}, {JOBS}, a AS (SELECT *, status IN ('queued','running') AND updated_at < TIMESTAMP '2024-01-28 00:00:00' AS lost FROM jobs)
SELECT job_id, CASE WHEN lost THEN 'error' ELSE status END AS status, CASE WHEN lost THEN 'failed' ELSE current_step END AS current_step, CASE WHEN lost THEN 'job recovered after restart; rerun the capture' ELSE message END AS message,
  CASE WHEN lost THEN 'RECOVERED_AFTER_RESTART' ELSE error_code END AS error_code, CASE WHEN lost THEN 'job recovered after restart' END AS recovered_log FROM a""",
)
def t5(spark, d):
    out = W.recover_jobs(_jobs(spark, d), stale_before=F.timestamp_seconds(F.lit(STALE)))
    return out.select("job_id", "status", "current_step", "message", "error_code", "recovered_log")


@query(
    "w6_log_tail",
    f"""WITH {X.JOB_LOG_SQL}, a AS (SELECT job_id, seq, line, CAST(row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS INTEGER) AS tail_pos FROM jl) SELECT * FROM a WHERE tail_pos <= 20""",
)
def w6(spark, d):
    return W.log_tail(X.job_log(spark, d), ["job_id"]).select("job_id", "seq", "line", "tail_pos")


# --- captures and reviews -----------------------------------------------------------------


@query(
    "w5_review_queue",
    f"""WITH {CP} SELECT job_id, idx, suspicious, CAST(row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN suspicious THEN 0 ELSE 1 END, idx) AS INTEGER) AS rank FROM cp""",
)
def w5(spark, d):
    return W.review_queue(X.captures(spark, d), ["job_id"]).select("job_id", "idx", "suspicious", F.col("rank").cast("int").alias("rank"))


@query(
    "w5_review_queue_top",
    f"""WITH {CP}, a AS (SELECT job_id, idx, CAST(row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN suspicious THEN 0 ELSE 1 END, idx) AS INTEGER) AS rank FROM cp) SELECT * FROM a WHERE rank <= 12""",
)
def w5b(spark, d):
    return W.review_queue(X.captures(spark, d), ["job_id"], n=12).select("job_id", "idx", "rank")


# The keep-list of a job names its captures twice, in reverse, with a few foreign paths.
REQ = """rq AS (SELECT job_id, path, 2 * idx + 1 AS pos FROM cp WHERE kept UNION ALL SELECT job_id, ' ' || path || ' ', 2 * idx FROM cp WHERE kept AND idx % 3 = 0
 UNION ALL SELECT job_id, replace(path, '.png', '.gif'), 2 * idx FROM cp WHERE suspicious UNION ALL SELECT job_id, '  ', -1 FROM cp WHERE idx = 0),
cl AS (SELECT job_id, trim(path) AS path, pos FROM rq WHERE trim(path) <> ''), fs AS (SELECT job_id, path, min(pos) AS pos FROM cl GROUP BY ALL)"""


def _requests(c):
    pos = F.col("idx") * 2
    return (
        c.filter("kept").select("job_id", "path", (pos + 1).alias("pos"))
        .unionByName(c.filter("kept and idx % 3 = 0").select("job_id", F.concat(F.lit(" "), "path", F.lit(" ")).alias("path"), pos.alias("pos")))
        .unionByName(c.filter("suspicious").select("job_id", F.replace(F.col("path"), F.lit(".png"), F.lit(".gif")).alias("path"), pos.alias("pos")))
        .unionByName(c.filter("idx = 0").select("job_id", F.lit("  ").alias("path"), F.lit(-1).alias("pos")))
    )


@query("j5_select_captures", f"""WITH {CP}, {REQ} SELECT job_id, path, pos, path IN (SELECT path FROM cp) AS kept FROM fs""")
def j5(spark, d):
    c = X.captures(spark, d)
    kept, rejected, _ = J.select_captures(_requests(c), c, ["job_id"])
    return kept.withColumn("kept", F.lit(True)).unionByName(rejected.drop("reason").withColumn("kept", F.lit(False)))


@query(
    "j5_review_guard",
    f"""WITH {CP}, {REQ}, n AS (SELECT job_id, count(*) AS requested_count FROM cl GROUP BY job_id), k AS (SELECT job_id, count(*) AS kept_count FROM fs WHERE path IN (SELECT path FROM cp) GROUP BY job_id),
jb AS (SELECT job_id, CASE WHEN max(doc_id) % 3 = 0 THEN 'running' ELSE 'done' END AS status, max(doc_id) % 2 = 0 AS reviewed FROM cp GROUP BY job_id)
SELECT job_id, requested_count, coalesce(kept_count, 0) AS kept_count, CASE WHEN status = 'running' THEN 'job is still running' WHEN reviewed THEN 'review export is already applied' WHEN coalesce(requested_count, 0) = 0 THEN 'keep_captures must include at least one capture' WHEN coalesce(kept_count, 0) = 0 THEN 'no valid captures selected' END AS reason
FROM jb LEFT JOIN n USING (job_id) LEFT JOIN k USING (job_id)""",
)
def j5b(spark, d):
    c = X.captures(spark, d)
    _, _, counts = J.select_captures(_requests(c), c, ["job_id"])
    last = F.max("doc_id")
    jobs = c.groupBy("job_id").agg(
        F.when(last % 3 == 0, F.lit("running")).otherwise(F.lit("done")).alias("status"), (last % 2 == 0).alias("reviewed")
    )
    return J.review_guard(jobs, counts, ["job_id"]).select("job_id", "requested_count", "kept_count", "reason")


@query(
    "j6_attach_diagnostics",
    f"""WITH {CP}, dg AS (SELECT job_id, idx, suspicious, n_chars AS score FROM cp WHERE job_id < 'n' OR idx > 0), n1 AS (SELECT job_id, count(*) AS a FROM cp GROUP BY job_id), n2 AS (SELECT job_id, count(*) AS b FROM dg GROUP BY job_id)
SELECT cp.job_id, cp.idx, dg.score FROM cp LEFT JOIN n1 USING (job_id) LEFT JOIN n2 USING (job_id) LEFT JOIN dg ON dg.job_id = cp.job_id AND dg.idx = cp.idx AND a = b""",
)
def j6(spark, d):
    c = X.captures(spark, d)
    found = c.filter("job_id < 'n' or idx > 0").select("job_id", "idx", F.col("n_chars").alias("score"))
    return J.attach_diagnostics(c.select("job_id", "idx"), found, ["job_id"])


# Captures by role: a job's first third are candidates, the rest images; every fourth is also a preview.
ROLES = """rl AS (SELECT job_id, path, idx, n_chars, CASE WHEN job_id > 'p' AND idx % 3 = 0 THEN 'review_candidates' WHEN idx % 3 = 1 THEN 'upscaled_frames' ELSE 'images' END AS role FROM cp)"""


def _roles(c):
    role = F.when((F.col("job_id") > "p") & (F.col("idx") % 3 == 0), F.lit("review_candidates")).when(F.col("idx") % 3 == 1, F.lit("upscaled_frames"))
    return c.withColumn("role", role.otherwise(F.lit("images")))


@query(
    "j7_apply_crops",
    f"""WITH {CP}, {ROLES}, jb AS (SELECT job_id, CASE WHEN max(doc_id) % 5 = 0 THEN 'running' ELSE 'done' END AS status, max(doc_id) % 2 = 0 AS reviewed FROM cp GROUP BY job_id),
bs AS (SELECT job_id, min(CASE role WHEN 'review_candidates' THEN 1 WHEN 'upscaled_frames' THEN 2 ELSE 3 END) AS best FROM rl GROUP BY job_id),
a AS (SELECT rl.*, 100 + n_chars % 200 AS w, 100 + idx % 50 AS h, CAST(n_chars % 90 AS DOUBLE) AS x1, CAST(n_chars % 90 + idx % 120 AS DOUBLE) AS x2 FROM rl),
b AS (SELECT a.*, status, reviewed, best = CASE role WHEN 'review_candidates' THEN 1 WHEN 'upscaled_frames' THEN 2 ELSE 3 END AS sel,
  CAST(round_even(least(w, x2), 0) AS INTEGER) - CAST(round_even(least(w, x1), 0) AS INTEGER) AS cw, CAST(round_even(least(h, 90.5::DOUBLE), 0) AS INTEGER) - 10 AS ch FROM a JOIN jb USING (job_id) JOIN bs USING (job_id)),
c AS (SELECT *, CASE WHEN status = 'running' THEN 'job is still running' WHEN NOT sel THEN 'capture is not selectable for this job' WHEN reviewed AND role = 'images' THEN 'capture crop is unavailable after review export' WHEN cw < 16 OR ch < 16 THEN 'roi is too small for capture crop' END AS reason FROM b)
SELECT job_id, path, CASE WHEN reason IS NULL THEN cw END AS new_width, CASE WHEN reason IS NULL THEN ch END AS new_height, reason FROM c
UNION ALL SELECT cp.job_id, replace(path, '.png', '_x.png'), NULL, NULL, CASE WHEN status = 'running' THEN 'job is still running' ELSE 'capture file not found' END FROM cp JOIN jb USING (job_id) WHERE idx = 0
UNION ALL SELECT 'nojob', path, NULL, NULL, 'job not found' FROM cp WHERE idx = 1""",
)
def j7(spark, d):
    c = _roles(X.captures(spark, d))
    caps = c.select(
        "job_id", "path", "role", (100 + F.col("n_chars") % 200).cast("int").alias("width"), (100 + F.col("idx") % 50).cast("int").alias("height")
    )
    last = F.max("doc_id")
    jobs = c.groupBy("job_id").agg(
        F.when(last % 5 == 0, F.lit("running")).otherwise(F.lit("done")).alias("status"), (last % 2 == 0).alias("reviewed")
    )
    x1 = (F.col("n_chars") % 90).cast("double")
    x2 = x1 + (F.col("idx") % 120)
    roi = F.array(*[F.array(x, F.lit(y)) for x, y in ((x1, 10.0), (x2, 10.0), (x2, 90.5), (x1, 90.5))])
    asked = c.select("job_id", "path", "idx", roi.alias("roi"))
    lost = asked.filter("idx = 0").withColumn("path", F.replace(F.col("path"), F.lit(".png"), F.lit("_x.png")))
    stray = asked.filter("idx = 1").withColumn("job_id", F.lit("nojob"))
    return J.apply_crops(asked.unionByName(lost).unionByName(stray).drop("idx"), caps, jobs, ["job_id"])


@query(
    "p10_preferred_captures",
    """WITH r AS (SELECT conv_id, turn, role, text, CASE role WHEN 'system' THEN 1 WHEN 'assistant' THEN 2 WHEN 'user' THEN 3 END AS rk FROM conversations), b AS (SELECT conv_id, min(rk) AS rk FROM r GROUP BY conv_id)
SELECT conv_id, turn, role FROM r JOIN b USING (conv_id, rk)""",
)
def p10(spark, d):
    rows = X.table(spark, d, "conversations").select("conv_id", "turn", "role")
    return P.preferred_rows(rows, ["conv_id"], "role", ("system", "assistant", "user"))


@query(
    "p10_preferred_arrays",
    f"""WITH {CP}, {ROLES} SELECT job_id, idx, CASE WHEN idx % 3 = 0 THEN path WHEN idx % 5 = 0 THEN 'u' || idx WHEN suspicious THEN 's' || idx ELSE '' END AS first_choice FROM cp""",
)
def p10b(spark, d):
    c = X.captures(spark, d)
    empty = F.array().cast("array<string>")
    text = F.col("idx").cast("string")
    c = c.withColumns(
        {
            "review_candidates": F.when(F.col("idx") % 3 == 0, F.array("path")).otherwise(empty),
            "upscaled": F.when(F.col("idx") % 5 == 0, F.array(F.concat(F.lit("u"), text), F.lit("z"))),
            "stitched": F.when(F.col("suspicious"), F.array(F.concat(F.lit("s"), text))).otherwise(empty),
        }
    )
    chosen = P.preferred_captures(c, ("review_candidates", "upscaled", "stitched"))
    return c.select("job_id", "idx", F.coalesce(F.get(chosen, 0), F.lit("")).alias("first_choice"))


@query(
    "a10_job_page_summary",
    f"""WITH {CP}, r AS (SELECT job_id || '-' || (idx // 7) AS job, CASE WHEN toxic_ THEN 'page_diagnostics' WHEN NOT kept THEN 'review_candidates' ELSE 'images' END AS role FROM (SELECT *, suspicious AS toxic_ FROM cp)),
n AS (SELECT job, count(*) FILTER (role = 'page_diagnostics') AS a, count(*) FILTER (role = 'preview_images') AS b, count(*) FILTER (role = 'review_candidates') AS c, count(*) FILTER (role = 'images') AS e FROM r GROUP BY job),
s AS (SELECT job, coalesce(nullif(a, 0), nullif(b, 0), nullif(c, 0), nullif(e, 0), 0) AS page_count FROM n)
SELECT job, page_count, CASE WHEN page_count <= 0 THEN NULL WHEN page_count <= 2 THEN 'low' WHEN page_count <= 4 THEN 'moderate' ELSE 'high' END AS page_class FROM s""",
)
def a10(spark, d):
    c = X.captures(spark, d)
    role = F.when(F.col("suspicious"), F.lit("page_diagnostics")).when(~F.col("kept"), F.lit("review_candidates")).otherwise(F.lit("images"))
    job = F.concat("job_id", F.lit("-"), F.floor(F.col("idx") / 7).cast("string"))
    return A.job_page_summary(c.select(job.alias("job"), role.alias("role")), ["job"])


@query(
    "a11_review_summary",
    f"""WITH {CP} SELECT job_id, count(*) AS total, count(*) FILTER (kept) AS kept, count(*) FILTER (suspicious) AS suspicious_total, count(*) FILTER (suspicious AND kept) AS suspicious_kept,
  count(*) - count(*) FILTER (kept) AS excluded, count(*) FILTER (kept) > 0 AND count(*) FILTER (NOT kept) > 0 AS can_apply FROM cp GROUP BY job_id""",
)
def a11(spark, d):
    c = X.captures(spark, d)
    out = c.filter(~F.col("kept")).select("job_id", "idx")
    stray = c.select("job_id", (F.col("idx") + 1000000).alias("idx"))
    return A.review_summary(c, out.unionByName(stray), ["job_id"])


@query("u2_excluded_captures", f"""WITH {CP} SELECT job_id, idx, path FROM cp WHERE NOT kept""")
def u2(spark, d):
    c = X.captures(spark, d)
    return U.excluded_captures(c, c.filter("kept"), ["job_id", "idx"]).select("job_id", "idx", "path")


@query(
    "u3_ordered_distinct",
    f"""WITH {X.SIGNAL_SQL} SELECT source_id, event_type, min(ts_us) AS ts, arg_min(event_id, ROW(ts_us, event_id)) AS event_id FROM (SELECT *, epoch_us(ts) AS ts_us FROM sg) GROUP BY ALL""",
)
def u3(spark, d):
    rows = X.signal(spark, d).select("source_id", "event_type", F.unix_micros("ts").alias("ts"), "event_id")
    return U.ordered_distinct(rows, ["source_id"], "event_type", ["ts", "event_id"])


# Every capture of a job as a page; formats by the job's number of pages.
@query(
    "s4_review_manifest",
    f"""WITH {CP}, n AS (SELECT job_id, count(*) % 3 AS k FROM cp GROUP BY job_id), p AS (SELECT job_id, idx, k FROM cp JOIN n USING (job_id)),
f AS (SELECT job_id, 'images' AS role, 'png' AS format, CAST(idx + 1 AS INTEGER) AS item_index, format('page_{{:04d}}.png', idx + 1) AS name FROM p WHERE k <> 1
 UNION ALL SELECT job_id, 'images', 'jpg', CAST(idx + 1 AS INTEGER), format('page_{{:04d}}.jpg', idx + 1) FROM p WHERE k = 2
 UNION ALL SELECT job_id, 'preview_images', 'png', CAST(idx + 1 AS INTEGER), format(CASE WHEN k = 1 THEN 'preview' ELSE 'page' END || '_{{:04d}}.png', idx + 1) FROM p
 UNION ALL SELECT job_id, 'pdf', 'pdf', 0, 'sheet_export.pdf' FROM n WHERE k <= 1) SELECT * FROM f""",
)
def s4_review(spark, d):
    pages = X.captures(spark, d).select("job_id", F.col("idx").alias("page_index"))
    kinds = F.when(F.col("k") == 0, F.array(F.lit("png"), F.lit("pdf"))).when(F.col("k") == 1, F.array(F.lit("pdf"))).otherwise(F.array(F.lit("png"), F.lit("jpg")))
    runs = pages.groupBy("job_id").agg((F.count(F.lit(1)) % 3).alias("k"), F.count(F.lit(1)).alias("used_frames"))
    runs = runs.select("job_id", kinds.alias("formats"), "used_frames", F.lit(False).alias("include_raw"))
    return WR.export_manifest(pages, runs, ["job_id"], review=True)


# --- caches, renditions, attempts -------------------------------------------------------------


@query(
    "s3_list_assets",
    """SELECT '/jobs/' || source || '/' || doc_id || '.png' AS path, source AS child, 'png' AS extension, n_chars AS length FROM documents""",
)
def s3(spark, d):
    files = X.assets(spark, d).select("path", "length")
    return R.describe_assets(files, "/jobs").select("path", "child", "extension", "length")


@query(
    "a5_cache_usage",
    f"""WITH u AS (SELECT source AS child, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS total_bytes, CAST(1 AS BIGINT) AS total_paths FROM documents GROUP BY source),
t AS (SELECT * FROM u UNION ALL SELECT NULL, CAST(sum(files) AS BIGINT), CAST(sum(total_bytes) AS BIGINT), count(*) FROM u) SELECT *, {HUMAN.format(b="total_bytes")} AS total_human FROM t""",
)
def a5(spark, d):
    return A.cache_usage(X.assets(spark, d))


OWN = """ow AS (SELECT 'src' || (l_suppkey % 200) AS child, CAST(sum(l_partkey) AS BIGINT) AS reclaimed_bytes FROM lineitem GROUP BY 1)"""


@query(
    "a6_reclaim_plan",
    f"""WITH {JP}, {JOBS}, {OWN} SELECT child, reclaimed_bytes, {HUMAN.format(b="reclaimed_bytes")} AS reclaimed_human FROM ow WHERE child NOT IN (SELECT 'src' || job_id FROM jobs WHERE status IN ('queued','running'))""",
)
def a6(spark, d):
    # Grouped by the number; the name is made of the few results.
    files = X.table(spark, d, "lineitem").select((F.col("l_suppkey") % 200).alias("child"), F.col("l_partkey").alias("length"))
    free = A.reclaim_plan(files, _jobs(spark, d), mode="owner")
    return free.withColumn("child", F.concat(F.lit("src"), F.col("child").cast("string")))


@query(
    "a6_reclaim_plan_global",
    f"""WITH {JP}, {JOBS}, {OWN}, v AS (SELECT 'as they are' AS variant, count(*) FILTER (status IN ('queued','running')) AS active FROM jobs UNION ALL SELECT 'all ended', 0)
SELECT variant, child, reclaimed_bytes, {HUMAN.format(b="reclaimed_bytes")} AS reclaimed_human FROM ow, v WHERE active = 0""",
)
def a6b(spark, d):
    files = X.table(spark, d, "lineitem").select(
        F.concat(F.lit("src"), (F.col("l_suppkey") % 200).cast("string")).alias("child"), F.col("l_partkey").alias("length")
    )
    jobs = _jobs(spark, d)
    ended = jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "done").otherwise(F.col("status")))
    some = A.reclaim_plan(files, jobs).withColumn("variant", F.lit("as they are"))
    return some.unionByName(A.reclaim_plan(files, ended).withColumn("variant", F.lit("all ended")))


@query(
    "a7_best_rendition",
    f"""WITH {X.RENDITIONS_SQL}, r AS (SELECT * FROM rn WHERE key < 'Brand#3' AND (mtime % 3 > 0 OR height < 800)), b AS (SELECT key, arg_max(ROW(path, width, height), ROW(height, width, mtime)) AS v FROM r WHERE key <> 'Brand#2' GROUP BY key),
c AS (SELECT k.key, v[1] AS path, v[2] AS width, v[3] AS height FROM (SELECT DISTINCT key FROM rn) k LEFT JOIN b USING (key))
SELECT key, path, width, height, CASE WHEN path IS NULL THEN 'miss' WHEN height > 0 THEN CASE WHEN height <= 360 THEN 'rejected' ELSE 'hit' END WHEN width > 0 AND width <= 640 THEN 'rejected' ELSE 'hit' END AS status FROM c""",
)
def a7(spark, d):
    rn = X.renditions(spark, d)
    # Files of other kinds: all of some brands, and a third of the tall ones.
    video = (F.col("key") < "Brand#3") & ((F.col("mtime") % 3 > 0) | (F.col("height") < 800)) & (F.col("key") != "Brand#2")
    odd = F.when(video, F.col("path")).otherwise(F.lit("a.txt"))
    return A.rendition_status(rn, rn, ["key"], suffix=path_suffix(odd))


@query(
    "a8_resolve_resolution",
    f"""WITH {X.RENDITIONS_SQL}, p AS (SELECT key || '-' || (mtime % 40) AS source, mtime AS rank, CASE WHEN mtime % 3 = 0 THEN 0 ELSE width END AS width, CASE WHEN mtime % 5 = 0 THEN 0 ELSE height END AS height FROM rn)
SELECT source, coalesce(arg_min(width, rank) FILTER (width > 0 AND height > 0), 0) AS width, coalesce(arg_min(height, rank) FILTER (width > 0 AND height > 0), 0) AS height, max(width) AS format_width, max(height) AS format_height FROM p GROUP BY source""",
)
def a8(spark, d):
    m = F.col("mtime")
    probes = X.renditions(spark, d).select(
        F.concat("key", F.lit("-"), (m % 40).cast("string")).alias("source"),
        m.alias("rank"),
        F.when(m % 3 == 0, 0).otherwise(F.col("width")).alias("width"),
        F.when(m % 5 == 0, 0).otherwise(F.col("height")).alias("height"),
    )
    parts = A.format_resolution(probes, ["source"]).withColumnsRenamed({"width": "format_width", "height": "format_height"})
    return A.resolve_resolution(probes, ["source"]).join(parts, "source")


@query(
    "a9_first_success",
    """WITH a AS (SELECT conv_id, turn, role = 'assistant' AND turn % 4 > 1 AS ok, CASE WHEN length(text) % 7 > 0 THEN left(text, 20) END AS err FROM conversations), w AS (SELECT conv_id, min(turn) FILTER (ok) AS won FROM a GROUP BY conv_id),
f AS (SELECT a.conv_id, turn, err, row_number() OVER (PARTITION BY a.conv_id ORDER BY turn DESC) AS n FROM a JOIN w USING (conv_id) WHERE won IS NULL AND NOT ok AND err IS NOT NULL),
e AS (SELECT conv_id, string_agg(err, ' | ' ORDER BY turn) AS errors FROM f WHERE n <= 3 GROUP BY conv_id)
SELECT conv_id, won AS rank, won IS NOT NULL AS succeeded, errors FROM w LEFT JOIN e USING (conv_id)""",
)
def a9(spark, d):
    rows = X.table(spark, d, "conversations").select(
        "conv_id",
        F.col("turn").alias("rank"),
        ((F.col("role") == "assistant") & (F.col("turn") % 4 > 1)).alias("ok"),
        F.when(F.length("text") % 7 > 0, F.left(F.col("text"), F.lit(20))).alias("error"),
    )
    return A.first_success(rows, ["conv_id"], last_n=3)


# --- seek -----------------------------------------------------------------------------------------

HOURS = "(sec - 1704067200.0::DOUBLE) / 3600.0::DOUBLE"


@query(
    "j2_seek_first_available",
    f"""WITH {X.SIGNAL_SQL}, f AS (SELECT source_id, event_id, {HOURS} AS ts, value FROM sg), r AS (SELECT source_id, event_id AS request, greatest(0.0::DOUBLE, ts - 2.0::DOUBLE) AS sec FROM f),
c AS (SELECT *, list_distinct_keep AS cs FROM (SELECT *, CASE WHEN sec >= 1.5 THEN list_concat(fw, [round_even(greatest(0.0::DOUBLE, sec - 1.0::DOUBLE), 2), round_even(greatest(0.0::DOUBLE, sec - 3.0::DOUBLE), 2)]) ELSE fw END AS list_distinct_keep
  FROM (SELECT *, [round_even(sec + 0.0::DOUBLE, 2), round_even(sec + 0.8::DOUBLE, 2), round_even(sec + 1.8::DOUBLE, 2), round_even(sec + 3.5::DOUBLE, 2), round_even(sec + 6.0::DOUBLE, 2)] AS fw FROM r))),
t AS (SELECT source_id, request, sec, unnest(range(0, len(cs))) AS rk, unnest(cs) AS cand FROM c),
h AS (SELECT t.source_id, request, t.sec, rk, cand, f.ts, f.event_id AS frame FROM t JOIN f ON f.source_id = t.source_id AND f.ts >= cand AND f.ts <= cand + 0.25::DOUBLE),
b AS (SELECT source_id, request, arg_min(ROW(rk, cand, frame), ROW(rk, ts, frame)) AS v FROM h GROUP BY ALL),
g AS (SELECT r.source_id, r.request, r.sec, v[1] AS rk, v[2] AS cand, v[3] AS frame FROM r LEFT JOIN b USING (source_id, request)),
nw AS (SELECT g.source_id, request, f.ts, f.event_id, f.value FROM g JOIN f ON f.source_id = g.source_id AND f.ts >= g.sec AND f.ts < g.sec + 12.0::DOUBLE WHERE g.frame IS NULL),
mn AS (SELECT *, avg(value) OVER (PARTITION BY source_id, request) AS m FROM nw),
tp AS (SELECT source_id, request, arg_min(event_id, ROW(round((value - m) * (value - m), 9), ts, event_id)) AS spare FROM mn GROUP BY ALL)
SELECT source_id, request, CAST(rk AS INTEGER) AS seek_rank, cand AS seek_sec, coalesce(frame, spare) AS frame_id FROM g LEFT JOIN tp USING (source_id, request)""",
)
def j2(spark, d):
    hours = (F.col("sec") - 1704067200.0) / 3600.0
    frames = X.signal(spark, d).select("source_id", hours.alias("ts_sec"), F.col("event_id").alias("frame_id"), F.array("value").alias("vec"))
    requests = frames.select(
        "source_id", F.col("frame_id").alias("request"), F.greatest(F.lit(0.0), F.col("ts_sec") - 2.0).alias("sec")
    )
    out = J.seek_first_available(requests, frames, ["source_id"], "request", tol=0.25, vector="vec")
    return out.select("source_id", "request", "seek_rank", "seek_sec", "frame_id")


# --- job documents ---------------------------------------------------------------------------------


@query(
    "s2_read_jobs",
    f"""WITH {JP}, {JOBS} SELECT CASE WHEN job_id % 7 IN (3, 5) THEN 'slot=' || (job_id % 4) ELSE CAST(job_id AS VARCHAR) END AS id, CASE WHEN job_id % 7 IN (3, 5) THEN 'error' WHEN job_id % 7 = 2 THEN 'queued' ELSE status END AS status,
  CASE WHEN job_id % 7 IN (3, 5) THEN 0.0::DOUBLE ELSE coalesce(progress, 0.0::DOUBLE) END AS progress, CASE WHEN job_id % 7 IN (3, 5) THEN 'failed' ELSE coalesce(current_step, 'queued') END AS current_step,
  CASE WHEN job_id % 7 IN (3, 5) THEN 'RECOVERED_CORRUPT_METADATA' ELSE error_code END AS error_code, CASE WHEN job_id % 7 IN (3, 5) THEN 1 ELSE 2 END AS log_lines FROM jobs""",
)
def s2(spark, d):
    """Job documents written from the event table, some cut short or of unknown status, read back."""
    jobs = _jobs(spark, d)
    n = F.col("job_id") % 7
    fields = {
        "id": F.col("job_id").cast("string"),
        "source_type": F.lit("file"),
        "status": F.when(n == 5, F.lit("lost")).when(n != 2, F.col("status")),
        "progress": F.col("progress"),
        "current_step": F.col("current_step"),
        "message": F.col("message"),
        "error_code": F.col("error_code"),
        "log": F.array(F.lit("a"), F.lit("b")),
        "created_at": F.lit(1704067200.5),
        "options": F.struct(F.struct(F.lit(1.0).alias("fps")).alias("extract")),
    }
    text = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    text = F.when(n == 3, F.substring(text, 1, 40)).otherwise(text)
    path = scratch_path(spark, "jobs")
    jobs.select(text.alias("value"), (F.col("job_id") % 4).alias("slot")).write.partitionBy("slot").text(path)
    out = R.read_jobs(spark, path, multi_line=False)
    return out.select("id", "status", "progress", "current_step", "error_code", F.size("log").alias("log_lines"))


@query("s5_write_jobs", f"""WITH {JP}, {JOBS} SELECT job_id, status, progress, CAST(1 AS BIGINT) AS copies FROM jobs""")
def s5(spark, d):
    """The job table written twice by bucket, read back: every job once."""
    path = scratch_path(spark, "job-table")
    jobs = _jobs(spark, d)
    WR.write_jobs(jobs, path)
    WR.write_jobs(jobs, path)
    back = spark.read.parquet(path)
    return back.groupBy("job_id").agg(F.max("status").alias("status"), F.max("progress").alias("progress"), F.count(F.lit(1)).alias("copies"))


@query("s5_upsert_jobs", ORACLES["w7_current_jobs"])
def s5_upsert(spark, d):
    """Patches stream into the job table by micro-batch; then an early batch is replayed and one job is written again."""
    from folioflow.catalog.streams import _FIELDS, _feed
    from folioflow.streaming import streams as ST

    ST.use_rocksdb(spark)
    path, patches = scratch_path(spark, "job-upserts"), X.job_patches(spark, d)
    stream = ST.stream_current_jobs(_feed(spark, patches, "patches", ["ts", "seq"]), fields=_FIELDS)
    first = scratch_path(spark, "first-batch")

    def sink(batch, number):
        if number == 0:
            batch.write.mode("overwrite").parquet(first)
        WR.upsert_batches(path, order=["last_seq"])(batch, number)

    ST.run_sink(stream, sink, mode="update", checkpoint=scratch_path(spark, "job-upserts-checkpoint"))
    WR.upsert_batches(path, order=["last_seq"])(spark.read.parquet(first), 0)
    WR.write_jobs(spark.read.parquet(path).drop("bucket").orderBy("job_id").limit(1), path)
    out = spark.read.parquet(path).drop("bucket", "batch_id", "last_seq")
    return out.withColumn("updated_at", F.unix_micros("updated_at"))
