"""Scalar functions and row checks: F1..F19, P1..P9, P11."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import constants as C
from folioflow import messages as M
from folioflow import fixtures as X
from folioflow.catalog.base import joined, query, r6, r6s
from folioflow.functions import geometry as G
from folioflow.functions import hashing as H
from folioflow.functions import numbers as N
from folioflow.functions import text as T
from folioflow.operators import projections as P

SG = X.SIGNAL_SQL


@query(
    "f1_human_bytes",
    """SELECT doc_id, n_chars * n_chars * n_chars AS size,
  CASE WHEN s < 1024 THEN CAST(s AS VARCHAR) || ' B'
       WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0::DOUBLE)
       WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576.0::DOUBLE)
       WHEN s < 1099511627776 THEN printf('%.1f GB', s / 1073741824.0::DOUBLE)
       ELSE printf('%.1f TB', s / 1099511627776.0::DOUBLE) END AS human
FROM (SELECT doc_id, n_chars, n_chars * n_chars * n_chars AS s FROM documents)""",
)
def f1(spark, d):
    size = F.col("n_chars") * F.col("n_chars") * F.col("n_chars")
    return X.table(spark, d, "documents").select("doc_id", size.alias("size"), N.human_bytes(size).alias("human"))


@query(
    "f2_mmss",
    f"""WITH {SG}, a AS (SELECT event_id, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 13 = 0 THEN -value ELSE value * 37.25::DOUBLE END AS s FROM sg),
b AS (SELECT event_id, s, floor(s / 60.0::DOUBLE) AS m FROM a),
c AS (SELECT *, CAST(floor((s - m * 60.0::DOUBLE) * 10.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS t FROM b)
SELECT event_id, CASE WHEN s IS NULL OR s < 0 THEN '-' ELSE
  (CASE WHEN m < 10 THEN '0' ELSE '' END) || CAST(CAST(m AS BIGINT) AS VARCHAR) || ':' ||
  (CASE WHEN t < 100 THEN '0' ELSE '' END) || CAST(t // 10 AS VARCHAR) || '.' || CAST(t % 10 AS VARCHAR) END AS label FROM c""",
)
def f2(spark, d):
    k, v = F.col("k"), F.col("value")
    s = F.when(F.pmod(k, F.lit(17)) != 0, F.when(F.pmod(k, F.lit(13)) == 0, -v).otherwise(v * 37.25))
    return X.signal(spark, d).select("event_id", N.mmss(s).alias("label"))


@query(
    "f3_clamp_round_tenth",
    f"""WITH {SG} SELECT event_id, greatest(20.0::DOUBLE, least(120.0::DOUBLE, value)) AS clamped,
  floor(value * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS tenth FROM sg""",
)
def f3(spark, d):
    v = F.col("value")
    return X.signal(spark, d).select("event_id", N.clamp(v, 20.0, 120.0).alias("clamped"), N.round_tenth(v).alias("tenth"))


@query(
    "f4_truncate_middle",
    """SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE substring(text, 1, 30) || '…' || right(text, 29) END AS middle,
  CASE WHEN trim(text) = '' THEN 'Could not determine the cause of the error.'
       WHEN length(trim(text)) > 180 THEN substring(trim(text), 1, 177) || '...' ELSE trim(text) END AS compact FROM documents""",
)
def f4(spark, d):
    return X.table(spark, d, "documents").select(
        "doc_id", T.truncate_middle(F.col("text")).alias("middle"), T.compact_error(F.col("text")).alias("compact")
    )


_URL_PARTS = "list_filter(string_split(replace(trim(u), chr(92), '/'), '/'), lambda p: p <> '')"


@query(
    "f5_path_basename",
    f"""SELECT page_id, CASE WHEN len({_URL_PARTS}) > 0 THEN {_URL_PARTS}[-1] ELSE trim(u) END AS base
FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(url, '/', chr(92)) WHEN page_id % 5 = 1 THEN '  ' || url || '/ ' ELSE url END AS u FROM pages)""",
)
def f5(spark, d):
    n = F.pmod("page_id", F.lit(5))
    u = F.when(n == 0, F.translate("url", "/", "\\")).when(n == 1, F.concat(F.lit("  "), "url", F.lit("/ "))).otherwise(F.col("url"))
    return X.table(spark, d, "pages").select("page_id", T.path_basename(u).alias("base"))


@query(
    "f6_normalize_formats",
    f"""WITH {SG}, a AS (SELECT event_id, CASE k % 5 WHEN 0 THEN [' JPEG', 'png ', 'jpg'] WHEN 1 THEN ['bmp', ''] WHEN 2 THEN ['Pdf', 'pdf', event_type]
  WHEN 3 THEN ['tiff', 'PNG'] ELSE []::VARCHAR[] END AS raw FROM sg),
b AS (SELECT event_id, list_filter(list_transform(list_transform(raw, lambda t: lower(trim(t))), lambda t: CASE WHEN t = 'jpeg' THEN 'jpg' ELSE t END),
  lambda t: t IN ('png', 'jpg', 'pdf')) AS f FROM a)
SELECT event_id, CASE WHEN len(f) = 0 THEN 'png,pdf' ELSE
  array_to_string(list_filter(f, lambda t, i: list_position(f, t) = i), ',') END AS formats FROM b""",
)
def f6(spark, d):
    k = F.pmod("k", F.lit(5))
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    raw = (
        F.when(k == 0, arr(" JPEG", "png ", "jpg"))
        .when(k == 1, arr("bmp", ""))
        .when(k == 2, F.array(F.lit("Pdf"), F.lit("pdf"), F.col("event_type")))
        .when(k == 3, arr("tiff", "PNG"))
        .otherwise(F.array().cast("array<string>"))
    )
    return X.signal(spark, d).select("event_id", F.array_join(T.normalize_formats(raw), ",").alias("formats"))


# Regions from line items: four points around (quantity, line number); some spoiled on purpose.
def _roi_items(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    p = F.col("l_partkey").cast("double")
    w, h = F.pmod(p, F.lit(40.0)) * 25.0, F.pmod(p, F.lit(23.0)) * 30.0
    pt = lambda a, b: F.array(a, b)
    x, y = q * 3.5, n * 7.5
    return X.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        F.array(pt(x + w, y), pt(x, y), pt(x, y + h), pt(x + w, y + h)).alias("roi"),
    )


_ROI_SQL = """ri AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, x, y, w, h,
         [[x + w, y], [x, y], [x, y + h], [x + w, y + h]] AS roi
  FROM (SELECT *, l_quantity * 3.5::DOUBLE AS x, l_linenumber * 7.5::DOUBLE AS y, (l_partkey % 40) * 25.0::DOUBLE AS w, (l_partkey % 23) * 30.0::DOUBLE AS h FROM lineitem))"""


@query(
    "f7_parse_roi",
    f"""WITH {_ROI_SQL}, a AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, x, y, w, h, l_partkey % 5 = 4 AS bad FROM ri)
SELECT l_partkey, count(*) AS n, CAST(sum(CASE WHEN bad THEN 0 ELSE 1 END) AS BIGINT) AS valid,
  {r6s("sum(CASE WHEN bad THEN 0.0::DOUBLE ELSE x + w + y + h END)")} AS far_corner
FROM a GROUP BY l_partkey""",
)
def f7(spark, d):
    items = _roi_items(spark, d)
    point = lambda i: F.concat(F.lit("["), F.col("roi")[i][0].cast("string"), F.lit(", "), F.col("roi")[i][1].cast("string"), F.lit("]"))
    four = F.concat(F.lit(" ["), F.concat_ws(",", *[point(i) for i in range(4)]), F.lit("] "))
    bad = F.when(F.pmod("l_orderkey", F.lit(2)) == 0, F.concat(F.lit("[["), F.col("roi")[0][0].cast("string"), F.lit(", 1]]"))).otherwise(
        F.lit('[[1, 2], [3, "x"], [5, 6], [7, 8]]')
    )
    roi = G.parse_roi(F.when(F.pmod("l_partkey", F.lit(5)) == 4, bad).otherwise(four))
    rows = items.select("l_partkey", roi.alias("p"))
    far = F.when(F.col("p").isNotNull(), F.col("p")[3][0] + F.col("p")[3][1]).otherwise(F.lit(0.0))
    return rows.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.count("p").alias("valid"), r6(F.sum(far)).alias("far_corner")
    )


@query(
    "f8_try_number",
    f"""WITH {SG}, a AS (SELECT event_id, trim(CASE k % 9 WHEN 0 THEN 'Infinity' WHEN 1 THEN '  ' || CAST(k AS VARCHAR) || '.5 ' WHEN 2 THEN '' WHEN 3 THEN '1e' || CAST(k AS VARCHAR)
  WHEN 4 THEN CAST(k AS VARCHAR) || 'd' WHEN 5 THEN '-.' || CAST(k AS VARCHAR) WHEN 6 THEN 'NaN' WHEN 7 THEN '0x1F' ELSE CAST(k AS VARCHAR) END) AS t FROM sg)
SELECT event_id, CASE WHEN t = '0x1F' THEN 31.0::DOUBLE WHEN regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(t AS DOUBLE) END AS number FROM a""",
)
def f8(spark, d):
    k = F.pmod("k", F.lit(9))
    s = F.col("k").cast("string")
    t = (
        F.when(k == 0, F.lit("Infinity"))
        .when(k == 1, F.concat(F.lit("  "), s, F.lit(".5 ")))
        .when(k == 2, F.lit(""))
        .when(k == 3, F.concat(F.lit("1e"), s))
        .when(k == 4, F.concat(s, F.lit("d")))
        .when(k == 5, F.concat(F.lit("-."), s))
        .when(k == 6, F.lit("NaN"))
        .when(k == 7, F.lit("0x1F"))
        .otherwise(s)
    )
    return X.signal(spark, d).select("event_id", N.try_number(t).alias("number"))


@query(
    "f9_extract_resolution",
    f"""WITH {X.JOB_LOG_SQL}, a AS (SELECT job_id, seq, CASE WHEN seq % 7 = 0 THEN line || ' LOW resolution 640x' || seq WHEN seq % 3 = 0 THEN replace(line, 'resolved to', 'size') ELSE line END AS line FROM jl),
b AS (SELECT job_id, seq, CASE WHEN regexp_matches(line, '(?i)low resolution\\s+(\\d+)x(\\d+)') THEN regexp_extract(line, '(?i)low resolution\\s+(\\d+x\\d+)', 1)
  WHEN regexp_matches(line, '(?i)resolved to\\s+(\\d+)x(\\d+)') THEN regexp_extract(line, '(?i)resolved to\\s+(\\d+x\\d+)', 1) END AS wh FROM a),
c AS (SELECT job_id, arg_min(wh, seq) FILTER (wh IS NOT NULL) AS wh FROM b GROUP BY job_id)
SELECT job_id, CAST(string_split(wh, 'x')[1] AS BIGINT) AS width, CAST(string_split(wh, 'x')[2] AS BIGINT) AS height FROM c""",
)
def f9(spark, d):
    s = F.col("seq")
    line = (
        F.when(F.pmod(s, F.lit(7)) == 0, F.concat("line", F.lit(" LOW resolution 640x"), s.cast("string")))
        .when(F.pmod(s, F.lit(3)) == 0, F.replace(F.col("line"), F.lit("resolved to"), F.lit("size")))
        .otherwise(F.col("line"))
    )
    found = X.job_log(spark, d).select("job_id", "seq", T.extract_resolution(line).alias("r"))
    first = F.min_by(F.col("r"), F.when(F.col("r").isNotNull(), F.col("seq")))
    return found.groupBy("job_id").agg(first.alias("r")).select("job_id", "r.width", "r.height")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replace_chain(rows: str, column: str, locale: str) -> str:
    """The ordered first-hit replacements as one nested SELECT per entry."""
    for old, new in M.REPLACEMENTS[locale]:
        at = f"instr({column}, {_q(old)})"
        rows = (
            f"(SELECT * REPLACE (CASE WHEN {at} > 0 THEN substring({column}, 1, {at} - 1) || {_q(new)} || "
            f"substring({column}, {at} + {len(old)}) ELSE {column} END AS {column}) FROM {rows})"
        )
    return rows


_LINES = (
    "CASE k % 6 WHEN 0 THEN 'layout mode selected: bottom_bar layout mode selected: bottom_bar' WHEN 1 THEN 'runtime acceleration: opencv=cpu hat_available=False' "
    "WHEN 2 THEN 'review export saved: ' || k || ' pages' WHEN 3 THEN 'frame extraction completed' WHEN 4 THEN 'page transition detected (' || k || ')' ELSE line END"
)


@query(
    "f10_translate_messages",
    f"""WITH {X.SIGNAL_SQL}, jl AS (SELECT event_id, k, event_type || ' resolved to ' || k AS line FROM sg),
ln AS (SELECT event_id, {_LINES} AS a, {_LINES} AS b FROM jl),
t1 AS (SELECT * FROM {_replace_chain("ln", "a", "en")}), t2 AS (SELECT * FROM {_replace_chain("t1", "b", "ko")})
SELECT event_id, a || chr(10) || a AS en, b AS ko FROM t2""",
)
def f10(spark, d):
    line = _messages(F.col("k"), F.concat("event_type", F.lit(" resolved to "), F.col("k").cast("string")))
    rows = X.signal(spark, d).select("event_id", line.alias("line"))
    two = F.concat("line", F.lit("\n"), "line")
    return rows.select("event_id", T.translate_messages(two).alias("en"), T.translate_messages(F.col("line"), "ko").alias("ko"))


def _messages(k, other):
    n, s = F.pmod(k, F.lit(6)), k.cast("string")
    return (
        F.when(n == 0, F.lit("layout mode selected: bottom_bar layout mode selected: bottom_bar"))
        .when(n == 1, F.lit("runtime acceleration: opencv=cpu hat_available=False"))
        .when(n == 2, F.concat(F.lit("review export saved: "), s, F.lit(" pages")))
        .when(n == 3, F.lit("frame extraction completed"))
        .when(n == 4, F.concat(F.lit("page transition detected ("), s, F.lit(")")))
        .otherwise(other)
    )


def _case(table: dict, key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in table.items()) + f" ELSE {default} END"


_PREP = "preview source preparation failed:"
_EN = M.EXACT_ERRORS["en"]


@query(
    "f11_classify_error",
    f"""WITH {X.SIGNAL_SQL}, a AS (SELECT event_id, k, {_case(dict(zip("01234", ("queued", "detecting", "stitching", "odd", ""))), "CAST(k % 5 AS VARCHAR)", "NULL")} AS step,
  CASE k % 8 WHEN 0 THEN 'file_path does not exist' WHEN 1 THEN '{_PREP} Timed Out after ' || k WHEN 2 THEN '{_PREP} http ' || k WHEN 3 THEN '{_PREP}  '
    WHEN 4 THEN 'review export failed: disk ' || k WHEN 5 THEN 'capture file not found: /x/' || k WHEN 6 THEN '' ELSE 'ffmpeg exit ' || k END AS detail FROM sg)
SELECT event_id,
  CASE WHEN detail = '' THEN {_q(M.EMPTY_ERROR["en"])} WHEN detail LIKE '{_PREP}%' THEN
       CASE WHEN trim(substring(detail, {len(_PREP) + 1})) = '' THEN 'Could not load the YouTube video. Check the URL and try again.'
            WHEN lower(detail) LIKE '%timed out%' THEN 'Preparing the YouTube video timed out. Try again shortly or test another link.'
            ELSE 'YouTube preparation failed: ' || trim(substring(detail, {len(_PREP) + 1})) END
       WHEN detail LIKE 'review export failed:%' THEN 'Review export failed: ' || trim(substring(detail, 22))
       WHEN detail LIKE 'capture file not found:%' THEN 'The selected capture file could not be found. Regenerate the results and try again.'
       ELSE {_case(_EN, "detail", "detail")} END AS friendly,
  {_case(M.STEP_NAMES["en"], "step", "CASE WHEN step <> '' THEN step ELSE 'In progress' END")} ||
    CASE WHEN detail <> '' AND NOT regexp_matches(replace(detail, {_q(_PREP)}, 'Source preparation failed:'), {_q(M.TECHNICAL)}) THEN ': ' || replace(detail, {_q(_PREP)}, 'Source preparation failed:')
         ELSE {_case({k: ": " + v for k, v in M.STEP_GUIDES["en"].items()}, "step", "''")} END AS status_text,
  CASE WHEN lower(detail) LIKE '%detect%' THEN 'detect' WHEN lower(detail) LIKE '%ffmpeg%' THEN 'ffmpeg' WHEN lower(detail) LIKE '%youtube%' THEN 'youtube' END AS hint
FROM a""",
)
def f11(spark, d):
    k, s = F.col("k"), F.col("k").cast("string")
    n = F.pmod(k, F.lit(8))
    detail = (
        F.when(n == 0, F.lit("file_path does not exist"))
        .when(n == 1, F.concat(F.lit(_PREP + " Timed Out after "), s))
        .when(n == 2, F.concat(F.lit(_PREP + " http "), s))
        .when(n == 3, F.lit(_PREP + "  "))
        .when(n == 4, F.concat(F.lit("review export failed: disk "), s))
        .when(n == 5, F.concat(F.lit("capture file not found: /x/"), s))
        .when(n == 6, F.lit(""))
        .otherwise(F.concat(F.lit("ffmpeg exit "), s))
    )
    step = F.element_at(F.array(*[F.lit(v) for v in ("queued", "detecting", "stitching", "odd", "")]), F.pmod(k, F.lit(5)) + 1)
    rows = X.signal(spark, d).select("event_id", detail.alias("detail"), step.alias("step"))
    return rows.select(
        "event_id",
        T.classify_error(F.col("detail")).alias("friendly"),
        T.status_text(F.col("step"), F.col("detail")).alias("status_text"),
        T.recovery_hint(F.col("detail")).alias("hint"),
    )


_TEMPLATE = "{{ kind }}: {{value}} of {{missing}}{{kind}} {{ open"


_DETAIL_SQL = """CASE event_id % 13 WHEN 0 THEN '"file_path does not exist"' WHEN 1 THEN '["roi is too small for capture crop", {"msg": "bad value ' || k || '", "loc": ["body", "x"]}, 7]'
    WHEN 2 THEN '[{"loc": ["body", "options", "detect", "roi"], "msg": "field required"}]' WHEN 3 THEN '{"detail": "preview source preparation failed: Timeout ' || k || '"}'
    WHEN 4 THEN '{"message": "job is still running", "code": ' || k || '}' WHEN 5 THEN '{"detail": ["x"], "message": "no valid captures selected"}' WHEN 6 THEN '{"code": ' || k || '}'
    WHEN 7 THEN 'capture file not found: /x/' || k WHEN 8 THEN 'null' WHEN 9 THEN '[]' WHEN 10 THEN '[null, "", 0, false, {"loc": ["a", 1], "type": "t"}, [1, [2, null], "z"], true, ' || k || ']'
    WHEN 11 THEN CAST(k AS VARCHAR) ELSE '{"detail": ""}' END"""


def _friendly_sql(text: str, lang: int) -> str:
    """What the fixture's texts become; column 0 is English, 1 Korean."""
    known = [
        ("= ''", "An error occurred while handling the request.", "요청 처리 중 오류가 발생했습니다."),
        ("= 'file_path does not exist'", "The selected file could not be found. Check the path.", "선택한 파일을 찾을 수 없습니다. 경로를 확인합니다."),
        ("LIKE 'preview source preparation failed: Timeout%'", "Preparing the YouTube video timed out. Try again shortly or test another link.",
         "유튜브 영상 준비 시간이 초과되었습니다. 잠시 후 다시 시도하거나 다른 링크로 확인합니다."),
        ("= 'job is still running'", "Review export is not available while the job is still running.", "작업 실행 중에는 검토 반영을 사용할 수 없습니다. 완료 후 다시 시도합니다."),
        ("= 'no valid captures selected'", "The selected captures could not be found. Select them again.", "선택한 캡처를 찾을 수 없습니다. 다시 선택합니다."),
        ("LIKE 'capture file not found:%'", "The selected capture file could not be found. Regenerate the results and try again.", "선택한 캡처 파일을 찾을 수 없습니다. 결과를 다시 생성한 뒤 시도합니다."),
    ]
    cases = " ".join(f"WHEN {text} {test} THEN '{row[lang]}'" for test, *row in known)
    return f"CASE {cases} ELSE {text} END"


def _structured_sql(lang: int) -> str:
    roi = ("ROI coordinates are required. Open a preview in step 3 and drag the score area.", "악보 영역 좌표가 필요합니다. 3단계에서 미리보기 화면을 불러온 뒤 드래그로 지정합니다.")[lang]
    return f"CASE WHEN places LIKE '%options.detect.roi%' THEN '{roi}' ELSE {_friendly_sql('plain', lang)} END"


@query(
    "f11_structured_errors",
    f"""WITH {X.SIGNAL_SQL}, a AS (SELECT event_id, {_DETAIL_SQL} AS detail FROM sg),
b AS (SELECT event_id, detail, json_valid(detail) AS good, CASE WHEN json_valid(detail) THEN detail::JSON END AS j FROM a),
c AS (SELECT event_id, detail, good, j, json_type(j) AS kind, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [] END AS items FROM b),
t AS (SELECT *, array_to_string(list_transform(items, lambda i: CASE WHEN json_type(i, '$.loc') = 'ARRAY' THEN array_to_string(list_transform(json_extract(i, '$.loc[*]'), lambda e: e->>'$'), '.') ELSE '' END), ' ') AS places,
  list_transform(items, lambda i: CASE json_type(i) WHEN 'NULL' THEN '' WHEN 'OBJECT' THEN CASE WHEN json_type(i, '$.msg') = 'VARCHAR' THEN i->>'$.msg' ELSE '[object Object]' END
    WHEN 'ARRAY' THEN array_to_string(list_transform(json_extract(i, '$[*]'), lambda e: CASE json_type(e) WHEN 'NULL' THEN ''
      WHEN 'ARRAY' THEN array_to_string(list_transform(json_extract(e, '$[*]'), lambda z: coalesce(z->>'$', '')), ',') ELSE e->>'$' END), ',')
    WHEN 'BOOLEAN' THEN CASE WHEN i->>'$' = 'true' THEN 'true' ELSE '' END WHEN 'VARCHAR' THEN i->>'$' ELSE CASE WHEN i->>'$' = '0' THEN '' ELSE i->>'$' END END) AS said FROM c),
p AS (SELECT event_id, places, CASE WHEN NOT good THEN detail WHEN kind = 'NULL' THEN '' WHEN kind = 'ARRAY' THEN array_to_string(list_filter(said, lambda x: x <> ''), ' / ')
    WHEN kind = 'OBJECT' THEN CASE WHEN json_type(j, '$.detail') = 'VARCHAR' THEN j->>'$.detail' WHEN json_type(j, '$.message') = 'VARCHAR' THEN j->>'$.message' ELSE '' END
    WHEN kind = 'VARCHAR' THEN j->>'$' ELSE CASE WHEN j->>'$' = '0' THEN '' ELSE j->>'$' END END AS plain FROM t)
SELECT event_id, {_structured_sql(0)} AS friendly_en, {_structured_sql(1)} AS friendly_ko FROM p""",
)
def f11_structured(spark, d):
    rows = X.signal(spark, d).select("event_id", F.expr(_DETAIL_SQL.replace("VARCHAR", "STRING")).alias("detail"))
    return rows.select("event_id", T.structured_error(F.col("detail"), "en").alias("friendly_en"), T.structured_error(F.col("detail"), "ko").alias("friendly_ko"))


@query(
    "f12_render_template",
    f"""WITH {SG} SELECT event_id, replace(replace(replace(
  CASE WHEN k % 4 = 0 THEN 'plain.key' ELSE {_q(_TEMPLATE)} END, '{{{{ kind }}}}', event_type), '{{{{kind}}}}', event_type), '{{{{value}}}}', CAST(k AS VARCHAR)).replace('{{{{missing}}}}', '') AS text FROM sg""",
)
def f12(spark, d):
    k = F.col("k")
    params = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("value"), k.cast("string"))
    fallback = F.when(F.pmod(k, F.lit(4)) != 0, F.lit(_TEMPLATE))
    text = T.localized(F.lit("plain.key"), F.lit(None).cast("string"), fallback, params)
    return X.signal(spark, d).select("event_id", text.alias("text"))


@query(
    "f13_normalize_locale",
    """SELECT doc_id, CASE WHEN lower(trim(coalesce(nullif(stored, ''), nullif(lang, ''), 'en'))) LIKE 'ko%' THEN 'ko' ELSE 'en' END AS locale
FROM (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN ' KO-kr' WHEN 1 THEN '' WHEN 2 THEN 'en-US' END AS stored FROM documents)""",
)
def f13(spark, d):
    n = F.pmod("doc_id", F.lit(4))
    stored = F.when(n == 0, F.lit(" KO-kr")).when(n == 1, F.lit("")).when(n == 2, F.lit("en-US"))
    return X.table(spark, d, "documents").select("doc_id", T.normalize_locale(stored, F.col("lang")).alias("locale"))


@query(
    "f14_cache_key",
    """SELECT page_id, '_preview_source/v1/' || substring(sha1(url), 1, 16) AS cache_path, 'youtube:' || trim(url) AS fingerprint FROM pages""",
)
def f14(spark, d):
    url = F.col("url")
    return X.table(spark, d, "pages").select(
        "page_id",
        H.cache_path("v1", url).alias("cache_path"),
        H.source_fingerprint(F.lit("youtube"), F.lit(None).cast("string"), url).alias("fingerprint"),
    )


_LEVEL_SQL = "CASE k % 4 WHEN 0 THEN 'aggressive' WHEN 1 THEN 'normal' WHEN 2 THEN 'sensitive' ELSE 'odd' END"
_LAYOUT_SQL = "CASE event_id % 4 WHEN 0 THEN 'bottom_bar' WHEN 1 THEN 'full_scroll' WHEN 2 THEN 'page_turn' ELSE 'other' END"


def _level(k):
    n = F.pmod(k, F.lit(4))
    return F.when(n == 0, F.lit("aggressive")).when(n == 1, F.lit("normal")).when(n == 2, F.lit("sensitive")).otherwise(F.lit("odd"))


def _layout(k):
    n = F.pmod(k, F.lit(4))
    return F.when(n == 0, F.lit("bottom_bar")).when(n == 1, F.lit("full_scroll")).when(n == 2, F.lit("page_turn")).otherwise(F.lit("other"))


@query(
    "f15_level_threshold",
    f"""WITH {SG} SELECT event_id, CASE {_LEVEL_SQL} WHEN 'aggressive' THEN 0.045::DOUBLE WHEN 'sensitive' THEN 0.016::DOUBLE ELSE 0.028::DOUBLE END AS static_cut,
  CASE {_LEVEL_SQL} WHEN 'aggressive' THEN 5.4::DOUBLE WHEN 'sensitive' THEN 1.8::DOUBLE ELSE 3.2::DOUBLE END AS scroll_min FROM sg""",
)
def f15(spark, d):
    level = _level(F.col("k"))
    return X.signal(spark, d).select(
        "event_id", N.level_threshold(level, C.STATIC_CUT["bottom_bar"]).alias("static_cut"), N.scroll_minimum(level).alias("scroll_min")
    )


@query(
    "f16_effective_overlap",
    f"""WITH {SG}, a AS (SELECT event_id, {_LAYOUT_SQL} AS layout, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 150.0::DOUBLE - 0.1::DOUBLE)) AS r FROM sg)
SELECT event_id, layout, {r6s("CASE layout WHEN 'bottom_bar' THEN greatest(0.56::DOUBLE, least(0.9::DOUBLE, 0.5::DOUBLE + r * 0.52::DOUBLE)) WHEN 'full_scroll' THEN greatest(0.62::DOUBLE, least(0.94::DOUBLE, 0.55::DOUBLE + r * 0.58::DOUBLE)) WHEN 'page_turn' THEN greatest(0.74::DOUBLE, least(0.97::DOUBLE, 0.68::DOUBLE + r * 0.28::DOUBLE)) ELSE greatest(0.6::DOUBLE, least(0.92::DOUBLE, 0.54::DOUBLE + r * 0.56::DOUBLE)) END")} AS threshold,
  {r6s("greatest(0.88::DOUBLE, least(0.98::DOUBLE, 1.0::DOUBLE - r * 0.25::DOUBLE))")} AS similarity FROM a""",
)
def f16(spark, d):
    raw = F.col("value") / 150.0 - 0.1
    layout = _layout(F.col("event_id"))
    return X.signal(spark, d).select(
        "event_id",
        layout.alias("layout"),
        r6(N.effective_overlap(raw, layout)).alias("threshold"),
        r6(N.page_turn_similarity(N.clamp(raw, 0.0, 1.0))).alias("similarity"),
    )


@query(
    "f17_pipeline_step",
    f"""WITH {X.JOB_PATCHES_SQL}, a AS (SELECT coalesce(current_step, 'Queued') AS step, coalesce(progress, 0.0::DOUBLE) AS p, progress, seq FROM jp)
SELECT CASE lower(step) WHEN 'done' THEN 5 WHEN 'initializing' THEN CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END WHEN 'queued' THEN CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END
  WHEN 'detecting' THEN CASE WHEN p < 0.36::DOUBLE THEN 1 ELSE 2 END WHEN 'rectifying' THEN 3 WHEN 'stitching' THEN 3 WHEN 'upscaling' THEN 4 WHEN 'exporting' THEN 5 ELSE 0 END AS stage,
  CAST(greatest(0, least(100, floor(p * 100.0::DOUBLE + 0.5::DOUBLE))) AS INTEGER) AS percent, count(*) AS n FROM a GROUP BY ALL""",
)
def f17(spark, d):
    step = F.coalesce("current_step", F.lit("Queued"))
    index = N.pipeline_index(step, F.col("progress"), F.pmod("seq", F.lit(2)) == 0)
    pct = N.percent(F.coalesce("progress", F.lit(0.0)))
    return X.job_patches(spark, d).groupBy(index.alias("stage"), pct.alias("percent")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f18_target_size",
    """SELECT p_partkey, greatest(2, CAST(round_even(w * 2.5::DOUBLE, 0) AS INTEGER)) AS up_w,
  CASE WHEN greatest(w, h) > 2400 THEN greatest(1, CAST(round_even(w * (2400.0::DOUBLE / greatest(w, h)), 0) AS INTEGER)) ELSE w END AS pdf_w,
  CASE WHEN greatest(w, h) > 2400 THEN greatest(1, CAST(round_even(h * (2400.0::DOUBLE / greatest(w, h)), 0) AS INTEGER)) ELSE h END AS pdf_h
FROM (SELECT p_partkey, CAST(p_size * 61 + 1 AS INTEGER) AS w, CAST(p_partkey % 4000 AS INTEGER) AS h FROM part)""",
)
def f18(spark, d):
    w, h = (F.col("p_size") * 61 + 1).cast("int"), F.pmod("p_partkey", F.lit(4000)).cast("int")
    return X.table(spark, d, "part").select(
        "p_partkey", N.target_side(w, F.lit(2.5)).alias("up_w"), N.pdf_side(w, w, h).alias("pdf_w"), N.pdf_side(h, w, h).alias("pdf_h")
    )


def _if_list(rules) -> str:
    """Comma-joined names of the true rules, in order."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n in rules) + "], lambda c: c IS NOT NULL), ',')"


_ISSUES = [
    ("w / 1280.0::DOUBLE < 0.34", "width_low"), ("w / 1280.0::DOUBLE > 0.96", "width_high"), ("h / 720.0::DOUBLE < 0.18", "height_low"),
    ("h / 720.0::DOUBLE > 0.88", "height_high"), ("y / 720.0::DOUBLE < 0.015 OR (720.0::DOUBLE - (y + h)) / 720.0::DOUBLE < 0.015", "margin_tight"),
    ("y / 720.0::DOUBLE > 0.32", "top_margin_high"), ("(720.0::DOUBLE - (y + h)) / 720.0::DOUBLE > 0.32", "bottom_margin_high"),
]


@query("f19_roi_issues", f"""WITH {_ROI_SQL}, a AS (SELECT {_if_list(_ISSUES)} AS issues FROM ri) SELECT issues, count(*) AS n FROM a GROUP BY issues""")
def f19(spark, d):
    at = lambda i, j: F.col("roi")[i][j]
    issues = G.roi_issues(at(1, 0), at(0, 1), at(0, 0), at(2, 1), F.lit(1280.0), F.lit(720.0))
    return _roi_items(spark, d).groupBy(F.array_join(issues, ",").alias("issues")).agg(F.count(F.lit(1)).alias("n"))


# --- projections ---------------------------------------------------------------------------


@query(
    "p1_expand_presets",
    f"""WITH {SG}, a AS (SELECT event_id, CASE k % 4 WHEN 0 THEN 'basic' WHEN 1 THEN 'scroll' WHEN 2 THEN 'quality' ELSE event_type END AS preset, CASE WHEN k % 7 = 0 THEN value / 100 WHEN k % 7 = 1 THEN 0.0::DOUBLE END AS fps FROM sg)
SELECT event_id, preset, CASE preset WHEN 'scroll' THEN 'low' WHEN 'quality' THEN 'high' ELSE 'medium' END AS sensitivity, preset = 'scroll' AS stitch,
  CASE WHEN preset = 'scroll' THEN 0.26::DOUBLE ELSE 0.2::DOUBLE END AS overlap, preset = 'quality' AS upscale, CASE WHEN preset = 'quality' THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END AS upscale_factor,
  CASE preset WHEN 'scroll' THEN 'aggressive' WHEN 'quality' THEN 'sensitive' ELSE 'normal' END AS dedupe_level,
  CASE WHEN fps > 0 THEN fps ELSE CASE preset WHEN 'scroll' THEN 0.6::DOUBLE WHEN 'quality' THEN 1.8::DOUBLE ELSE 1.0::DOUBLE END END AS capture_fps FROM a""",
)
def p1(spark, d):
    k = F.col("k")
    n, m = F.pmod(k, F.lit(4)), F.pmod(k, F.lit(7))
    preset = F.when(n == 0, F.lit("basic")).when(n == 1, F.lit("scroll")).when(n == 2, F.lit("quality")).otherwise(F.col("event_type"))
    fps = F.when(m == 0, F.col("value") / 100).when(m == 1, F.lit(0.0))
    rows = X.signal(spark, d).select("event_id", preset.alias("preset"), fps.alias("fps"))
    return P.expand_presets(rows, "preset", fps="fps").drop("fps")


@query(
    "p2_clip_time_range",
    f"""WITH {SG}, b AS (SELECT *, sec - 1704067200.0::DOUBLE AS s FROM sg)
SELECT source_id, count(*) AS n, {r6s("min(s)")} AS first_sec, {r6s("max(s)")} AS last_sec FROM b
WHERE (source_id % 3 = 0 OR s >= 86400.0::DOUBLE * 3) AND s < 86400.0::DOUBLE * 20 GROUP BY source_id""",
)
def p2(spark, d):
    rows = X.signal(spark, d).withColumn("s", F.col("sec") - 1704067200.0)
    start = F.when(F.pmod("source_id", F.lit(3)) != 0, F.lit(86400.0 * 3))
    kept = P.clip_time_range(rows, "s", start, 86400.0 * 20)
    return kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), r6(F.min("s")).alias("first_sec"), r6(F.max("s")).alias("last_sec"))


_FPS = 1 / 43200


@query(
    "p3_sample_frames",
    f"""WITH {SG}, t AS (SELECT source_id, min(sec) AS t0 FROM sg GROUP BY source_id),
a AS (SELECT sg.source_id, CAST(floor((sec - t0) * {_FPS!r}::DOUBLE) AS BIGINT) AS slot, arg_min(event_id, ROW(sec, event_id)) AS event_id FROM sg JOIN t USING (source_id) GROUP BY ALL),
b AS (SELECT *, lead(slot) OVER (PARTITION BY source_id ORDER BY slot) AS nxt FROM a),
c AS (SELECT source_id, slot AS first_slot, unnest(range(slot, coalesce(nxt, slot + 1))) AS slot, event_id FROM b)
SELECT source_id, slot, slot <> first_slot AS filled, event_id FROM c""",
)
def p3(spark, d):
    rows = X.signal(spark, d).select("source_id", "sec", "event_id")
    out = P.sample_frames(rows, ["source_id"], "sec", _FPS, tie=["event_id"], fill=True)
    return out.select("source_id", "slot", "filled", "event_id")


_HOSTS = ("therwh.example.org", "www.youtube.com", "youtu.be")


@query(
    "p4_validate_sources",
    """WITH a AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'file' WHEN page_id % 11 = 0 THEN 'disk' ELSE 'youtube' END AS kind,
  CASE page_id % 5 WHEN 0 THEN ' ' || replace(url, 'http://', 'HTTP://user@') || ' ' WHEN 1 THEN '' WHEN 2 THEN 'ftp' || substring(url, 5) WHEN 3 THEN 'https://WWW.YouTube.com:443/watch?v=' || page_id ELSE url END AS url,
  CASE WHEN page_id % 12 = 0 THEN '  ' ELSE ' /v/' || page_id || '.mp4' END AS path FROM pages),
b AS (SELECT *, trim(url) AS u, lower(regexp_extract(regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '^.*@', ''), '^([^:]*)', 1)) AS host FROM a),
c AS (SELECT *, CASE WHEN kind NOT IN ('file','youtube') THEN 'unsupported source_type: ' || kind WHEN kind = 'file' AND trim(path) = '' THEN 'file_path is required when source_type is file'
  WHEN kind = 'youtube' AND u = '' THEN 'youtube_url is required when source_type is youtube' WHEN kind = 'youtube' AND lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) NOT IN ('http','https') THEN 'youtube_url must use http or https'
  WHEN kind = 'youtube' AND host NOT IN ('therwh.example.org','www.youtube.com','youtu.be') THEN 'youtube_url must point to a supported host' END AS reason FROM b)
SELECT page_id, CASE WHEN reason IS NULL THEN CASE WHEN kind = 'file' THEN trim(path) ELSE u END END AS source_value, reason FROM c""",
)
def p4(spark, d):
    n, url, s = F.col("page_id"), F.col("url"), F.col("page_id").cast("string")
    m = F.pmod(n, F.lit(5))
    address = (
        F.when(m == 0, F.concat(F.lit(" "), F.replace(url, F.lit("http://"), F.lit("HTTP://user@")), F.lit(" ")))
        .when(m == 1, F.lit(""))
        .when(m == 2, F.concat(F.lit("ftp"), F.substring(url, 5, 1 << 20)))
        .when(m == 3, F.concat(F.lit("https://WWW.YouTube.com:443/watch?v="), s))
        .otherwise(url)
    )
    kind = F.when(F.pmod(n, F.lit(6)) == 0, F.lit("file")).when(F.pmod(n, F.lit(11)) == 0, F.lit("disk")).otherwise(F.lit("youtube"))
    path = F.when(F.pmod(n, F.lit(12)) == 0, F.lit("  ")).otherwise(F.concat(F.lit(" /v/"), s, F.lit(".mp4")))
    rows = X.table(spark, d, "pages").select("page_id", kind.alias("source_type"), address.alias("url"), path.alias("file_path"))
    return P.validate_sources(rows, hosts=_HOSTS).select("page_id", "source_value", "reason")


_RULES = [
    ("e <= s", "end_not_after_start"), ("s < 0", "start_negative"), ("e < 0", "end_negative"), ("f <= 0", "fps_not_positive"), ("n <> 4", "roi_not_four_points"),
    ("o < 0 OR o > 1", "overlap_out_of_range"), ("c < 1 OR c > 4", "scale_out_of_range"), ("u AND c <= 1", "scale_needs_more_than_one"), ("x NOT IN ('png','jpg','jpeg','pdf')", "format_unknown"),
]


@query(
    "p5_validate_options",
    f"""WITH a AS (SELECT l_quantity - 3 AS s, CASE WHEN l_linenumber <> 1 THEN l_linenumber * 9.0::DOUBLE - 10 END AS e, l_discount - 0.01::DOUBLE AS f, 3 + l_linenumber % 2 AS n,
  l_tax * 14 AS o, l_quantity / 12 AS c, l_returnflag = 'R' AS u, CASE WHEN l_linestatus = 'O' THEN 'png' ELSE lower(l_returnflag) END AS x FROM lineitem),
b AS (SELECT {_if_list(_RULES)} AS broken FROM a) SELECT broken, count(*) AS n FROM b GROUP BY broken""",
)
def p5(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    point = F.array(q, q)
    fields = {
        "start_sec": q - 3,
        "end_sec": F.when(n != 1, n * 9.0 - 10),
        "fps": F.col("l_discount") - 0.01,
        "roi": F.array_repeat(point, 3 + F.pmod(n, F.lit(2))),
        "overlap_threshold": F.col("l_tax") * 14,
        "scale": q / 12,
        "upscale": F.col("l_returnflag") == "R",
        "formats": F.array(F.when(F.col("l_linestatus") == "O", F.lit("png")).otherwise(F.lower("l_returnflag"))),
    }
    rows = P.validate_options(X.table(spark, d, "lineitem"), fields)
    return rows.groupBy(F.array_join("broken", ",").alias("broken")).agg(F.count(F.lit(1)).alias("n"))


_ARG = "roi[list_position(list_transform(roi, lambda p: {e}), {f}(list_transform(roi, lambda p: {e})))]"
_TL, _TR = _ARG.format(e="p[1] + p[2]", f="list_min"), _ARG.format(e="p[2] - p[1]", f="list_min")
_BR, _BL = _ARG.format(e="p[1] + p[2]", f="list_max"), _ARG.format(e="p[2] - p[1]", f="list_max")


@query(
    "p6_order_roi_points",
    f"""WITH {_ROI_SQL}, a AS (SELECT l_partkey, {_TL} AS tl, {_TR} AS tr, {_BR} AS br, {_BL} AS bl FROM ri),
b AS (SELECT *, sqrt((tl[1]-tr[1])*(tl[1]-tr[1]) + (tl[2]-tr[2])*(tl[2]-tr[2])) + sqrt((br[1]-bl[1])*(br[1]-bl[1]) + (br[2]-bl[2])*(br[2]-bl[2])) > 2
  AND sqrt((tl[1]-bl[1])*(tl[1]-bl[1]) + (tl[2]-bl[2])*(tl[2]-bl[2])) + sqrt((tr[1]-br[1])*(tr[1]-br[1]) + (tr[2]-br[2])*(tr[2]-br[2])) > 2 AS fine FROM a)
SELECT l_partkey, CAST(count(*) FILTER (fine) AS BIGINT) AS fine, {r6s("sum(tl[1] + 2 * tl[2])")} AS tl, {r6s("sum(tr[1] + 2 * tr[2])")} AS tr, {r6s("sum(br[1] + 2 * br[2])")} AS br, {r6s("sum(bl[1] + 2 * bl[2])")} AS bl FROM b GROUP BY l_partkey""",
)
def p6(spark, d):
    rows = _roi_items(spark, d).withColumn("o", G.order_roi_points(F.col("roi")))
    mark = lambda i: r6(F.sum(F.col("o")[i][0] + 2 * F.col("o")[i][1]))
    return rows.groupBy("l_partkey").agg(
        F.count_if(G.roi_large_enough(F.col("o"))).alias("fine"), *[mark(i).alias(n) for i, n in enumerate(("tl", "tr", "br", "bl"))]
    )


@query(
    "p7_roi_rect",
    f"""WITH {_ROI_SQL}, a AS (SELECT *, greatest(0, least(639, CAST(round_even(x, 0) AS INTEGER))) AS x1, greatest(0, least(359, CAST(round_even(y, 0) AS INTEGER))) AS y1 FROM ri),
b AS (SELECT x1, y1, greatest(x1 + 1, least(640, CAST(round_even(x + w, 0) AS INTEGER))) AS x2, greatest(y1 + 1, least(360, CAST(round_even(y + h, 0) AS INTEGER))) AS y2 FROM a)
SELECT x1, y1, x2, y2, count(*) AS n FROM b GROUP BY ALL""",
)
def p7(spark, d):
    rect = G.roi_rect(F.col("roi"), F.lit(640), F.lit(360))
    return _roi_items(spark, d).select(rect.alias("r")).groupBy("r.x1", "r.y1", "r.x2", "r.y2").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p8_crop_box",
    f"""WITH {_ROI_SQL}, a AS (SELECT l_partkey, CASE WHEN l_partkey % 7 = 0 THEN 'nan' WHEN l_partkey % 11 = 0 THEN 'three' END AS spoil,
  CAST(round_even(least(640.0::DOUBLE, greatest(0.0::DOUBLE, x)), 0) AS INTEGER) AS x1, CAST(round_even(least(360.0::DOUBLE, greatest(0.0::DOUBLE, y)), 0) AS INTEGER) AS y1,
  CAST(round_even(least(640.0::DOUBLE, x + w), 0) AS INTEGER) AS x2, CAST(round_even(least(360.0::DOUBLE, y + h), 0) AS INTEGER) AS y2 FROM ri),
b AS (SELECT *, CASE WHEN spoil = 'three' THEN 'roi must be 4 points: [[x,y], ...]' WHEN spoil = 'nan' THEN 'roi includes invalid number' WHEN x2 - x1 < 16 OR y2 - y1 < 16 THEN 'roi is too small for capture crop' END AS reason FROM a)
SELECT reason, CASE WHEN reason IS NULL THEN x2 - x1 END AS width, CASE WHEN reason IS NULL THEN y2 - y1 END AS height, count(*) AS n FROM b GROUP BY ALL""",
)
def p8(spark, d):
    p, roi = F.col("l_partkey"), F.col("roi")
    nan = F.concat(F.slice(roi, 1, 3), F.array(F.array(F.lit(float("nan")), F.lit(1.0))))
    spoiled = F.when(F.pmod(p, F.lit(7)) == 0, nan).when(F.pmod(p, F.lit(11)) == 0, F.slice(roi, 1, 3)).otherwise(roi)
    box = G.crop_box(spoiled, F.lit(640), F.lit(360))
    rows = _roi_items(spark, d).select(box.alias("b"))
    return rows.groupBy("b.reason", (F.col("b.x2") - F.col("b.x1")).alias("width"), (F.col("b.y2") - F.col("b.y1")).alias("height")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "p9_infer_layout",
    f"""WITH {_ROI_SQL}, a AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'page_turn' WHEN 1 THEN 'auto' ELSE NULL END AS hint, l_suppkey % 2 = 0 AS st, CASE WHEN l_suppkey % 3 = 0 THEN 'youtube' ELSE 'file' END AS kind FROM ri),
b AS (SELECT CASE WHEN hint = 'page_turn' THEN hint WHEN NOT (w > 2 AND h > 2) THEN CASE WHEN kind = 'youtube' THEN 'bottom_bar' ELSE 'full_scroll' END
  WHEN ((x + w) - x) / greatest(1.0::DOUBLE, (y + h) - y) >= 2.25 THEN 'bottom_bar' WHEN st THEN 'full_scroll' WHEN kind = 'youtube' THEN 'bottom_bar' ELSE 'full_scroll' END AS layout,
  CASE WHEN coalesce(hint, 'auto') = 'page_turn' THEN 'page_turn' WHEN st THEN 'full_scroll' WHEN kind = 'youtube' THEN 'bottom_bar' ELSE 'full_scroll' END AS stitch_layout FROM a)
SELECT layout, stitch_layout, count(*) AS n FROM b GROUP BY ALL""",
)
def p9(spark, d):
    m = F.pmod("l_linenumber", F.lit(4))
    hint = F.when(m == 0, F.lit("page_turn")).when(m == 1, F.lit("auto"))
    stitch = F.pmod("l_suppkey", F.lit(2)) == 0
    kind = F.when(F.pmod("l_suppkey", F.lit(3)) == 0, F.lit("youtube")).otherwise(F.lit("file"))
    inherited = G.inherit_hint(F.when(stitch, F.lit("full_scroll")).otherwise(F.lit("auto")), F.coalesce(hint, F.lit("auto")))
    inherited = F.when(hint == "page_turn", F.lit("page_turn")).otherwise(inherited)
    rows = _roi_items(spark, d).select(
        G.infer_layout(hint, F.col("roi"), stitch, kind).alias("layout"), G.resolve_layout(inherited, kind).alias("stitch_layout")
    )
    return rows.groupBy("layout", "stitch_layout").agg(F.count(F.lit(1)).alias("n"))


_FOLD = "list_reduce(string_split(f, '/'), lambda a, p: CASE WHEN p = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN p IN ('', '.') THEN a ELSE a || '/' || p END, '')"


@query(
    "p11_resolve_paths",
    f"""WITH a AS (SELECT page_id, 'job' || (page_id % 3) AS job, regexp_replace(url, '^https?://[^/]*/', '') AS tail FROM pages),
b AS (SELECT page_id, job, CASE page_id % 5 WHEN 0 THEN '/jobs-files/' || job || '/export/./' || page_id || '.PNG' WHEN 1 THEN 'jobs-files//' || job || '/a/../b/' || page_id || '.jpg'
  WHEN 2 THEN '/jobs-files/' || job || '/../job9/' || page_id || '.png' WHEN 3 THEN ' /jobs/' || job || '/' || tail ELSE '/jobs-files/' || job || '/x/' || page_id || '.jpeg ' END AS raw FROM a),
c AS (SELECT page_id, job, CASE WHEN regexp_matches(trim(raw), '^/?jobs-files/') THEN '/jobs/' || regexp_replace(trim(raw), '^/?jobs-files/*', '') ELSE trim(raw) END AS f FROM b),
e AS (SELECT page_id, job, {_FOLD} AS r FROM c),
g AS (SELECT *, CASE WHEN NOT (r = '/jobs/' || job OR r LIKE '/jobs/' || job || '/%') THEN 'capture path must be inside this job directory' WHEN NOT regexp_matches(lower(r), '\\.(png|jpg|jpeg)$') THEN 'unsupported capture format' END AS reason FROM e)
SELECT page_id, CASE WHEN reason IS NULL THEN r END AS resolved, reason FROM g""",
)
def p11(spark, d):
    n, s = F.pmod("page_id", F.lit(5)), F.col("page_id").cast("string")
    job = F.concat(F.lit("job"), F.pmod("page_id", F.lit(3)).cast("string"))
    tail = F.regexp_replace("url", "^https?://[^/]*/", "")
    raw = (
        F.when(n == 0, F.concat(F.lit("/jobs-files/"), job, F.lit("/export/./"), s, F.lit(".PNG")))
        .when(n == 1, F.concat(F.lit("jobs-files//"), job, F.lit("/a/../b/"), s, F.lit(".jpg")))
        .when(n == 2, F.concat(F.lit("/jobs-files/"), job, F.lit("/../job9/"), s, F.lit(".png")))
        .when(n == 3, F.concat(F.lit(" /jobs/"), job, F.lit("/"), tail))
        .otherwise(F.concat(F.lit("/jobs-files/"), job, F.lit("/x/"), s, F.lit(".jpeg ")))
    )
    rows = X.table(spark, d, "pages").select("page_id", raw.alias("path"), F.concat(F.lit("/jobs/"), job).alias("root"))
    return P.resolve_paths(rows, "path", F.col("root")).select("page_id", "resolved", "reason")
