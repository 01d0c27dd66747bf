"""Views over the given tables that stand for frames, sheets, jobs, captures and logs.

Each view is a DataFrame here and the same relation as a SQL text for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.runs import Ordered
from folioflow.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(ts) -> F.Column:
    """TIMESTAMP_NTZ read as UTC, as an instant, whatever the session's time zone."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(ts)))


# --- frames ------------------------------------------------------------------------------

GRID = 8


def micro_frames(spark, sf_dir, gain: int = 100, grid: int = GRID) -> DataFrame:
    """8x8 gray frames: one per embedding, one source per label."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("source_id"),
        "vec_id",
        F.transform(
            "embedding",
            lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.lit(128.0) + F.lit(float(gain)) * x.cast("double")))).cast("int"),
        ).alias("px"),
    )
    rows = Ordered(e, ["source_id"], ["vec_id"]).position("frame_index").result()
    return rows.withColumns({"width": F.lit(grid), "height": F.lit(grid)})


def micro_frames_sql(gain: int = 100) -> str:
    return f"""mf AS (
  SELECT CAST(label AS INTEGER) AS source_id, vec_id,
         CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame_index,
         list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor(128.0::DOUBLE + {gain}.0::DOUBLE * CAST(x AS DOUBLE)))) AS INTEGER)) AS px
  FROM embeddings)"""


# --- sheets ------------------------------------------------------------------------------


def sheet_profile(spark, sf_dir, sheets: int = 10) -> DataFrame:
    """Tall sheets: one row per ship day, density from the day's quantity, every day present.

    The daily sums and the profile are staged: the line items are read once, whatever follows.
    """
    items = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % sheets).cast("int").alias("sheet_id"),
        F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01")).alias("day"),
        "l_quantity",
    )
    days = stage(items.groupBy("sheet_id", "day").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n")))
    facts = days.groupBy("sheet_id").agg(F.max("n").alias("most"))
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    grid = facts.select("sheet_id", "most", lo.alias("lo"), F.explode(F.sequence(lo, hi)).alias("day"))
    dens = F.floor(F.coalesce("q", F.lit(0.0)) / (50.0 * F.col("most")) * 0.06 * 1e6 + 0.5) / 1e6
    rows = grid.join(days.drop("n"), ["sheet_id", "day"], "left")
    return stage(rows.select("sheet_id", (F.col("day") - F.col("lo")).alias("y"), dens.alias("density")))


def sheet_profile_sql(sheets: int = 10) -> str:
    return f"""days AS (
  SELECT CAST(l_suppkey % {sheets} AS INTEGER) AS sheet_id, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day,
         sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL),
facts AS (SELECT sheet_id, max(n) AS most FROM days GROUP BY sheet_id),
span AS (SELECT min(day) AS lo, max(day) AS hi FROM days),
sp AS (
  SELECT g.sheet_id, CAST(g.day - g.lo AS INTEGER) AS y,
         floor(coalesce(d.q, 0.0::DOUBLE) / (50.0::DOUBLE * g.most) * 0.06::DOUBLE * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS density
  FROM (SELECT f.sheet_id, f.most, s.lo, unnest(range(s.lo, s.hi + 1)) AS day FROM facts f, span s) g
  LEFT JOIN days d ON d.sheet_id = g.sheet_id AND d.day = g.day)"""


def text_sheet(spark, sf_dir) -> DataFrame:
    """Short sheets: one row per text line, density = share of non-space characters of the longest line."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sheet_id"), F.split("text", "\n").alias("lines"))
    longest = F.greatest(F.lit(1), F.array_max(F.transform("lines", lambda s: F.length(s))))
    rows = docs.select("sheet_id", longest.alias("w"), F.posexplode("lines").alias("y", "line"))
    ink = F.length(F.regexp_replace("line", " ", ""))
    return rows.select("sheet_id", "y", (ink / F.col("w")).alias("density"))


TEXT_SHEET_SQL = """tl AS (SELECT doc_id AS sheet_id, string_split(text, chr(10)) AS lines FROM documents),
ts AS (
  SELECT sheet_id, CAST(unnest(range(len(lines))) AS INTEGER) AS y, unnest(lines) AS line,
         greatest(1, list_max(list_transform(lines, lambda s: length(s)))) AS w FROM tl),
tsp AS (SELECT sheet_id, y, CAST(length(replace(line, ' ', '')) AS DOUBLE) / w AS density FROM ts)"""


# --- jobs and signals ----------------------------------------------------------------------


def signal(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"),
        _micros("ts").alias("ts"),
        (F.unix_micros(_micros("ts")) / 1e6).alias("sec"),
        "event_id",
        "value",
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


SIGNAL_SQL = """sg AS (
  SELECT user_id AS source_id, ts, epoch_us(ts) / 1e6::DOUBLE AS sec, event_id, value, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""

_STEPS = ("initializing", "detecting", "rectifying", "stitching", "exporting")


def job_patches(spark, sf_dir) -> DataFrame:
    kind, k = F.col("event_type"), F.col("k")
    status = (
        F.when(kind.isin("view", "click"), F.lit("running"))
        .when(kind == "purchase", F.lit("done"))
        .when(kind == "error", F.lit("error"))
        .otherwise(F.lit("queued"))
    )
    step = F.element_at(F.array(*[F.lit(s) for s in _STEPS]), F.pmod(k, F.lit(5)) + 1)
    return signal(spark, sf_dir).select(
        F.col("source_id").alias("job_id"),
        "ts",
        F.col("event_id").alias("seq"),
        status.alias("status"),
        F.when(kind.isin("view", "click"), F.col("value") / 200.0).alias("progress"),
        F.when(F.pmod(k, F.lit(2)) == 0, step).alias("current_step"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("k="), k.cast("string"))).alias("message"),
        F.when(kind == "error", F.concat(F.lit("E"), k.cast("string"))).alias("error_code"),
    )


JOB_PATCHES_SQL = (
    SIGNAL_SQL
    + """,
jp AS (
  SELECT source_id AS job_id, ts, event_id AS seq,
         CASE WHEN event_type IN ('view','click') THEN 'running' WHEN event_type = 'purchase' THEN 'done'
              WHEN event_type = 'error' THEN 'error' ELSE 'queued' END AS status,
         CASE WHEN event_type IN ('view','click') THEN value / 200.0::DOUBLE END AS progress,
         CASE WHEN k % 2 = 0 THEN ['initializing','detecting','rectifying','stitching','exporting'][k % 5 + 1] END AS current_step,
         CASE WHEN k % 3 = 0 THEN 'k=' || k END AS message,
         CASE WHEN event_type = 'error' THEN 'E' || k END AS error_code
  FROM sg)"""
)


def job_log(spark, sf_dir) -> DataFrame:
    line = F.concat(
        "event_type", F.lit(" resolved to "), F.floor("value").cast("bigint").cast("string"), F.lit("x"), F.col("k").cast("string")
    )
    return signal(spark, sf_dir).select(
        F.col("source_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", line.alias("line")
    )


JOB_LOG_SQL = (
    SIGNAL_SQL
    + """,
jl AS (SELECT source_id AS job_id, event_id AS seq, ts,
              event_type || ' resolved to ' || CAST(floor(value) AS BIGINT) || 'x' || k AS line FROM sg)"""
)


def captures(spark, sf_dir) -> DataFrame:
    """One capture per document, one job per document source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("job_id"), "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = Ordered(docs, ["job_id"], ["doc_id"]).position("idx").result().join(labels, "doc_id", "left")
    return rows.select(
        "job_id",
        "idx",
        "doc_id",
        "n_chars",
        F.concat(F.lit("/jobs-files/"), "job_id", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("suspicious"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("kept"),
    )


CAPTURES_SQL = """cp AS (
  SELECT d.source AS job_id, CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS INTEGER) AS idx,
         d.doc_id, d.n_chars, '/jobs-files/' || d.source || '/' || d.doc_id || '.png' AS path,
         coalesce(l.toxic, 0) = 1 AS suspicious, coalesce(l.quality, 1) = 1 AS kept
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def assets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/jobs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"),
        F.col("source").alias("child"),
        F.col("n_chars").alias("length"),
        F.col("doc_id").alias("mtime"),
    )


def renditions(spark, sf_dir) -> DataFrame:
    height = F.col("p_size") * 30
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("key"),
        F.concat(F.lit("v"), F.col("p_partkey").cast("string"), F.lit(".mp4")).alias("path"),
        height.cast("bigint").alias("height"),
        F.floor(height * 16 / 9).cast("bigint").alias("width"),
        F.col("p_partkey").alias("mtime"),
    )


RENDITIONS_SQL = """rn AS (
  SELECT p_brand AS key, 'v' || p_partkey || '.mp4' AS path, CAST(p_size * 30 AS BIGINT) AS height,
         CAST(floor(p_size * 30 * 16 / 9.0::DOUBLE) AS BIGINT) AS width, p_partkey AS mtime FROM part)"""
