"""Registered queries of the training-data operators, over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import (
    alignment, conversations, decontaminate, language, licenses, lines, mixing, packing, pages, quality, sharding, simhash, substrings,
)
from folioflow.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SHARDS = 24


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op2_kd_shards")
def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_table(table(spark, sf_dir, "documents"), shards=SHARDS)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


_BENCH = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_HITS_SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, {_BENCH} AS ws FROM documents
), b AS (
  SELECT item_id, {_BENCH} AS ws FROM benchmark
), bw AS (
  SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0
), bk AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS k FROM bw
), dw AS (
  SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bk) AS sizes WHERE len(ws) >= n
), dk AS (
  SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS k FROM dw
), h AS (
  SELECT rid, n, i, item_id FROM dk JOIN bk USING (n, k)
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid
), it AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.rid = d.rid LEFT JOIN it ON it.rid = d.rid
"""


@query("op3_decontaminate", _HITS_SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


@query("op5_page_text")
def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


_LINES_SQL = """
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), e AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS no, unnest(ls) AS line FROM l
), w AS (
  SELECT doc_id, no, regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+') AS ws FROM e
), s AS (
  SELECT row_number() OVER (ORDER BY doc_id, no) AS lid, doc_id, no,
         list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i : i + 4], ' '))) AS grams
  FROM w WHERE len(ws) > 0
), g AS (
  SELECT lid, len(grams) AS n, unnest(grams) AS k FROM s
), o AS (
  SELECT a.lid, a.n AS n, b.n AS m, count(*) AS common FROM g a JOIN g b ON a.k = b.k AND b.lid < a.lid GROUP BY a.lid, b.lid, a.n, b.n
), r AS (
  SELECT DISTINCT lid FROM o WHERE 5 * common >= 4 * (n + m - common)
), x AS (
  SELECT doc_id, list(no ORDER BY no) AS gone FROM s JOIN r USING (lid) GROUP BY doc_id
)
SELECT l.doc_id, coalesce(len(ls), 0)::INTEGER AS n_lines, coalesce(len(gone), 0)::INTEGER AS n_removed, coalesce(array_to_string(gone, ','), '') AS removed_lines,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10)) END AS text
FROM l LEFT JOIN x ON x.doc_id = l.doc_id
"""


@query("op6_line_dedup", _LINES_SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents"))
    return out.withColumn("removed_lines", F.array_join(F.col("removed_lines").cast("array<string>"), ","))


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", F.size("lang_mix").alias("n_langs"))


@query("op8_unit_dedup")
def op8_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


_SPACES = r"[\x20\x09-\x0D]"
_LEDGER_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
), w AS (
  SELECT doc_id, rid, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM t
), win AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), named AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM win
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM named) WHERE n >= 2
), covered AS (
  SELECT rid, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS o(d) GROUP BY rid
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '{_SPACES}+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}')))::BIGINT AS n_letter_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '^[^\\p{{Ll}}]*\\p{{Lu}}[^\\p{{Ll}}]*$')))::BIGINT AS n_capital_words
  FROM w LEFT JOIN covered ON covered.rid = w.rid
), f AS (
  SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(quality.RULES.values()))})::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letter_words, n_capital_words, failed,
       (failed & {quality.mask_of(quality.BASE)}) <> 0 AS base_failed,
       (failed & {quality.mask_of(quality.POLICIES["full-1"])}) = 0 AS kept
FROM f
"""


@query("op9_quality_ledger", _LEDGER_SQL)
def op9_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "full-1")
    base = F.col("failed").bitwiseAND(F.lit(quality.mask_of(quality.BASE))) != 0
    return rows.select("doc_id", *quality.MEASURES, "failed", base.alias("base_failed"), "kept")


@query("op10_mix")
def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"))


@query("op11_pack")
def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.crc32("ids").alias("ids_crc32")
    return packing.pack(table(spark, sf_dir, "documents"), columns=[digest])


@query("op12_align")
def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


_REPAIR_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::UBIGINT AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), hashed AS (
  SELECT raw.*, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(key) + 1), lambda p: ord(key[p])::UBIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 20 AS h FROM raw, tab
), harmed AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE h <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM harmed
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM numbered
), turns AS (
  SELECT *, NOT blank AND nth > 1 AS double, NOT blank AND nth = 1 AND cut AS truncated FROM seen
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (double) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM turns GROUP BY conv_id
), path AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM counts
  UNION ALL
  SELECT conv_id, i, q, min(best) FROM (
    SELECT o.conv_id, o.i + 1 AS i, e.q AS q, {'cost': o.cost + e.cost, 'audit': o.audit || e.letter, 'lines': o.lines || e.lines} AS best
    FROM (
      SELECT conv_id, i, q, best.cost AS cost, best.audit AS audit, best.lines AS lines FROM path
      UNION ALL
      SELECT conv_id, i, CASE WHEN q = 2 THEN 3 ELSE 2 END, best.cost + 3, best.audit || 'I', best.lines || [CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END] FROM path
    ) AS o
    JOIN turns t ON t.conv_id IS NOT DISTINCT FROM o.conv_id AND t.i = o.i + 1,
    LATERAL (
      SELECT 'D' AS letter, 4 AS cost, o.q AS q, []::VARCHAR[] AS lines
      UNION ALL SELECT 'R', 3 + 3 * t.truncated::INTEGER, CASE WHEN o.q = 2 THEN 3 ELSE 2 END, [CASE WHEN o.q = 2 THEN 'assistant:' ELSE 'user:' END || t.text]
        WHERE NOT t.blank AND NOT t.double
      UNION ALL SELECT 'K', 3 * t.truncated::INTEGER, CASE left(t.role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, [t.role || ':' || t.text]
        WHERE NOT t.blank AND NOT t.double AND (left(t.role, 1) = 's' AND o.q = 0 OR left(t.role, 1) = 'u' AND o.q <> 2 OR left(t.role, 1) = 'a' AND o.q = 2)
    ) AS e
  ) GROUP BY conv_id, i, q
), ends AS (
  SELECT path.conv_id, {
    'cost': best.cost + CASE q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'audit': best.audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'lines': best.lines || CASE q WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE []::VARCHAR[] END} AS best
  FROM path JOIN counts ON counts.conv_id IS NOT DISTINCT FROM path.conv_id AND counts.n = path.i
), chosen AS (
  SELECT conv_id, min(best) AS best FROM ends GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN chosen ON chosen.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@query("op13_repair", _REPAIR_SQL)
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
