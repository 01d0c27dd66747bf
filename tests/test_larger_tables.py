"""Queries against their SQL, and stream operators, on cases that the small tables do not have."""

import duckdb
import oracle
from pyspark.sql import functions as F

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_names_of_ten_thousand_pages(spark, tmp_path):
    """Page 10,000 has five digits in its name, in the query and in its SQL."""
    one, two = (f"[{', '.join(str(v) for v in vec)}]::FLOAT[]" for vec in ([0.5, -0.5] * 32, [-0.5, 0.5] * 32))
    duckdb.sql(f"COPY (SELECT i AS vec_id, CASE WHEN i % 2 = 0 THEN {one} ELSE {two} END AS embedding, 0 AS label FROM range(10005) t(i)) TO '{tmp_path}/embeddings.parquet'")
    con = oracle.connect(str(tmp_path))
    error, rows = oracle.check(spark, con, "s4_write_pages", QUERIES["s4_write_pages"], SQL["s4_write_pages"], str(tmp_path))
    assert error is None and rows > 10_000
    assert con.execute(f"SELECT count(*) FROM ({SQL['s4_write_pages']}) WHERE name = 'page_10005.png'").fetchone() == (1,)


def progress_of(stream, tmp_path, name, mode):
    """(rows with the number of their micro-batch, number of micro-batches)."""
    rows = []
    sink = lambda batch, number: rows.extend((number, r) for r in batch.collect())
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows, sum(p["numInputRows"] > 0 for p in query.recentProgress)


def test_micro_batches_do_not_grow_with_the_rows(spark, tmp_path, monkeypatch):
    from folioflow.catalog import streams as feeds

    monkeypatch.setattr(feeds, "FEED_ROWS", 50, raising=False)
    monkeypatch.setattr(feeds, "FILE_ROWS", 50, raising=False)
    stream = feeds._feed(spark, spark.range(3000).selectExpr("id", "id % 7 AS k"), "many", ["id"])
    rows, batches = progress_of(stream, tmp_path, "many", "append")
    assert batches == 4 and sorted(r.id for _, r in rows) == list(range(3000))
    ends = [max(r.id for n, r in rows if n == b) for b in range(4)]
    assert all(r.id > ends[n - 1] for n, r in rows if n)


def test_a_job_ends_once_over_micro_batches(spark, tmp_path):
    from folioflow.streaming import streams as ST

    ST.use_rocksdb(spark)
    batches = [
        [(1, 5, 1, "running"), (2, 6, 2, "done"), (2, 4, 3, "error"), (2, 4, 4, "done")],
        [(1, 9, 5, "error"), (2, 1, 6, "done"), (3, 7, 7, "queued")],
        [(1, 10, 8, "done"), (2, 11, 9, "error")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "job_id int, ts int, seq long, status string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("job_id int, ts int, seq long, status string").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    rows, _ = progress_of(ST.stream_transitions(stream), tmp_path, "ends", "update")
    assert sorted((n, *r) for n, r in rows) == [(0, 2, 3, "error"), (1, 1, 5, "error")]


def seen_so_far(spark, tmp_path, name, rows):
    """Rows through a rule that lists what a key has had, with few shuffle partitions."""
    from pyspark.sql import types as T
    from test_streams_and_tables import PATCH, Joined, micro_batches, run

    from folioflow.streaming import ordered as O
    from folioflow.streaming import streams as ST

    ST.use_rocksdb(spark)
    schema = T.StructType([T.StructField("job_id", T.IntegerType()), T.StructField("so_far", T.StringType())])
    stream = micro_batches(spark, f"{tmp_path}/{name}", [rows[:30], rows[30:], [(-1, 10_000, 0, "x")]], PATCH)
    got, _ = run(O.in_order(stream, ["job_id"], "ts", ["seq"], Joined(), schema, delay="100 seconds"), tmp_path, name)
    return {j: max((r.so_far for r in got if r.job_id == j), key=len) for j in {r[0] for r in rows}}


def test_rows_of_equal_order_are_all_kept(spark, tmp_path):
    rows = [(1 + i % 2, i // 4, i // 4, "x") for i in range(60)]
    got = seen_so_far(spark, tmp_path, "equal", rows)
    assert got == {j: "".join(f"{r[2]}," for r in rows if r[0] == j) for j in (1, 2)}


def test_held_rows_beyond_a_packet(spark, tmp_path, monkeypatch):
    from folioflow.streaming import ordered as O

    rows = [(1 + i % 2, 59 - i, 59 - i, "x") for i in range(60)]
    want = {j: "".join(f"{r[2]}," for r in reversed(rows) if r[0] == j) for j in (1, 2)}
    for shared in (False, True):
        monkeypatch.setattr(O, "HELD_BYTES", 500)
        monkeypatch.setattr(O, "BUCKETS", 1)
        monkeypatch.setattr(O.Rule, "shared", shared)
        assert seen_so_far(spark, tmp_path, f"beyond-{shared}", rows) == want


def test_answers_are_compared_with_one_request(spark, tmp_path):
    """No join of both streams; further columns, large numbers and missing keys come through."""
    from test_streams_and_tables import micro_batches

    from folioflow.streaming import ordered as O
    from folioflow.streaming import streams as ST

    ST.use_rocksdb(spark)
    big = 2**53 + 1
    asked = micro_batches(spark, f"{tmp_path}/q", [[(1, 0, big), (1, 100, 2), (None, 7, 3)], [(-1, 9_000, 0)]], "job_id int, ts timestamp, seq long")
    answers = [(1, big, 0, 90, big), (1, 2, 100, 110, None), (1, 4, 50, 200, 1), (None, 8, 0, 30, 5)]
    given = micro_batches(spark, f"{tmp_path}/r", [answers, [(-1, 0, 9_000, 9_000, 0)]], "job_id int, seq long, asked_at timestamp, ts timestamp, size long")
    out = O.stream_answers(asked, given, ["job_id"], tie="seq", delay="10 minutes", patience="20 minutes")
    rows = []
    query = out.writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda b, n: rows.extend(b.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    assert "symmetricHashJoin" not in [s["operatorName"] for s in query.lastProgress["stateOperators"]]
    assert {(r.job_id, r.seq, r["size"]) for r in rows if r.job_id != -1} == {(1, big, big), (1, 2, None), (None, 8, 5)}


def test_roi_text_is_parsed_once(spark):
    """One parse of the text, however often the points are used; odd texts give no region."""
    from folioflow.functions import geometry as G

    texts = {
        " [[1, 2.5],[-3e1,0x4],[5,6],[7,8]] ": None,
        ' [["1", 2.5], ["-3e1", "0x1F"], [" 5 ", 6], [7, 8]] ': [[1.0, 2.5], [-30.0, 31.0], [5.0, 6.0], [7.0, 8.0]],
        "[[1, 2], [3, 4], [5, 6], [7, 8]]": [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0]],
        "[[1, 2], [3, 1e400], [5, 6], [7, 8]]": None,
        "[[1, 2], [3, null], [5, 6], [7, 8]]": None,
        "[[1, 2], null, [5, 6], [7, 8]]": None,
        "[[1, 2], [3, 4, 5], [5, 6], [7, 8]]": None,
        "[[1, 2], [3, 4], [5, 6]]": None,
        "[]": None,
        "no json": None,
        None: None,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    out = rows.select("t", G.parse_roi(F.col("t")).alias("p"))
    used = out.select("t", "p", F.size("p"), F.col("p")[3][0] + F.col("p")[3][1])
    assert {r.t: r.p for r in used.collect()} == texts
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
