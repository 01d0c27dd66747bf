"""State that leaves, rows out of order, stale answers, the job table, errors of any shape."""

import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioflow.functions import text as TX
from folioflow.operators import windows as W
from folioflow.sources import writers as WR
from folioflow.streaming import ordered as O
from folioflow.streaming import streams as ST

PATCH = "job_id int, ts timestamp, seq long, status string"
# Event time starts here: a stream's first watermark is the epoch, and rows at it count as late.
T0 = 1_600_000_000


def micro_batches(spark, path, batches, schema):
    """A stream that takes the given lists of rows one after the other; times are seconds."""
    for rows in batches:
        names = [f.strip().split() for f in schema.split(",")]
        plain = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if t == 'timestamp' else t}" for n, t in names))
        plain = plain.select(*[F.timestamp_seconds(F.col(n) + T0).alias(n) if t == "timestamp" else F.col(n) for n, t in names])
        plain.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)


def run(stream, tmp_path, name, mode="append"):
    """(rows, number of state rows after the last micro-batch)."""
    rows, path = [], f"{tmp_path}/{name}-checkpoint"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", path).foreachBatch(lambda b, n: rows.extend(b.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [s["numRowsTotal"] for s in query.lastProgress["stateOperators"]]
    return rows, sum(states)


HOUR = 3600


def test_jobs_leave_the_state(spark, tmp_path):
    """Ended and quiet jobs: the timer sends what is lost and clears the state."""
    ST.use_rocksdb(spark)
    first = [(1, 0, 1, "running"), (2, 10, 2, "queued"), (3, 20, 3, "running")]
    second = [(1, 30 * HOUR, 4, "running"), (3, 2 * HOUR, 5, "done")]
    end = [(-1, 900 * HOUR, 6, "done")]
    stream = micro_batches(spark, f"{tmp_path}/a", [first, second, end], PATCH)
    rows, left = run(O.stream_recover_by_timer(stream, stale_ms=24 * HOUR * 1000, delay="1 minute"), tmp_path, "a")
    assert sorted((r.job_id, r.updated_at.timestamp() - T0) for r in rows if r.job_id > 0) == [(1, 0), (1, 30 * HOUR), (2, 10)]
    # Only the row that moved the watermark is still held: its key's value and its map entry.
    assert left <= 3
    stream = micro_batches(spark, f"{tmp_path}/b", [first, second, [(1, 31 * HOUR, 7, "error"), (3, 40 * HOUR, 8, "error")], end], PATCH)
    rows, left = run(O.stream_transitions_expiring(stream, forget_ms=24 * HOUR * 1000, delay="1 minute"), tmp_path, "b")
    assert sorted((r.job_id, r.seq, r.status) for r in rows if r.job_id > 0) == [(1, 7, "error"), (3, 5, "done"), (3, 8, "error")]
    assert left <= 3


# Stateful processors are unpickled by a process that does not see test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Joined(O.Rule):
    """Everything a key has had so far, as one text."""

    def step(self, state, row):
        state = (state or "") + str(row["seq"]) + ","
        return state, [(row["job_id"], state)]


def test_rows_out_of_order_are_released_in_order(spark, tmp_path):
    ST.use_rocksdb(spark)
    rng = random.Random(2)
    rows = [(j, t, 1000 * j + t, "running") for j in range(3) for t in range(60)]
    rows.sort(key=lambda r: r[1] + rng.random() * 9)
    batches = [rows[i : i + 23] for i in range(0, len(rows), 23)] + [[(-1, 10_000, 0, "x")]]
    stream = micro_batches(spark, f"{tmp_path}/in", batches, PATCH)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("job_id", T.IntegerType()), T.StructField("so_far", T.StringType())])
    got, _ = run(O.in_order(stream, ["job_id"], "ts", ["seq"], Joined(), schema, delay="20 seconds"), tmp_path, "in")
    for j in range(3):
        longest = max((r.so_far for r in got if r.job_id == j), key=len)
        assert longest == "".join(f"{1000 * j + t}," for t in range(60))
        assert sum(r.job_id == j for r in got) == 60


def test_a_key_with_several_chunks_in_a_micro_batch(spark, tmp_path):
    """Rows of a key beyond one Arrow chunk wait in the state store and are folded in order."""
    from folioflow.operators.folds import RecentHash

    ST.use_rocksdb(spark)
    rng = random.Random(6)
    rows = [(1 + i % 2, i, i, "x") for i in range(120)]
    rng.shuffle(rows)
    stream = micro_batches(spark, f"{tmp_path}/c", [rows[:90], [(1, 200, 200, "x"), (2, 201, 201, "x")]], PATCH)
    stream = stream.withColumn("_hash", F.col("seq") * 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    spark.conf.set("spark.sql.execution.arrow.transformWithStateInPandas.maxStateRowsPerBatch", "10")
    try:
        got, left = run(ST.stream_fold(stream, ["job_id"], ["seq"], RecentHash(0)), tmp_path, "c")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.execution.arrow.transformWithStateInPandas.maxStateRowsPerBatch")
    assert len(got) == 92 and left == 2
    for job in (1, 2):
        first = min(r[2] for r in rows[:90] if r[0] == job)
        assert [r.seq for r in got if r.job_id == job and r.keep] == [first]


def test_stale_answers(spark, tmp_path):
    ST.use_rocksdb(spark)
    requests = [(1, 0, 1), (1, 100, 2), (2, 5, 3), (1, 100, 4), (3, 50, 5)]
    answers = [(1, 1, 0, 90), (1, 2, 100, 110), (2, 3, 5, 400), (1, 4, 100, 500), (3, 5, 50, 50)]
    want = {(1, 1), (2, 3), (1, 4), (3, 5)}
    ask, give = "job_id int, ts timestamp, seq long", "job_id int, seq long, asked_at timestamp, ts timestamp"
    asked = micro_batches(spark, f"{tmp_path}/q", [requests[:2], requests[2:], [(-1, 9_000, 0)]], ask)
    given = micro_batches(spark, f"{tmp_path}/r", [answers[3:], answers[:3], [(-1, 0, 9_000, 9_000)]], give)
    rows, _ = run(O.stream_answers(asked, given, ["job_id"], tie="seq", delay="10 minutes", patience="20 minutes"), tmp_path, "q")
    assert {(r.job_id, r.seq) for r in rows if r.job_id > 0} == want
    batch = W.current_answers(spark.read.parquet(f"{tmp_path}/q"), spark.read.parquet(f"{tmp_path}/r"), ["job_id"], tie="seq")
    assert {(r.job_id, r.seq) for r in batch.collect() if r.job_id > 0} == want
    short = W.current_answers(spark.read.parquet(f"{tmp_path}/q"), spark.read.parquet(f"{tmp_path}/r"), ["job_id"], tie="seq", patience=F.expr("interval 2 minutes"))
    assert {(r.job_id, r.seq) for r in short.collect() if r.job_id > 0} == {(1, 1), (3, 5)}


def jobs_df(spark, rows):
    return spark.createDataFrame(rows, "job_id long, status string, seq long")


def table(spark, path):
    return {r.job_id: (r.status, r.seq) for r in spark.read.parquet(path).collect()}


def test_writing_one_job_leaves_the_others(spark, tmp_path):
    path = f"{tmp_path}/jobs"
    WR.write_jobs(jobs_df(spark, [(i, "running", 1) for i in range(100)]), path)
    WR.write_jobs(jobs_df(spark, [(7, "done", 2), (7, "running", 1), (200, "queued", 1)]), path, order=["seq"])
    got = table(spark, path)
    assert len(got) == 101 and got[7] == ("done", 2) and got[200] == ("queued", 1) and got[8] == ("running", 1)
    assert spark.read.parquet(path).count() == 101


def test_replayed_batches_change_nothing(spark, tmp_path):
    path = f"{tmp_path}/jobs"
    sink = WR.upsert_batches(path, buckets=4, files=2)
    batches = [[(i, f"a{i}", 0) for i in range(20)], [(i, f"b{i}", 1) for i in range(5, 10)], [(i, f"c{i}", 2) for i in (5, 30)]]
    for number, rows in enumerate(batches):
        sink(jobs_df(spark, rows), number)
    once = table(spark, path)
    assert once[5] == ("c5", 2) and once[6] == ("b6", 1) and once[30] == ("c30", 2) and len(once) == 21
    for number in (2, 0, 1):
        sink(jobs_df(spark, batches[number]), number)
        assert table(spark, path) == once
    sink(jobs_df(spark, []), 3)
    assert table(spark, path) == once


def shown(value, inside=False):
    """Text of a parsed JSON value the way a template shows it."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return ",".join(shown(v, True) for v in value)
    return "[object Object]" if isinstance(value, dict) else str(value)


def friendly(text):
    general = "An error occurred while handling the request."
    try:
        detail = json.loads(text) if text is not None else None
    except ValueError:
        detail = text
    if not detail and detail != [] and detail != {}:
        return general
    if isinstance(detail, list):
        places = " ".join(".".join(shown(x) for x in i["loc"]) if isinstance(i, dict) and isinstance(i.get("loc"), list) else "" for i in detail)
        if "options.detect.roi" in places:
            return "ROI coordinates are required. Open a preview in step 3 and drag the score area."
        said = [i if isinstance(i, str) else i["msg"] if isinstance(i, dict) and isinstance(i.get("msg"), str) else shown(i) if i or isinstance(i, (list, dict)) else "" for i in detail]
        return " / ".join(s for s in said if s) or general
    if isinstance(detail, dict):
        inner = next((detail[k] for k in ("detail", "message") if isinstance(detail.get(k), str)), "")
        return inner or general
    return shown(detail)


ODD_DETAILS = [
    None, "", "null", "0", "false", "true", "5", "1.5", '""', '"odd text"', "not json", "{", "[]", "{}", "[[]]", '["a", "b"]', '[{"msg": "m"}, {"msg": 3}, {"loc": ["x"]}]',
    '[{"loc": ["body", "options.detect.roi"]}]', '[{"loc": ["options", "detect", "roi", 0], "msg": "z"}]', '[{"loc": "options.detect.roi"}]', '[null, false, 0, "", true, 2]',
    '[[1, [2, null, [3, "x"]], {"a": 1}], "end"]', '{"detail": "inner"}', '{"detail": "", "message": "m"}', '{"detail": 3, "message": "m"}', '{"detail": ["x"]}', '{"message": null}',
    '["줄 하나", {"msg": "Ä"}]',
]


def test_structured_errors_of_any_shape(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_DETAILS)], "i int, detail string")
    got = {r.i: r.v for r in rows.select("i", TX.structured_error(F.col("detail")).alias("v")).collect()}
    for i, text in enumerate(ODD_DETAILS):
        assert got[i] == friendly(text), (text, got[i])


@pytest.mark.parametrize("locale, text", [("en", "Enter a YouTube URL."), ("ko", "유튜브 주소를 입력합니다.")])
def test_structured_errors_use_the_known_texts(spark, locale, text):
    detail = F.lit(json.dumps({"detail": "youtube_url is required when source_type is youtube"}))
    assert spark.range(1).select(TX.structured_error(detail, locale).alias("v")).first().v == text


class FakeState:
    """A value and map state held in memory."""

    def __init__(self):
        self.map, self.value = {}, None

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        self.map[key] = value

    def getValue(self, key):
        return self.map[key]

    def keys(self):
        return list(self.map)

    def removeKey(self, key):
        del self.map[key]


def test_chunks_of_a_micro_batch_are_folded_in_order():
    import pandas as pd

    from folioflow.operators.folds import RecentHash

    rows = [(1, s, s // 4) for s in random.Random(1).sample(range(40), 40)]
    columns = ["job_id", "seq", "_hash"]
    whole = [[pd.DataFrame(rows, columns=["job_id", "seq", "_2"])], [pd.DataFrame(rows[i : i + 7], columns=["job_id", "seq", "_2"]) for i in range(0, 40, 7)]]
    out = []
    for chunks in whole:
        processor, state = ST._FoldProcessor(RecentHash(0), ["seq"], "seq bigint", columns, ["job_id", "seq"]), FakeState()
        processor.init(state)
        out.append(pd.concat(processor.handleInputRows((1,), iter(chunks), None)).values.tolist())
        assert not state.map
    assert out[0] == out[1] and [r[1] for r in out[0]] == list(range(40)) and 0 < sum(r[2] for r in out[0]) < 40
