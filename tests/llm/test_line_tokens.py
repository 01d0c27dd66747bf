"""Tokens and prefix keys of lines: blanks of every kind, and keys that sort as plain longs."""

from pyspark.sql import functions as F

from folioflow.llm import lines as L
from folioflow.llm.common import words


def test_words_of_a_line_with_any_white_space(spark):
    texts = ["a b c", "  a  b ", "a\tb", "a \x0b b\x0cc", "a\r", " a b　c", "a", "a b c d e f g", "\t a\t\tb c d  e f"]
    rows = spark.createDataFrame([(t,) for t in texts], "line string").repartition(2)
    for r in rows.select("line", L.line_words(F.col("line")).alias("got"), words(F.col("line")).alias("want")).collect():
        assert r.got == r.want


def test_keys_are_never_null_and_keep_their_order(spark, tmp_path):
    spark.createDataFrame([([5, 4097, 2],), ([1],)], "tokens array<bigint>").write.parquet(f"{tmp_path}/tokens")
    tokens = spark.read.parquet(f"{tmp_path}/tokens")
    classes = [0] * L.SKETCH_BUCKETS
    classes[2] = 3
    for table, want in ((classes, [2 | 3 << 48, 4097, 5]), ([0] * L.SKETCH_BUCKETS, [2, 4097, 5])):
        keys = tokens.select(L.rarity_keys(F.col("tokens"), table).alias("keys"))
        # A type that allows nulls makes Spark sort boxed values.
        assert not keys.schema["keys"].dataType.containsNull
        assert sorted(want) in [sorted(r.keys) for r in keys.collect()]


def test_tokens_are_sorted_as_plain_longs(spark):
    lines = spark.createDataFrame([(1, 1, " ".join(f"w{i % 40}" for i in range(120))), (2, 1, "a b"), (3, 1, "z y x w v u t s")], "id bigint, at bigint, line string")
    tokens = L.with_tokens(lines)
    assert not tokens.schema["tokens"].dataType.containsNull
    got = {r.id: r.tokens for r in tokens.collect()}
    assert {k: len(v) for k, v in got.items()} == {1: 40, 2: 1, 3: 4}
    assert all(v == sorted(set(v)) for v in got.values())


def test_a_prefix_holds_the_rarest_tokens_in_order(spark, tmp_path):
    """With no, few and many classes of frequent tokens: lines whose first tokens are all rare take a way of their own."""
    width = L.SKETCH_BUCKETS
    lists = [sorted({(i * 7919 + k * k * 104729) % (1 << 40) for k in range(1, 3 + i * 4)}) for i in range(12)]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(lists)], "id bigint, at bigint, tokens array<bigint>").write.parquet(f"{tmp_path}/tokens")
    tokens = spark.read.parquet(f"{tmp_path}/tokens")
    for frequent in (0, 1, L.FEW_BUCKETS, width // 2):
        classes = [0] * width
        for i, t in enumerate([t for ts in lists for t in ts][:: 5][:frequent]):
            classes[t % width] = 1 + i % 3
        want = set()
        for i, ts in enumerate(lists):
            keys = sorted(classes[t % width] << 48 | t for t in ts)
            size = len(ts) - -(-len(ts) * 4 // 5) + 1
            want |= {(i, 0, len(ts), pos, key) for pos, key in enumerate(keys[:size])}
        assert {tuple(r) for r in L.prefixes(tokens, classes).collect()} == want


def test_copies_are_all_but_the_earliest(spark, tmp_path):
    rows = [(2, 5, "same"), (1, 9, "same"), (1, 4, "same"), (3, 1, "once"), (4, 1, "other"), (4, 0, "other"), (4, 0, "other")]
    spark.createDataFrame(rows, "id bigint, at bigint, line string").write.parquet(f"{tmp_path}/lines")
    assert sorted(map(tuple, L._copies(spark.read.parquet(f"{tmp_path}/lines")).collect())) == [(1, 9), (2, 5), (4, 1)]
