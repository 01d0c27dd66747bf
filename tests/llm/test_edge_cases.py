"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from collections import Counter

import pytest
from conftest import ODD
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, language, licenses, lines, mixing, pages, quality, sharding, simhash, substrings


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, "word word word word word word word word word word word"), (2, None), (3, "..."), (None, "two words"), (4, "Two words")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def none(spark, make):
    return make([(1, "x", "s")]).limit(0)


def key(r):
    return (r["doc_id"] is None, r["doc_id"])


def test_licenses(odd, make, none):
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
    docs = make([(1, "x " * 500 + "Released under the MIT License. " + "y " * 30, "s"), (1, "x " * 500 + "Released under the MIT License. " + "y " * 30, "s"), (None, "released UNDER the mit  license", "s")])
    got = {(r["doc_id"], r["license"], r["containment"]) for r in licenses.scan(docs).collect()}
    assert got == {(1, "mit-notice", 1.0), (None, "mit-notice", 1.0)}
    assert licenses.scan(docs, {}).count() == 0


def test_sharding(odd, none):
    rows = sharding.shard_table(odd, shards=4).collect()
    assert len(rows) == len(ODD) and {r["shard"] for r in rows} <= set(range(4))
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert sharding.shard_table(none, shards=4).count() == 0
    out = sharding.shard(odd, shards=4)
    assert "in_shard" in out.columns and out.filter("in_shard = 'mine-shard'").count() == len(ODD)
    assert sharding.shard(odd, target_bytes=100_000).select("shard").distinct().count() >= 2


def test_decontaminate(odd, bench, none, spark):
    rows = sorted(decontaminate.report(odd, bench).collect(), key=key)
    assert len(rows) == len(ODD)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[7]["n_hit"] == 60_000 and by_id[7]["n_items"] == 1 and by_id[1]["n_words"] == 0
    assert any(r["doc_id"] is None and r["n_hit"] == 2 and r["n_items"] == 1 for r in rows)
    assert decontaminate.report(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.report(odd, bench.limit(0)).collect())
    assert decontaminate.clean_documents(odd, bench).columns == odd.columns
    small = decontaminate.report(odd, bench, block_chars=5).collect()
    assert Counter(map(tuple, small)) == Counter(map(tuple, rows))
    cut = {r["doc_id"]: r["text"] for r in decontaminate.without_spans(odd, bench).collect()}
    assert cut[7] == " " and cut[6] == ODD[8][1]


def test_simhash(odd, none):
    rows = simhash.report(odd).collect()
    assert len(rows) == len(ODD)
    one = {r["doc_id"]: r["component_id"] for r in rows}
    assert one[4] == one[5] == one[9] == 4 and one[1] == one[2] == one[3] == 1
    assert simhash.report(none).count() == 0 and simhash.keep_one(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 4, 6, 7, 8, None, None])


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<script>x"), (4, "u", "<p>a &amp;\n b<br>c"), (4, "u", "<p>a &amp;\n b<br>c"), (5, "u", "<!-- <p>x</p>"), (6, "u", "<p>" + "long " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("n_chars", F.lit(-1))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in pages.extract(df).collect())
    assert got[:4] == [(1, "", 0), (2, "", 0), (3, "", 0), (4, "a & b c", 7)] and got[4] == got[3] and got[5] == (5, "", 0)
    assert got[6][2] == 50_000 * 5 - 1 and pages.extract(df.limit(0)).count() == 0


def test_lines(odd, none):
    got = lines.dedup(odd).collect()
    assert len(got) == len(ODD) and lines.dedup(none).count() == 0
    rows = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert rows[1]["text"] is None and rows[1]["n_lines"] == 0
    assert rows[5]["removed_lines"] == [0] and rows[9]["removed_lines"] == [0] and rows[4]["removed_lines"] == []
    assert rows[8]["removed_lines"] == list(range(1, 500)) and rows[7]["n_removed"] == 0


def test_language(odd, none):
    rows = language.identify(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r["lang_pred"] == ("und" if not r["doc_id"] or r["doc_id"] in (1, 2, 3) and True else "en") or r["doc_id"] is None for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows) and language.identify(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}


def test_substrings(odd, make, none):
    got = substrings.dedup(odd).collect()
    assert len(got) == len(ODD) and substrings.dedup(none).count() == 0
    rows = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert rows[1]["text"] is None and rows[9]["n_removed"] == 0 and rows[8]["n_removed"] > 0
    passage = "This is a sentence that is shared by two texts. And here is one more of nine words."
    docs = make([(2, f"Own start here. {passage} Own end.", "s"), (1, f"Other words {passage}", "s"), (3, "Nothing shared at all.", "s")])
    out = {r["doc_id"]: r for r in substrings.dedup(docs).collect()}
    assert out[1]["n_removed"] == 0 and out[3]["n_removed"] == 0
    text = f"Own start here. {passage} Own end."
    assert "one more of nine words" not in out[2]["text"] and out[2]["text"].startswith("Own start here.")
    left, at = [], 0
    for span in out[2]["removed"]:
        left.append(text[at : span["start"]])
        at = span["end"]
    assert "".join([*left, text[at:]]) == out[2]["text"]


def test_quality(odd, none):
    rows = quality.apply_policy(quality.ledger(odd), "full-1")
    assert rows.count() == len(ODD) and "in_failed" in rows.columns and quality.ledger(none).count() == 0
    got = {r["doc_id"]: r for r in rows.collect()}
    assert got[1]["n_words"] == 0 and not got[1]["kept"] and got[7]["n_repeat_words"] == 60_000
    assert quality.keep_good(odd).columns == odd.columns
    table = quality.ablation(quality.ledger(odd), "full-1").collect()
    assert {r["rule"] for r in table} == set(quality.RULES)
    assert all(r["n_failed"] >= r["n_failed_alone"] for r in table)


def test_mixing(odd, none):
    rows = mixing.mix_table(odd).collect()
    assert len(rows) == len(ODD) and mixing.mix_table(none).count() == 0 and mixing.mix(none).count() == 0
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    again = mixing.mix_table(odd.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.mix(odd).columns == odd.columns
