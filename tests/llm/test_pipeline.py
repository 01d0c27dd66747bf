"""The pipeline's stages against what each must do to its own input."""

from collections import Counter

import brute

import corpus_pipeline
from folioflow.llm.common import staged


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, given = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        given.append(staged(stage(spark, given[-1], sf_dir), name))
    rows = [[r.asDict() for r in g.collect()] for g in given]
    assert all(g.columns == columns for g in given[:-1])
    start, good, single, clean, mixed, sharded = rows
    # Quality: exactly the documents that the plain rules keep of the two base rules, and only whole rows.
    assert {r["doc_id"] for r in good} < {r["doc_id"] for r in start}
    assert all(len(brute.space_words(r["text"])) >= 50 for r in good)
    # One document of each group.
    prints = [brute.fingerprint(r["text"]) for r in good]
    least = brute.smallest_reachable([r["doc_id"] for r in good], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert sorted(r["doc_id"] for r in single) == sorted(set(least))
    # No benchmark window stays, clean documents do.
    windows = brute.benchmark_windows([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single if brute.hits(r["text"], windows)[1] == 0}
    # The mix repeats whole documents at most three times and comes near its targets.
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 3
    sizes, taken = Counter(), Counter()
    for r in clean:
        sizes[r["source"]] += len(brute.space_words(r["text"]))
    for r in mixed:
        taken[r["source"]] += len(brute.space_words(r["text"]))
    largest = max(len(brute.space_words(r["text"])) for r in clean)
    assert all(abs(taken[s] - t) <= 2 * largest for s, t in brute.targets(sizes).items())
    assert Counter(r["doc_id"] for r in sharded) == Counter(r["doc_id"] for r in mixed)
    bytes_of = Counter()
    for r in sharded:
        bytes_of[r["shard"]] += len(r["text"].encode()) + 8
    assert max(bytes_of.values()) <= sum(bytes_of.values()) / 24 + max(len(r["text"].encode()) + 8 for r in sharded) * 3


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert "shard" in out.columns and out.count() > 0
