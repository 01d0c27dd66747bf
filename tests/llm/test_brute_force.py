"""Registered queries of the small tables against plain Python forms, exact where the contract is exact."""

import zlib
from collections import Counter, defaultdict

import brute
import oracle
import pytest

from folioflow.llm import catalog, language, licenses, page_samples, pages, simhash

Q = catalog.queries()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().to_dict("records")


def rows(spark, sf_dir, name):
    return [r.asDict(recursive=True) for r in Q[name](spark, sf_dir).collect()]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in Q) == list(range(1, 11))


def test_sql(spark, sf_dir):
    con = oracle.connect(sf_dir)
    for name, sql in catalog.oracle_sql().items():
        error, n = oracle.check(spark, con, name, Q[name], sql, sf_dir)
        assert error is None and n > 0


def test_license_scan(spark, sf_dir, docs):
    import re

    def grams(text):
        ws = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
        return [tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))] if ws else []

    want = set()
    for d in docs:
        mine = set(grams(d["text"]))
        for name, text in licenses.TEMPLATES.items():
            t = set(grams(text))
            # A short notice is found whole or, for a containment of 0.8, nearly whole.
            if len(t & mine) == len(t):
                want.add((d["doc_id"], name))
    got = {(r["doc_id"], r["license"]) for r in rows(spark, sf_dir, "op1_license_scan")}
    assert want <= got and want
    assert all(r["containment"] >= 0.8 for r in rows(spark, sf_dir, "op1_license_scan"))


def test_shards(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op2_kd_shards")
    text = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    assert all(r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in got)
    sums, slots = Counter(), defaultdict(list)
    for r in got:
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    mean, largest = sum(sums.values()) / 24, max(r["size"] for r in got)
    assert max(sums.values()) <= mean + largest


def test_decontaminate(spark, sf_dir, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = brute.benchmark_windows(items)
    want = {d["doc_id"]: brute.hits(d["text"], windows) for d in docs}
    got = rows(spark, sf_dir, "op3_decontaminate")
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got} == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got) and any(r["contaminated"] for r in got)


def test_simhash(spark, sf_dir, docs):
    prints = [brute.fingerprint(d["text"]) for d in docs]
    least = brute.smallest_reachable([d["doc_id"] for d in docs], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    want = {(d["doc_id"], f"{p:016x}", c) for d, p, c in zip(docs, prints, least)}
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(spark, sf_dir, "op4_simhash")} == want


def test_links_of_close_fingerprints(spark):
    import random

    rng, values = random.Random(3), set()
    for _ in range(60):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(6):
            flipped = base
            for b in rng.sample(range(64), rng.randint(1, 4)):
                flipped ^= 1 << b
            values.add(flipped)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for bits in (0, 1, 2, 3):
        got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits).collect()}
        want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
        assert got == want


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(1, 300)] + [(1000, 1001), (1000, 2000), (5, 5000)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 301)) and got[5000] == 1 and got[2000] == got[1001] == 1000


def test_page_text(spark, sf_dir):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = rows(spark, sf_dir, "op5_page_text")
    assert sorted(r["page_id"] for r in got) == sorted(html)
    for r in got:
        want = "\n".join(b.text for b in pages.leaf_blocks(html[r["page_id"]]) if any(tag == "article" for tag, _ in b.path))
        assert r["text"] == want and r["n_chars"] == len(want)


def test_page_chain_on_unseen_layouts():
    chain, right, made, meant = pages.default_chain(), 0, 0, 0
    for page, text in page_samples.labelled_pages(200, seed=99):
        blocks = pages.leaf_blocks(page)
        want, got = pages.labels_of(blocks, text), chain.decode(pages.features(blocks))
        right += sum(w & g for w, g in zip(want, got))
        made, meant = made + sum(got), meant + sum(want)
    assert right / made > 0.97 and right / meant > 0.97


def test_viterbi_is_the_best_path():
    import itertools
    import random

    rng = random.Random(1)
    chain = pages.Chain({f: rng.uniform(-2, 2) for f in "abcdef"}, [[rng.uniform(-1, 1) for _ in "01"] for _ in "01"], [0.3, -0.2])
    for _ in range(50):
        rows_ = [rng.sample("abcdef", 2) for _ in range(rng.randint(1, 7))]

        def score(labels):
            total = chain.start[labels[0]] + sum(chain.transitions[a][b] for a, b in zip(labels, labels[1:]))
            return total + sum(sum(chain.weights[f] for f in row) for row, label in zip(rows_, labels) if label)

        best = max(score(p) for p in itertools.product((0, 1), repeat=len(rows_)))
        assert abs(score(chain.decode(rows_)) - best) < 1e-9


def test_line_dedup(spark, sf_dir, docs):
    want = brute.repeated_lines([(d["doc_id"], d["text"]) for d in docs])
    got = rows(spark, sf_dir, "op6_line_dedup")
    assert {r["doc_id"]: [int(n) for n in r["removed_lines"].split(",")] for r in got if r["n_removed"]} == want and want


def test_language(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op7_language")
    lang = {d["doc_id"]: d["lang"] for d in docs}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held) and len(got) == len(docs)


def test_language_mixture(spark, docs):
    import pandas as pd

    train = spark.createDataFrame(pd.DataFrame([{"lang": d["lang"], "text": d["text"]} for d in docs if d["text"]]))
    langs, model = language.train(train)
    long = {l: max((d["text"] for d in docs if d["lang"] == l), key=len)[:3000] for l in langs[:2]}
    import numpy as np

    both = np.frombuffer("\n".join(long.values()).encode(), dtype=np.uint8)
    found = language.proportions(model, both)
    assert set(found) == {0, 1} and 0.3 < found[0] < 0.7


def test_unit_dedup_removes_long_repeats(spark, sf_dir, docs):
    """Most words of repeated 50-word passages go from later documents, first occurrences stay."""
    got = {r["doc_id"]: r for r in rows(spark, sf_dir, "op8_unit_dedup")}
    seen, covered, left = set(), 0, 0
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ws = (d["text"] or "").lower().split()
        kept = Counter((got[d["doc_id"]]["text"] or "").lower().split())
        inside = set()
        for i in range(len(ws) - 49):
            window = tuple(ws[i : i + 50])
            if window in seen:
                inside.update(range(i, i + 50))
        seen.update(tuple(ws[i : i + 50]) for i in range(len(ws) - 49))
        rare = [ws[i] for i in inside if len(ws[i]) > 9]
        covered += len(rare)
        left += sum(1 for w in rare if kept[w])
    assert covered > 100 and left < 0.25 * covered


def test_mix(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in rows(spark, sf_dir, "op10_mix")}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for d in docs:
        n = len(brute.space_words(d["text"]))
        r = got[d["doc_id"]]
        assert r["size"] == n and r["taken"] <= 3 * n
        sizes[d["source"]] += n
        taken[d["source"]] += r["taken"]
        largest[d["source"]] = max(largest[d["source"]], n)
    want = brute.targets(sizes)
    for d in docs:
        r = got[d["doc_id"]]
        assert abs(r["target"] - want[d["source"]]) < 1e-6 * (1 + want[d["source"]]) and r["source_size"] == sizes[d["source"]]
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values())
