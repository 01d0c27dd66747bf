"""Op 8 on planted repeats: nothing of a passage stays, in any script; short repeated lines go, own text stays."""

import random

from folioflow.llm import substrings


def made(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_no_word_of_a_passage_stays(make, spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9))) for _ in range(3000)]
    rows, wanted = [], {}
    for n in range(150):
        passage = made(rng, rng.choice([8, 9, 12, 20, 50, 55]), words)
        if n % 3 == 0:
            passage = passage.replace(" ", ". ", 1)
        for copy in (0, 1):
            head, tail = made(rng, rng.randint(1, 60), words), made(rng, rng.randint(1, 60), words)
            rows.append((2 * n + copy, f"{head} {passage} {tail}"))
            wanted[2 * n + copy] = f"{head} {tail}" if copy else rows[-1][1]
    got = {r["doc_id"]: r["text"] for r in substrings.dedup(make(rows).repartition(5)).collect()}
    assert {i: t.split() for i, t in got.items()} == {i: t.split() for i, t in wanted.items()}


def test_blocks_and_buckets_do_not_matter(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def spans():
        return sorted((r["doc_id"], str(r["removed"])) for r in substrings.dedup(docs.repartition(7)).collect())

    want = spans()
    monkeypatch.setattr(substrings, "BLOCK_WORDS", 1000)
    monkeypatch.setattr(substrings, "BUCKET_CHARS", 20_000)
    assert spans() == want and any(s != "[]" for _, s in want)


def test_scripts_without_spaces(make):
    rng = random.Random(6)
    own = [["".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(80)) for _ in range(2)] for _ in range(3)]
    shared = "".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(500))
    thai = "".join(chr(rng.randint(0x0E01, 0x0E2E)) for _ in range(60))
    rows = [(i, f"{a}\n{shared}\n{b}{thai}{a[::-1]}") for i, (a, b) in enumerate(own)]
    got = {r["doc_id"]: r["text"] for r in substrings.dedup(make(rows)).collect()}
    assert got[0] == rows[0][1]
    for i in (1, 2):
        assert got[i] == f"{own[i][0]}\n{own[i][1]}{own[i][0][::-1]}"


def test_short_lines_that_repeat(make):
    rows = [(1, "First own text.\nRead more here\nEnd a."), (2, "Second own text!\nRead more here\n续集请看\nEnd b."), (3, "Third\n续集请看\nRead more  HERE\nok\nEnd c."), (4, "Fourth\nok\nEnd d.")]
    got = {r["doc_id"]: r["text"] for r in substrings.dedup(make(rows)).collect()}
    assert got == {1: rows[0][1], 2: "Second own text!\n续集请看\nEnd b.", 3: "Third\nok\nEnd c.", 4: rows[3][1]}
