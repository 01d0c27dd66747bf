"""Packing, tokenizer alignment and conversation repair against plain forms."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from folioflow.llm import alignment, conversations, packing
from folioflow.llm.common import table
from folioflow.llm.vocabularies import BYTE_BPE, PIECE_BPE, default_path

LONG = "one two three four five six seven eight nine ten " * 3_000
TEXTS = ["", None, " ", "a", "Hello world.", "Hello world.", "<|endoftext|> and </s>", "Äpfel 中文 \U0001f600\tend\r\n\n  x", "▁ odd", "a" * 5_000, LONG, LONG + "!", "it's 12 o'clock", "\x00\x01 control"]


def plain_tokenizer():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(default_path(BYTE_BPE))
    own.encode_special_tokens = True
    return own


@pytest.fixture(scope="module")
def texts(make):
    rows = [(i if i != 3 else None, t, "s") for i, t in enumerate(TEXTS)] + [(4, "Hello world.", "s")] * 300
    return make(rows, [("ids", "mine"), ("uid", 1), ("length", 2), ("pairs", 3), ("copies", 4)])


def test_ids_equal_the_tokenizers_library(spark, sf_dir):
    from folioflow.llm.vocabularies import byte_encoder

    own, fast = plain_tokenizer(), byte_encoder(default_path(BYTE_BPE))
    rng = random.Random(5)
    pool = [chr(c) for c in range(0x3000) if chr(c).isprintable() or chr(c).isspace()] + list(" \t\n'sdtlmrve0123abcXYZ!?.<|endoftext|>") * 60
    samples = [t for t in TEXTS if t] + ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(3_000)]
    samples += [r.text for r in table(spark, sf_dir, "documents").select("text").limit(200).collect() if r.text]
    for text, want in zip(samples, own.encode_batch(samples, add_special_tokens=False)):
        assert fast(text) == want.ids, text[:80]


def check_packing(rows, want_ids, capacity):
    """Whole pieces by the rule, every place used once and without gaps."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, want in want_ids.items():
        found = sorted(by_doc.pop(doc), key=lambda r: (r.piece, r.sequence_id))
        copies = len(found) // max(1, -(-len(want) // capacity))
        assert len(found) == copies * -(-len(want) // capacity)
        for r in found:
            assert r.start == (0 if not r.piece else (len(want) % capacity or capacity) + (r.piece - 1) * capacity)
            part = want[r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        assert sum(r.length for r in found) == copies * len(want)
    assert not by_doc
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing_against_the_rule(spark, texts):
    from pyspark.sql import functions as F

    own = plain_tokenizer()
    rows = packing.pack(texts, columns=[F.crc32("ids").alias("ids_crc32")]).collect()
    want = {(i if i != 3 else None): [*own.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(TEXTS)}
    bins = check_packing(rows, want, 1024)
    assert len(rows) - sum(-(-len(w) // 1024) for w in want.values()) == 300
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 1024) + 1


def test_packed_ids_come_back_whole(spark, texts):
    packed = packing.pack(texts, capacity=64)
    spots = {(r.sequence_id, r.offset): r for r in packed.collect()}
    for s in packing.sequences(packed).collect():
        assert len(s.ids) == 4 * s.length <= 256
        for (sequence, offset), r in spots.items():
            if sequence == s.sequence_id:
                assert bytes(s.ids[4 * offset : 4 * (offset + r.length)]) == bytes(r.ids)


def test_groups_and_rounds(spark):
    """Small groups force several rounds; the number of bins stays near what the sizes allow, and reruns agree."""
    rng = random.Random(7)
    sizes = [rng.randint(1, 1024) for _ in range(6_000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "uid bigint, length int").repartition(8)
    runs = [{r.uid: (r.sequence_id, r.offset) for r in packing.place(items, group_items=300).collect()} for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == len(sizes)
    bins = {}
    for uid, (sequence, offset) in runs[0].items():
        bins.setdefault(sequence, []).append((offset, sizes[uid]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
    least = max(-(-sum(sizes) // 1024), sum(s > 512 for s in sizes))
    assert len(bins) <= 1.03 * least


@pytest.mark.parametrize("capacity", [10, 37])
def test_best_fit_takes_the_fullest_bin(capacity):
    rng = random.Random(capacity)
    sizes = [rng.randint(1, capacity) for _ in range(500)]
    rooms, want = [], []
    for s in sizes:
        fitting = [(room, -b) for b, room in enumerate(rooms) if room >= s]
        least = min(fitting)[0] if fitting else None
        want.append(least)
        if least is None:
            rooms.append(capacity - s)
        else:
            rooms[rooms.index(least)] -= s
    got = packing.best_fit(np.array(sizes), capacity)
    rooms = {}
    for s, b, least in zip(sizes, got.tolist(), want):
        assert rooms.get(b) == least
        rooms[b] = rooms.get(b, capacity) - s
    assert min(rooms.values()) >= 0


def test_packing_of_an_empty_table(texts):
    assert packing.pack(texts.limit(0)).count() == 0


def plain_alignment(rows):
    """Per document by loops over byte offsets."""
    import sentencepiece

    own, pieces = plain_tokenizer(), sentencepiece.SentencePieceProcessor(model_file=default_path(PIECE_BPE))
    letters = {v: k for k, v in {b: c for c, b in __import__("folioflow.llm.vocabularies", fromlist=["x"]).byte_of_letter().items()}.items()}
    out, counts = [], {}
    for doc, text in rows:
        groups, links, n = [], [], (0, 0)
        if text:
            a, b = own.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
            bytes_a = [bytes(letters[c] for c in own.id_to_token(x)) for x in a]
            bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(pieces.id_to_piece, b)]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                n = (len(a), len(b))
                ends_a, ends_b = list(itertools.accumulate(map(len, bytes_a))), list(itertools.accumulate(map(len, bytes_b)))
                at_b = dict(zip(ends_b, range(len(b))))
                i = j = 0
                for k, end in enumerate(ends_a):
                    if end in at_b:
                        groups.append(",".join(map(str, a[i : k + 1])) + "|" + ",".join(map(str, b[j : at_b[end] + 1])))
                        links.append((a[k], b[at_b[end]]))
                        i, j = k + 1, at_b[end] + 1
        for pair in links:
            counts[pair] = counts.get(pair, 0) + 1
        out.append((doc, *n, groups, links))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [
        (doc, n_a, n_b, len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, n_a, n_b, groups, links in out
    ]


def test_alignment_against_loops(spark, texts, sf_dir):
    docs = texts.select("doc_id", "text").unionByName(table(spark, sf_dir, "documents").select("doc_id", "text").limit(60)).cache()
    want = plain_alignment([tuple(r) for r in docs.collect()])
    got = [tuple(r) for r in alignment.align(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_alignment_shuffles_large_pair_tables(spark, texts, monkeypatch):
    want = sorted(map(str, alignment.align(texts).collect()))
    monkeypatch.setattr(alignment, "sized", lambda df: df)
    assert sorted(map(str, alignment.align(texts).collect())) == want
    pairs = alignment.vocabulary_map(texts)
    assert pairs.columns == ["a", "b", "n", "best"] and pairs.filter("best").count() > 0
    assert alignment.align(texts.limit(0)).count() == 0


def plain_repair(symbols):
    """(cost, audit) by trying every edit string of at most one insertion before a row and two at the end."""
    best = None

    def walk(i, state, cost, audit):
        nonlocal best
        if i == len(symbols):
            for closing in ("", "I", "II"):
                s = state
                for _ in closing:
                    s = "a" if s == "u" else "u"
                if s in ("", "a"):
                    best = min(best or (cost + 3 * len(closing), audit + closing), (cost + 3 * len(closing), audit + closing))
            return
        for inserted in ("", "I"):
            s = state
            if inserted:
                s = "a" if s == "u" else "u"
            c, a, said = cost + 3 * len(inserted), audit + inserted, "a" if s == "u" else "u"
            walk(i + 1, s, c + 4, a + "D")
            if symbols[i] != "x":
                extra = 3 * symbols[i].isupper()
                role = symbols[i].lower()
                walk(i + 1, said, c + 3 + extra, a + "R")
                if role == said or role == "s" and s == "":
                    walk(i + 1, role, c + extra, a + "K")

    walk(0, "", 0, "")
    return best


def test_least_path_integer_against_all_edits():
    rng = random.Random(3)
    seen = {"".join(p) for n in range(3) for p in itertools.product("xsuaoSUAO", repeat=n)}
    seen |= {"".join(rng.choices("xssuuuaaaoSUAO", k=rng.randint(3, 6))) for _ in range(250)}
    for symbols in seen:
        assert conversations.solve(symbols) == plain_repair(symbols), symbols


def test_blocks_do_not_change_the_answer(monkeypatch):
    rng = random.Random(4)
    cases = ["".join(rng.choices("xsuuaaoSUAO", k=rng.randint(9, 22))) for _ in range(40)]
    in_blocks = [conversations.solve(c) for c in cases]
    monkeypatch.setattr(conversations, "BLOCK", 64)
    assert [conversations.solve(c) for c in cases] == in_blocks


TURNS = "conv_id long, turn long, role string, text string"


def turn_rows():
    rng = random.Random(9)
    rows = [(1, None, "user", "First."), (1, None, "user", "First."), (1, 0, None, None), (2, 5, "tool", "x"), (2, 5, "tool", "x"), (3, 0, "", " \n "), (None, 1, "user", "Lost id."), (None, 0, "system", "S.")]
    rows += [(4, t, rng.choice(["user", "assistant", "assistant", "system", None]), rng.choice(["Yes.", "No", f"text {t}.", f"cut {t}", "", " "])) for t in range(700)]
    rows += [(5, 3, "user", "same.")] * 300 + [(6, t, "ua"[t % 2] + "x", f"t{t}!\n") for t in range(40)] + [(7, 2, "assistant", "a " * 40_000)]
    return rows + [(100 + c, t, ["user", "assistant"][t % 2], f"{c} {t}.") for c in range(80) for t in range(4)]


def test_repair_of_long_conversations_equals_the_short_way(spark):
    rows = spark.createDataFrame(turn_rows(), TURNS).repartition(5)
    for source in (rows, conversations.damaged(rows)):
        want = sorted(map(str, conversations.report(source).collect()))
        assert sorted(map(str, conversations.report(source, small_rows=20).collect())) == want
        assert sorted(map(str, conversations.report(source, small_chars=100).collect())) == want


def test_trees_of_several_levels(spark, monkeypatch):
    rows = spark.createDataFrame(turn_rows(), TURNS).repartition(5)
    want = sorted(map(str, conversations.report(rows).collect()))
    for name, value in (("TREE_WIDTH", 2), ("TREE_BITS", 1), ("RUN_BITS", 3)):
        monkeypatch.setattr(conversations, name, value)
    assert sorted(map(str, conversations.report(rows, small_rows=20).collect())) == want


def test_repaired_rows_are_legal_and_give_the_digest(spark):
    rows = spark.createDataFrame(turn_rows(), TURNS)
    digests = {r.conv_id: r.repaired_sha256 for r in conversations.report(rows).collect()}
    for small in (2_000, 20):
        made = {}
        for r in sorted(conversations.repaired_rows(rows, small_rows=small).collect(), key=lambda r: (r.at, r.n)):
            made.setdefault(r.conv_id, []).append((r.role, r.text))
        for conv, digest in digests.items():
            lines = made.get(conv, [])
            assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in lines))
            assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest() == digest


def test_repair_of_nothing_left(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(turn_rows(), TURNS).withColumn("blank", F.lit("clash"))
    gone = rows.withColumn("gone", F.lit(True))
    for small in (2_000, 20):
        for r in conversations.report(gone, small_rows=small).collect():
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.report(rows.limit(0)).count() == 0
