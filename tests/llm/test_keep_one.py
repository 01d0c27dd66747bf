"""near_dedup of the pipeline with ids that occur with different texts, and without ids."""

import random

import brute

from folioflow.llm import simhash


def test_repeated_and_missing_ids(make):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(40)]
    rows = [(i // 3, t) for i, t in enumerate(texts)]
    # Copies: under another text's id, under the same id, without an id.
    rows += [(rng.randrange(14), rng.choice(texts)) for _ in range(60)] + rows[:5]
    alone = "no id here and no copy with one at all"
    rows += [(None, alone)] * 4 + [(None, texts[0])] * 2
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_one(make(rows)).collect()]
    assert len({brute.fingerprint(t) for t in texts}) == len(texts)
    least = {t: min(i for i, u in rows if u == t and i is not None) for t in texts}
    assert sorted(g for g in got if g[0] is not None) == sorted((i, t) for t, i in least.items())
    assert sorted(t for i, t in got if i is None) == sorted([alone, texts[0]])
