"""Op 1 on altered copies of every template, against shingle counts in plain Python."""

import random
import re

from folioflow.llm import licenses


def grams(ws):
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def test_bands_hold_at_the_threshold():
    for text in licenses.TEMPLATES.values():
        n = len(re.sub(r"[\W_]+", " ", text.lower()).split())
        m = max(1, n - 4)
        held = -(-4 * m // 5)
        share = held / (max(3 * n - 4, m) + m - held)
        assert (1 - share) ** licenses.bands_for(n) <= 0.001


def test_altered_copies(make):
    rng, rows, want = random.Random(9), [], set()
    for name, text in sorted(licenses.TEMPLATES.items()):
        words = re.sub(r"[\W_]+", " ", text.lower()).split()
        for _ in range(40):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(copy) + 1)
                copy[at:at] = [f"x{rng.random()}" for _ in range(rng.randint(1, max(1, len(words) // 3)))]
            if rng.random() < 0.3:
                del copy[rng.randrange(len(copy))]
            doc = [f"a{rng.random()}" for _ in range(rng.randint(0, 200))] + copy + ["end"] * rng.randint(0, 90)
            rows.append((len(rows), re.sub(r"[\W_]+", " ", " ".join(doc))))
            t, mine = grams(words), grams(rows[-1][1].split())
            if len(t & mine) >= 0.8 * len(t) and len(copy) <= 2 * len(words):
                want.add((rows[-1][0], name))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(make(rows)).collect()}
    assert len(want) > 150 and want <= got
