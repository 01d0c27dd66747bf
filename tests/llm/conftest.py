import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def make(spark):
    def documents(rows, extra=()):
        """Documents from (doc_id, text, source) or longer rows; ``extra``: (name, value) of further columns."""
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name, value in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(value))
        return df

    return documents


# Nulls, empty and blank texts, ties, repeated rows, a very long text, letters beyond ASCII.
ODD = [
    (1, None, None), (2, "", "a"), (3, " \t\n\n ", "a"), (4, "one", "b"), (4, "one", "b"), (5, "one", None), (None, "two words", "b"),
    (None, None, None), (6, "Äpfel und Öl 中文 \U0001f600 end", "a"), (7, "word " * 60_000, "b"), (8, "a.b!c?\n" * 500, "a"), (9, "one", "c"),
]


@pytest.fixture(scope="session")
def odd(make):
    """The odd rows with columns named like those that operators add."""
    clash = ["failed", "n_words", "kept", "n_hit", "hit_items", "shard", "size", "_d0", "_crc", "fp", "_keep", "_rank", "k1", "copies", "tokens"]
    return make(ODD, [(c, f"mine-{c}") for c in clash])
