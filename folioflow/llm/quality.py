"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and
one bit per failed rule. Policies are versioned sets of bits applied afterwards,
and ablations ("what would dropping this rule change?") are bitwise aggregates over
the distinct masks. Built-in functions only.

Defined cases: a null text has no words and no lines and fails ``few_words``; ties
and repeated rows are judged alike; an empty table gives an empty ledger; input
columns with names of the ledger are kept as ``in_<name>``, others pass through.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import SPACE, WORD, restored, set_aside, settled, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_capital_words")

# Rules in bit order; each is true when the document fails. Integer arithmetic only.
RULES: Mapping[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 10 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "few_letters": "10 * n_letter_words < 7 * n_words",
    "capitals": "2 * n_capital_words > n_words",
}
BASE = ("few_words", "repeated_words")
# Versions are never changed once published; a new set of rules gets a new name.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base-1": BASE,
    "full-1": tuple(RULES),
}

LEDGER = (*MEASURES, "failed", "kept", "_ws", "_lines", "_hashes", "_marks", "_at")


def mask_of(rules) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """Documents plus the measurements and ``failed``, the bits of the failed rules."""
    docs, _ = set_aside(docs, LEDGER)
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("_ws", words(F.col("text")))
    out = out.withColumn("n_words", F.size("_ws").cast("bigint"))
    out = out.withColumn(
        "_lines", F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    )
    out = out.withColumn(
        "_hashes",
        F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.col("n_words").cast("int") - 3),
                lambda i: F.xxhash64(F.get("_ws", i), F.get("_ws", i + 1), F.get("_ws", i + 2)),
            )
        ),
    )
    # Words inside 3-word windows that occur twice or more. Texts without such a window, nearly all, end at the
    # first test; in the others equal windows meet by one sort of (hash, position), and the words covered are
    # counted from the gaps between neighbouring positions.
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    out = out.withColumn(
        "_marks",
        F.when(repeats, F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    near = lambda i: F.get("_marks", i)["h"]
    out = out.withColumn(
        "_at",
        F.array_sort(
            F.transform(
                F.filter(
                    F.transform(
                        "_marks",
                        lambda m, i: F.struct(
                            m["i"].alias("i"),
                            (F.coalesce(m["h"] == near(i - 1), F.lit(False)) | F.coalesce(m["h"] == near(i + 1), F.lit(False))).alias("hit"),
                        ),
                    ),
                    lambda m: m["hit"],
                ),
                lambda m: m["i"],
            )
        ),
    )
    gaps = F.transform("_at", lambda a, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - a, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda acc, g: acc + g)
    letters = F.filter("_ws", lambda w: F.regexp_like(w, F.lit(r"\p{L}")))
    capitals = F.filter("_ws", lambda w: F.regexp_like(w, F.lit(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")))
    out = out.withColumns(
        {
            "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("bigint"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
            "n_letter_words": F.size(letters).cast("bigint"),
            "n_capital_words": F.size(capitals).cast("bigint"),
        }
    ).drop("_ws", "_lines", "_hashes", "_marks", "_at")
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return settled(out, "failed", failed.cast("bigint"))


def apply_policy(ledger_rows: DataFrame, policy: str, name: str = "kept") -> DataFrame:
    """Add whether a document passes every rule of the policy."""
    return ledger_rows.withColumn(name, F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0)


def ablation(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail nothing else, and the kept count without it.

    Documents are first counted per distinct mask (at most 2^rules rows).
    """
    bits = mask_of(POLICIES[policy])
    masks = ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(bits)).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of([r])).alias("bit")) for r in POLICIES[policy]])
    each = masks.withColumn("r", F.explode(rules)).select("mask", "n", "r.rule", "r.bit")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    return each.groupBy("rule", "bit").agg(
        total(F.col("mask").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("mask") == F.col("bit")).alias("n_failed_alone"),
        total(F.col("mask").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = "full-1") -> DataFrame:
    """The documents that pass, with their own columns."""
    docs, original = set_aside(docs, LEDGER)
    return restored(apply_policy(ledger(docs), policy).filter("kept"), original)
