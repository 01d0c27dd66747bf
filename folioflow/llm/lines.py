"""Line dedup by an exact set-similarity join.

A line's tokens are its 5-word shingles (a shorter line is one shingle), as for all
near-duplicate stages. Tokens are ordered by rarity, a line of n tokens is
represented by its n - ceil(t n) + 1 rarest ones (prefix filter), lines meet on a
shared prefix token, and pairs pass the length and positional filters and the bound of
a bitmap of their tokens before their Jaccard similarity is computed. A line is removed if an earlier line (by
document id and line number) is equal or has a similarity of t or more.

Rarity comes from a fixed-size count sketch over all distinct lines: any one order gives the
exact result, the sketch makes frequent tokens come last. Equal lines are grouped first and
only the earliest of them is tokenised. Groups of near copies are not expanded: a line is
first compared with the earliest holder of each of its prefix tokens; only lines
that find no match there are compared with the other earlier holders. Built-in functions only.

Defined cases: null texts and blank lines are untouched; rows without an id rank last;
of rows with equal id the texts are told apart by their CRC; repeated rows count as
one; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import BROADCAST_DOCUMENTS, settled, sized, staged, words

SHINGLE = 5
# Similarity of at least 4/5, in whole numbers.
NUM, DEN = 4, 5
SKETCH_BUCKETS = 1 << 12
# Up to so many buckets of frequent tokens, most lines need no rarity keys to find their prefix.
FEW_BUCKETS = 64
# Longs of a line's bitmap.
SIGNATURE = 4
_LAST = (1 << 63) - 1
_LINE = (1 << 31) - 1


def shingles(hashes: Column) -> Column:
    """Distinct 48-bit hashes of the 5-word shingles, from the words' hashes; of the whole line if it is shorter.

    48 bits leave room for the rarity class in a key and collide for one token in some
    hundred even among 10^12 others; a chance meeting costs one comparison.
    """
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - SHINGLE + 1, F.lit(1)))
    window = lambda first, i: F.xxhash64(first, *[F.get(hashes, i + k) for k in range(1, SHINGLE)])
    return F.array_distinct(F.transform(starts, lambda first, i: F.shiftrightunsigned(window(first, i), 16)))


def with_lines(docs: DataFrame) -> DataFrame:
    """id (missing: last), at (crc of the text, then line number) and line, for every line with a word."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("id"),
        F.shiftleft(F.crc32(F.col("text").cast("binary")), 31).alias("stamp"),
        "text",
    ).filter("text is not null")
    lines = rows.select("id", "stamp", F.posexplode(F.split("text", "\n")).alias("number", "line"))
    return lines.filter(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")) != "").select("id", (F.col("stamp") + F.col("number")).alias("at"), "line")


def line_words(line: Column) -> Column:
    """White-space words of one line. Few lines hold other white space than blanks; the rest need no regular expression."""
    other = reduce(or_, [F.contains(line, F.lit(c)) for c in "\t\n\x0b\x0c\r"])
    return F.when(other, words(line)).otherwise(F.array_remove(F.split(line, " "), ""))


def with_tokens(lines: DataFrame) -> DataFrame:
    low = lines.select("id", "at", F.lower("line").alias("line"))
    hashed = settled(low, "hashes", F.transform(line_words(F.col("line")), lambda w: F.xxhash64(w))).drop("line")
    # Sorted here, where their type tells that none is null, they are sorted as plain longs and once for all.
    return settled(hashed, "tokens", F.sort_array(shingles(F.col("hashes")))).drop("hashes")


def rarity_classes(tokens: DataFrame) -> list[int]:
    """Per bucket of the count sketch: 0 up to twice the mean count, then one class more for every doubling."""
    counts = tokens.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(F.lit(SKETCH_BUCKETS - 1)).alias("b")).count()
    rows = counts.collect()  # one per bucket
    classes, mean = [0] * SKETCH_BUCKETS, sum(r["count"] for r in rows) / SKETCH_BUCKETS
    for r in rows:
        classes[r["b"]] = max(0, int(r["count"] / (2 * mean)).bit_length())
    return classes


def rarity_keys(tokens: Column, classes: list[int]) -> Column:
    """The tokens' keys, declared as never null: plain longs are sorted several times faster than boxed ones."""
    key = lambda t: t
    if any(classes):
        table = F.split(F.lit(",".join(map(str, classes))), ",").cast("array<bigint>")  # a constant
        key = lambda t: F.shiftleft(F.get(table, t.bitwiseAND(F.lit(SKETCH_BUCKETS - 1))), 48).bitwiseOR(t)
    return F.transform(tokens, lambda t: F.coalesce(key(t), F.lit(0).cast("bigint")))


def prefixes(tokens: DataFrame, classes: list[int]) -> DataFrame:
    """One row per prefix token of lines with sorted tokens: id, at, n (tokens of the line), pos, key.

    A key is the rarity class in the high bits and the token's hash below, so keys sort by rarity. The class of
    most tokens is 0 and their key the token itself: a line whose first tokens are all such has them as its prefix.
    """
    n = F.size("tokens")
    length = n - F.floor((n * NUM + DEN - 1) / DEN).cast("int") + 1
    first = lambda keys: F.slice(keys, F.lit(1), length)
    keys, frequent = first("tokens"), [b for b, c in enumerate(classes) if c]
    if frequent:
        ranked = first(F.sort_array(rarity_keys(F.col("tokens"), classes)))
        some = F.exists(keys, lambda t: t.bitwiseAND(F.lit(SKETCH_BUCKETS - 1)).isin(frequent))
        keys = F.when(some, ranked).otherwise(keys) if len(frequent) <= FEW_BUCKETS else ranked
    rows = settled(tokens.select("id", "at", "tokens", n.alias("n")), "keys", keys)
    return rows.select("id", "at", "n", F.posexplode("keys").alias("pos", "key"))


def _passes(n: str, pos: str, m: str, at: str) -> Column:
    """Length and positional filter for a pair that meets on the first token both share."""
    n, pos, m, at = (F.col(c) for c in (n, pos, m, at))
    length = (n * NUM <= m * DEN) & (m * NUM <= n * DEN)
    bound = F.least(n - pos, m - at)
    return length & (bound * (NUM + DEN) >= (n + m) * NUM)


def signatures(tokens: DataFrame) -> DataFrame:
    """id, at and a bitmap of the tokens in SIGNATURE longs."""
    none = F.lit(0).cast("bigint")

    def long(k: int) -> Column:
        def add(acc: Column, t: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), t.bitwiseAND(F.lit(63)).cast("int"))
            return F.when(F.shiftrightunsigned(t, 6).bitwiseAND(F.lit(SIGNATURE - 1)) == k, acc.bitwiseOR(bit)).otherwise(acc)

        return F.aggregate("tokens", none, add)

    return tokens.select("id", "at", F.struct(*[long(k).alias(f"s{k}") for k in range(SIGNATURE)]).alias("sig"))


def _may_overlap(n: str, sig: str, m: str, other: str) -> Column:
    """Every bit that only one bitmap has is a token that only one line has: an upper bound of the overlap is enough."""

    def alone(a, b):
        return sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}.s{k}")))) for k in range(SIGNATURE)), F.lit(0))

    bound = F.least(F.col(n) - alone(sig, other), F.col(m) - alone(other, sig))
    return bound * (NUM + DEN) >= (F.col(n) + F.col(m)) * NUM


def _verified(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, at) of the staged ``pairs`` (id, at, o_id, o_at) whose two lines are similar enough."""
    wanted = sized(pairs.select("id", "at").union(pairs.select("o_id", "o_at")), count=2 * pairs.count())
    held = staged(tokens.join(wanted, ["id", "at"], "left_semi"), "lines-held")
    other = held.select(F.col("id").alias("o_id"), F.col("at").alias("o_at"), F.col("tokens").alias("other"))
    both = pairs.join(held, ["id", "at"]).join(other, ["o_id", "o_at"])
    common = F.size(F.array_intersect("tokens", "other"))
    total = F.size("tokens") + F.size("other") - common
    return staged(both.filter(common * DEN >= total * NUM).select("id", "at").distinct(), "lines-found")


def _copies(lines: DataFrame) -> DataFrame:
    """(id, at) of every line that equals an earlier one."""
    digests = staged(lines.select("id", "at", F.xxhash64("line").alias("h"), F.crc32(F.col("line").cast("binary")).alias("c")), "lines-digests")
    # Counted first, in plain longs: the least place, a struct, is sought among repeated lines only.
    repeated = staged(digests.groupBy("h", "c").count().filter("count > 1").select("h", "c"), "lines-repeated")
    groups = repeated.count()
    again = staged(digests.join(sized(repeated, count=groups), ["h", "c"]), "lines-again")
    first = again.groupBy("h", "c").agg(F.min(F.struct("id", "at")).alias("first"))
    later = again.join(sized(first, BROADCAST_DOCUMENTS, groups), ["h", "c"]).filter(F.struct("id", "at") != F.col("first"))
    return staged(later.select("id", "at").distinct(), "lines-copies")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """id and at of every line that has an equal or similar earlier line."""
    lines = with_lines(docs.select("doc_id", "text"))
    copies = _copies(lines)
    tokens = staged(with_tokens(lines.join(sized(copies), ["id", "at"], "left_anti")), "lines-tokens")
    # Not staged: cutting prefixes off sorted tokens a second time costs less than writing and reading them.
    cut = prefixes(tokens, rarity_classes(tokens))
    shared = staged(cut.groupBy("key").count().filter("count > 1").select("key"), "lines-keys")
    held = staged(cut.join(sized(shared), "key"), "lines-shared")
    some = sized(held.select("id", "at").distinct(), count=held.count())
    drawn = signatures(tokens.join(some, ["id", "at"], "left_semi"))
    held = held.join(staged(drawn, "lines-signatures"), ["id", "at"])
    held = staged(held.select("key", "n", "pos", "sig", F.struct("id", "at").alias("me")), "lines-held")
    # Repeated rows of a document hold a key twice, at the same place.
    lead = held.groupBy("key").agg(F.min(F.struct("me", "n", "pos", "sig")).alias("lead"), F.max("me").alias("last"))
    lead = lead.filter(F.col("lead.me") != F.col("last"))
    lead = staged(lead.select("key", *[F.col(f"lead.{c}").alias(f"o_{c}") for c in ("me", "n", "pos", "sig")]), "lines-leaders")
    close = (F.col("o_me") < F.col("me")) & _passes("n", "pos", "o_n", "o_pos") & _may_overlap("n", "sig", "o_n", "o_sig")
    pair = ["me.id", "me.at", F.col("o_me.id").alias("o_id"), F.col("o_me.at").alias("o_at")]
    met = held.join(lead, "key").filter(close)
    # Of a line's leaders the one that shares most of its prefix is tried first.
    shares = met.groupBy("me", "o_me").agg(F.count(F.lit(1)).alias("common"))
    tried = shares.groupBy("me").agg(F.max_by("o_me", F.struct("common", "o_me")).alias("o_me"))
    tried = staged(tried.select(*pair), "lines-tried")
    found = _verified(tokens, tried)
    # Lines without a match there meet all other earlier holders of their prefix tokens.
    done = sized(found.select(F.struct("id", "at").alias("me")))
    left = held.join(lead.select("key"), "key", "left_semi").join(done, "me", "left_anti")
    earlier = held.select("key", *[F.col(c).alias(f"o_{c}") for c in ("me", "n", "pos", "sig")])
    more = left.join(earlier, "key").filter(close)
    more = more.select(*pair).distinct().join(tried, ["id", "at", "o_id", "o_at"], "left_anti")
    return copies.union(found).union(_verified(tokens, staged(more, "lines-more"))).distinct()


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed_lines (numbers from 0, rising) and text (what is left)."""
    gone = repeated_lines(docs).groupBy(F.col("id").alias("g_id"), F.shiftrightunsigned("at", 31).alias("g_stamp")).agg(
        F.sort_array(F.collect_set(F.col("at").bitwiseAND(F.lit(_LINE)).cast("int"))).alias("removed_lines")
    )
    keyed = docs.select(
        "doc_id",
        "text",
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("id"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("stamp"),
    )
    gone = sized(staged(gone, "lines-gone"), BROADCAST_DOCUMENTS)
    out = keyed.join(gone, (F.col("id") == F.col("g_id")) & (F.col("stamp") == F.col("g_stamp")), "left")
    out = settled(out, "lines", F.split("text", "\n"))
    kept = F.filter("lines", lambda x, i: ~F.array_contains("removed_lines", i))
    return out.select(
        "doc_id",
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("removed_lines"), F.lit(0)).alias("n_removed"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
        F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
