"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

Role initials of a repaired conversation match ``(s?(ua)+)?``. Edits of the rows in order: keep
(0), rerole to user or assistant (3), delete (4, required for blank rows and duplicates), insert an
empty user or assistant row anywhere (3); a truncated row that stays adds 3. Of the cheapest
edits those win whose initials D, I, K, R read ASCII-least.

Method: every edit is an edge of a directed acyclic graph over (rows done, role state, letters
written). Its weight is one integer: the cost in the high digits and the letter in the
digit of its place among fixed-width low digits, whose unused end stays zero. The least path integer
decides cost and ties at once. Rows are taken in blocks of eight. Between two borders of rows every
edit string ends with the edit of a row, never with an insertion, so no string is a
proper beginning of another and the block's own digits settle its ties; what follows counts as the
cost of each state at the right border. Blocks repeat often and are remembered.

Conversations of up to ``SMALL_ROWS`` rows and ``SMALL_CHARS`` characters (one pre-aggregated count tells) are
hash-partitioned and walked one by one. Longer ones are range-partitioned on their order, ties
included, so one conversation spans many tasks: first occurrences are found by an aggregate, runs of 256 rows are
summed up as a table of costs from state to state, those tables are combined up and down a tree to give each run the cost
behind it, each run then yields its exit for every entry state, and a second tree gives each run its
entry. Only the SHA-256 of a conversation's text has to read it in order; that pass streams finished parts, one at a
time.

Defined cases: null texts and roles count as one space; null turns come first; null conv_ids are one
conversation; rows of equal turn are ordered by role and text, repeated rows stay beside each other; a
conversation without rows left has zeros and an empty audit; an empty table gives no row; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import map_arrow, staged

SMALL_ROWS = 2_000
SMALL_CHARS = 32 << 20
# Rows of a long conversation that are one run; children of one node of the trees.
RUN_BITS = 8
TREE_BITS = 6
TREE_WIDTH = 4_096

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = "\0DIKR"  # a letter's digit is its place here; zero is the unused end
DIGIT_BITS = 3
BLOCK = 8
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER_USER, AFTER_ASSISTANT = USER, ASSISTANT
# Insertions that end a conversation legally, by state.
CLOSING = ("", "II", "I", "")
CLOSING_COST = tuple(INSERT * len(c) for c in CLOSING)
FAR = 1 << 40
SPACES = " \t\n\x0b\x0c\r"


def _speaks(state: int) -> int:
    """The state after the one role that may be given in a state: assistant after user, else user."""
    return ASSISTANT if state == USER else USER


def row_edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row.

    A symbol is x for a row that must go, else the initial s, u, a or o (none of them), in capitals when truncated.
    """
    edits = [("D", DELETE, state)]
    if symbol != "x":
        extra, role, said = TRUNCATED * symbol.isupper(), symbol.lower(), _speaks(state)
        edits.append(("R", REROLE + extra, said))
        if (role == "s" and state == START) or role == "?sua"[said]:
            edits.append(("K", KEEP + extra, SYSTEM if role == "s" else said))
    return edits


@lru_cache(maxsize=1 << 16)
def solve_block(symbols: str, entry: int, behind: tuple[int, ...]) -> tuple[int, str, int]:
    """(cost with what is behind, edit letters, exit state) of the least path integer from ``entry`` over a block of rows."""
    n = len(symbols)
    width = 2 * n
    low = DIGIT_BITS * width
    best: list[dict[tuple[int, int], int]] = [{} for _ in range(n + 1)]  # per rows done: {(letters, state): path integer}
    best[0][0, entry] = 0
    for row in range(n):
        here, there = best[row], best[row + 1]
        for letters in range(width):  # insertions lead on within the same row count
            for state in range(4):
                value = here.get((letters, state))
                if value is None:
                    continue
                place = DIGIT_BITS * (width - 1 - letters)
                for letter, cost, to in [("I", INSERT, _speaks(state)), *row_edits(symbols[row], state)]:
                    goal = here if letter == "I" else there
                    new = value + (cost << low) + (LETTERS.index(letter) << place)
                    at = (letters + 1, to)
                    if new < goal.get(at, new + 1):
                        goal[at] = new
    total, exit_state = min((value + (behind[state] << low), state) for (_, state), value in best[n].items())
    digits = total & ((1 << low) - 1)
    audit = "".join(LETTERS[digits >> DIGIT_BITS * (width - 1 - k) & (1 << DIGIT_BITS) - 1] for k in range(width)).rstrip("\0")
    return total >> low, audit, exit_state


@lru_cache(maxsize=1 << 16)
def block_costs(symbols: str) -> tuple[tuple[int, ...], ...]:
    """Least cost from every state to every state over a block."""
    return tuple(
        tuple(min(FAR, solve_block(symbols, a, tuple(0 if q == b else FAR for q in range(4)))[0]) for b in range(4)) for a in range(4)
    )


def behind_of(costs, behind):
    return tuple(min(min(c + v for c, v in zip(row, behind)), FAR) for row in costs)


def multiplied(first, second):
    return tuple(tuple(min(min(row[k] + second[k][b] for k in range(4)), FAR) for b in range(4)) for row in first)


IDENTITY = tuple(tuple(0 if a == b else FAR for b in range(4)) for a in range(4))


def blocks_of(symbols: str) -> list[str]:
    return [symbols[i : i + BLOCK] for i in range(0, len(symbols), BLOCK)]


def run_costs(symbols: str):
    out = IDENTITY
    for block in blocks_of(symbols):
        out = multiplied(out, block_costs(block))
    return out


def solve_run(symbols: str, entry: int, behind: tuple[int, ...]) -> tuple[int, str, int]:
    """(cost with what is behind, edit letters, exit state) of a run of rows of any length."""
    blocks, values = blocks_of(symbols), [tuple(behind)]
    for block in reversed(blocks[1:]):
        values.append(behind_of(block_costs(block), values[-1]))
    audit, state = [], entry
    total = values[-1][entry] if not blocks else None
    for block in blocks:
        value = values.pop()
        least = min(value)  # equal differences give equal edits
        cost, letters, state = solve_block(block, state, tuple(min(v - least, FAR) for v in value))
        total = cost + least if total is None else total
        audit.append(letters)
    return total, "".join(audit), state


def solve(symbols: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    cost, audit, state = solve_run(symbols, START, CLOSING_COST)
    return cost, audit + CLOSING[state]


def edited(audit: str, rows: list[tuple[str, str]], state: int) -> list[tuple[str, str]]:
    """Roles and texts that an audit makes of rows, entered in a state."""
    out, left = [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        if letter == "K" and role.startswith("s"):
            state = SYSTEM
        else:
            state = _speaks(state)
            if letter != "K":
                role = "user" if state == USER else "assistant"
        out.append((role, text))
    return out


def initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "o"


def symbol_of(role: str, must_go: bool, truncated: bool) -> str:
    return "x" if must_go else initial(role).upper() if truncated else initial(role)


def broken_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with the damage of their key: dropped (``gone``), emptied, without sentence ends, doubled, all user."""
    case = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(case == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (case == 0).alias("gone"), copies.alias("_copy")).drop("_copy")


def _prepared(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, blank, truncated; nulls of role and text are one space."""
    have = {c.lower() for c in rows.columns}
    gone = F.col("gone") if "gone" in have else F.lit(False)
    whole = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], gone.alias("gone"))
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    return whole.withColumns({"blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "truncated": ~last.isin(".", "!", "?")})


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LINES = "array<struct<role: string, text: string>>"
_LINES_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _whole_conversations(key_type: str, rows: DataFrame) -> DataFrame:
    """One part per conversation: every conversation is held by one task and walked in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *_COUNTS, "audit", "lines"]
        ids, counts, audits, lines, filled = [], [], [], [], 0
        key_arrow = None

        def conversation(held):
            rows = [r for r in held if not r[4]]
            turns = {r[1] for r in rows} - {None}
            seen, symbols = set(), []
            n_blank = n_double = n_cut = 0
            for _, _, role, text, _, blank, truncated in rows:
                double = not blank and (role, text) in seen
                seen.add((role, text))
                n_blank, n_double, n_cut = n_blank + blank, n_double + double, n_cut + (truncated and not blank and not double)
                symbols.append(symbol_of(role, blank or double, truncated))
            cost, audit = solve("".join(symbols))
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            pairs = [(r[2], r[3]) for r in rows]
            return (gaps, n_blank, n_double, n_cut, broken_pairs([r[:1] for r, _ in pairs]), cost), audit, edited(audit, pairs, START)

        def flush():
            columns = [pa.array(ids, key_arrow), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(len(_COUNTS))]]
            made = [[{"role": r, "text": t} for r, t in part] for part in lines]
            return pa.RecordBatch.from_arrays([*columns, pa.array(audits, pa.string()), pa.array(made, _LINES_TYPE)], names=names)

        def close(held):
            nonlocal filled
            count, audit, part = conversation(held)
            ids.append(held[0][0]), counts.append(count), audits.append(audit), lines.append(part)
            filled += sum(len(t) for _, t in part) + 64

        held = []
        for batch in batches:
            key_arrow = batch.schema.field(0).type
            for row in zip(*[batch.column(i).to_pylist() for i in range(7)]):
                if held and row[0] != held[0][0]:
                    close(held)
                    held = []
                    if filled > 1 << 21:
                        yield flush()
                        ids, counts, audits, lines, filled = [], [], [], [], 0
                held.append(row)
        if held:
            close(held)
        if ids:
            yield flush()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    schema = f"conv_id {key_type}, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string, lines {_LINES}"
    return map_arrow(ordered.select("conv_id", "turn", "role", "text", "gone", "blank", "truncated"), run, schema)


def _tree(values: DataFrame, key_type: str, backward: bool) -> DataFrame:
    """(conv_id, at, carried) for rows (conv_id, at, value): what all later (or all earlier) rows of the conversation come to.

    Backward, a value is a table of 16 costs and the carried value the cost behind each state; forward, a
    value is the exit of each entry state and the carried value the entry state. Nodes of
    up to 2 ** TREE_BITS neighbours are combined, level by level, until a conversation has TREE_WIDTH rows at most.
    """

    def table(value):
        return tuple(tuple(value[4 * i : 4 * i + 4]) for i in range(4))

    def walk(rows, carried):
        out = []
        for row in reversed(rows) if backward else rows:
            out.append((row["at"], carried))
            carried = list(behind_of(table(row["value"]), carried)) if backward else [row["value"][carried[0]]]
        return out

    def summed(rows):
        total = IDENTITY if backward else list(range(4))
        for row in rows:
            total = multiplied(total, table(row["value"])) if backward else [row["value"][q] for q in total]
        return [c for line in total for c in line] if backward else total

    def result(columns, data, kinds):
        return pa.table({c: pa.array([r[i] for r in data], k) for i, (c, k) in enumerate(zip(columns, kinds))})

    def pass_down(data: pa.Table) -> pa.Table:
        rows = sorted(data.to_pylist(), key=lambda r: r["at"])
        key = data.schema.field("conv_id").type
        found = walk(rows, rows[0]["above"])
        return result(["conv_id", "at", "carried"], [(rows[0]["conv_id"], *f) for f in found], [key, pa.int64(), pa.list_(pa.int64())])

    def pass_up(data: pa.Table) -> pa.Table:
        rows = sorted(data.to_pylist(), key=lambda r: r["at"])
        key = data.schema.field("conv_id").type
        return result(["conv_id", "at", "value"], [(rows[0]["conv_id"], rows[0]["node"], summed(rows))], [key, pa.int64(), pa.list_(pa.int64())])

    down = f"conv_id {key_type}, at bigint, carried array<bigint>"
    most = values.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    if most <= TREE_WIDTH:
        start = F.array(*[F.lit(c).cast("bigint") for c in (CLOSING_COST if backward else (START,))])
        return staged(values.withColumn("above", start).groupBy("conv_id").applyInArrow(pass_down, down), "tree-down")
    nodes = values.withColumn("node", F.shiftright("at", TREE_BITS))
    up = staged(nodes.groupBy("conv_id", "node").applyInArrow(pass_up, f"conv_id {key_type}, at bigint, value array<bigint>"), "tree-up")
    above = _tree(up, key_type, backward).select(F.col("conv_id").alias("_c"), F.col("at").alias("_n"), F.col("carried").alias("above"))
    joined = nodes.join(above, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n"))).drop("_c", "_n")
    return staged(joined.groupBy("conv_id", "node").applyInArrow(pass_down, down), "tree-down")


def _long_conversations(rows: DataFrame, key_type: str, count: int) -> DataFrame:
    """Parts of conversations of any length: conv_id, at, counts, first and last initial, entry and exit, audit, lines."""
    spark = rows.sparkSession
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    spread = rows.filter(~F.col("gone")).withColumn("_tie", F.monotonically_increasing_id())
    width = max(2, -(-count // (SMALL_ROWS * 8)))
    sorted_rows = spread.repartitionByRange(width, *order, "_tie").sortWithinPartitions(*order, "_tie")
    # Numbers grow along the sorted partitions, so they hold the order from here on.
    laid = staged(sorted_rows.drop("_tie", "gone").withColumn("ord", F.monotonically_increasing_id()), "turns")
    laid = laid.withColumns({"at": F.shiftright("ord", RUN_BITS), "sha": F.sha2("text", 256)})
    first = laid.groupBy("conv_id", "role", "sha").agg(F.min("ord").alias("_first")).select("_first", F.lit(True).alias("_new"))
    narrow = laid.select("conv_id", "at", "ord", "role", "blank", "truncated").join(first, F.col("ord") == F.col("_first"), "left")
    flagged = staged(
        narrow.select("conv_id", "at", "ord", "role", "blank", (F.col("_new").isNull() & ~F.col("blank")).alias("duplicate"), "truncated"), "turn-flags"
    )
    known = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    symbol = F.when(F.col("blank") | F.col("duplicate"), "x").when(F.col("truncated"), F.upper(known)).otherwise(known)
    each = F.array_sort(F.collect_list(F.struct("ord", symbol.alias("symbol"), F.substring("role", 1, 1).alias("letter"))))
    runs = flagged.groupBy("conv_id", "at").agg(
        each.alias("each"), F.count_if("blank").alias("blank"), F.count_if("duplicate").alias("duplicate"),
        F.count_if(F.col("truncated") & ~F.col("blank") & ~F.col("duplicate")).alias("truncated"),
    )
    runs = staged(runs.select("conv_id", "at", F.array_join("each.symbol", "").alias("symbols"), F.col("each.letter").alias("letters"), "blank", "duplicate", "truncated"), "turn-runs")

    @F.udf("array<bigint>", useArrow=True)
    def costs(symbols):
        return [c for line in run_costs(symbols) for c in line]

    @F.udf("array<bigint>", useArrow=True)
    def exits(symbols, behind):
        return [solve_run(symbols, q, tuple(behind))[2] for q in range(4)]

    def same(other, name):
        far = other.select(F.col("conv_id").alias("_c"), F.col("at").alias("_a"), F.col("carried").alias(name))
        return lambda df: df.join(far, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("at") == F.col("_a"))).drop("_c", "_a")

    behind = _tree(staged(runs.select("conv_id", "at", costs("symbols").alias("value")), "turn-costs"), key_type, True)
    runs = staged(same(behind, "behind")(runs), "turn-runs")
    entry = _tree(staged(runs.select("conv_id", "at", exits("symbols", "behind").alias("value")), "turn-exits"), key_type, False)
    runs = staged(same(entry, "entry")(runs), "turn-runs")

    def apply(texts: pa.Table, run: pa.Table) -> pa.Table:
        (found,) = run.to_pylist()
        rows = sorted(zip(texts.column("ord").to_pylist(), texts.column("role").to_pylist(), texts.column("text").to_pylist()))
        cost, audit, state = solve_run(found["symbols"], found["entry"][0], tuple(found["behind"]))
        lines = [{"role": r, "text": t} for r, t in edited(audit, [x[1:] for x in rows], found["entry"][0])]
        letters = found["letters"]
        data = {
            "conv_id": [found["conv_id"]], "at": [found["at"]], "blank": [found["blank"]], "duplicate": [found["duplicate"]], "truncated": [found["truncated"]],
            "illegal": [broken_pairs(letters)], "first": [letters[0]], "last": [letters[-1]], "exit": [state], "cost": [cost - found["behind"][state]], "audit": [audit],
        }
        kinds = [run.schema.field("conv_id").type, *[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        table = pa.table({c: pa.array(v, k) for (c, v), k in zip(data.items(), kinds)})
        return table.append_column("lines", pa.array([lines], _LINES_TYPE))

    schema = f"conv_id {key_type}, at bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, exit bigint, cost bigint, audit string, lines {_LINES}"
    texts = laid.select("conv_id", "at", "ord", "role", "text").groupBy("conv_id", "at")
    return texts.cogroup(runs.select("conv_id", "at", "symbols", "letters", "behind", "entry").join(
        runs.select(F.col("conv_id").alias("_c"), F.col("at").alias("_a"), "blank", "duplicate", "truncated"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("at") == F.col("_a"))
    ).drop("_c", "_a").groupBy("conv_id", "at")).applyInArrow(apply, schema)


def _streamed(parts: DataFrame, key_type: str) -> DataFrame:
    """(conv_id, counts without gaps, audit, repaired_sha256) of conversations in parts, one part in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_arrow, current = None, None

        def end(c):
            state = CLOSING[c["exit"]]
            for role in {"": (), "I": ("assistant",), "II": ("user", "assistant")}[state]:
                c["sha"].update((("\n" if c["any"] else "") + role + ":").encode())
                c["any"] = True
            counts = [c["blank"], c["duplicate"], c["truncated"], c["illegal"], c["cost"] + INSERT * len(state)]
            arrays = [pa.array([c["id"]], key_arrow), *[pa.array([n], pa.int64()) for n in counts], pa.array(["".join([*c["audit"], state])]), pa.array([c["sha"].hexdigest()])]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

        for batch in batches:
            key_arrow = batch.schema.field(0).type
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if current is None or current["id"] != row["conv_id"]:
                    if current is not None:
                        yield end(current)
                    current = {"id": row["conv_id"], "sha": hashlib.sha256(), "any": False, "audit": [], "last": None} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
                for name in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    current[name] += row[name]
                if current["last"] is not None:
                    current["illegal"] += broken_pairs([current["last"], row["first"]])
                current["last"], current["exit"] = row["last"], row["exit"]
                current["audit"].append(row["audit"])
                if row["joined"] is not None:
                    current["sha"].update((("\n" if current["any"] else "") + row["joined"]).encode("utf-8"))
                    current["any"] = True
        if current is not None:
            yield end(current)

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    schema = f"conv_id {key_type}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return map_arrow(ordered, run, schema)


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")


def _split(rows: DataFrame, small_rows: int, small_chars: int):
    """(rows of conversations that one task may hold, rows of longer ones or None, count of the latter)."""
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c"))
    large = staged(sizes.filter((F.col("n") > small_rows) | (F.col("c") > small_chars)).select(F.col("conv_id").alias("_c"), "n"), "long-conversations")
    found = large.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not found:
        return rows, None, 0
    is_long = F.col("conv_id").eqNullSafe(F.col("_c"))
    ids = large.select("_c")
    return rows.join(ids, is_long, "left_anti"), rows.join(ids, is_long, "left_semi"), found


def repair(rows: DataFrame, small_rows: int = SMALL_ROWS, small_chars: int = SMALL_CHARS) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Repaired conversations of rows (conv_id, turn, role, text and, where known, ``gone`` for rows that are lost).

    Returns (one row per short conversation: counts, audit, lines), (parts of long ones, in order of ``at``, or None) and
    the prepared rows of the long ones.
    """
    key_type = rows.schema["conv_id"].dataType.simpleString()
    ready = _prepared(rows)
    short, long, count = _split(ready, small_rows, small_chars)
    whole = _whole_conversations(key_type, short)
    return whole, None if long is None else _long_conversations(long, key_type, count), long


def report(rows: DataFrame, small_rows: int = SMALL_ROWS, small_chars: int = SMALL_CHARS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    key_type = rows.schema["conv_id"].dataType.simpleString()
    whole, parts, long = repair(rows, small_rows, small_chars)
    out = whole.select("conv_id", *_COUNTS, "audit", F.sha2(_joined(F.col("lines")).cast("binary"), 256).alias("repaired_sha256"))
    if parts is None:
        return out
    text = F.when(F.size("lines") > 0, _joined(F.col("lines")))
    streamed = _streamed(parts.select("conv_id", "at", "blank", "duplicate", "truncated", "illegal", "cost", "first", "last", "exit", "audit", text.alias("joined")), key_type)
    there = ~F.col("gone")
    turn = F.when(there, F.col("turn"))
    gaps = long.groupBy("conv_id").agg((F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)).alias("gaps"))
    both = gaps.join(streamed.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    zero = [F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in _COUNTS]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.unionByName(both.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")))


def repaired_rows(rows: DataFrame, small_rows: int = SMALL_ROWS, small_chars: int = SMALL_CHARS) -> DataFrame:
    """(conv_id, at, n, role, text): the rows of every repaired conversation, in order of (at, n)."""
    whole, parts, _ = repair(rows, small_rows, small_chars)
    out = whole.select("conv_id", F.lit(0).cast("bigint").alias("at"), F.posexplode("lines").alias("n", "line"))
    if parts is not None:
        closing = F.when(F.col("exit") == SYSTEM, F.array(F.lit("user"), F.lit("assistant"))).when(F.col("exit") == USER, F.array(F.lit("assistant")))
        ends = parts.groupBy("conv_id").agg(F.max("at").alias("at"), F.max_by("exit", "at").alias("exit"))
        added = ends.select("conv_id", (F.col("at") + 1).alias("at"), F.posexplode(closing).alias("n", "role"))
        out = out.unionByName(parts.select("conv_id", "at", F.posexplode("lines").alias("n", "line")))
        out = out.select("conv_id", "at", "n", "line.role", "line.text").unionByName(added.withColumn("text", F.lit("")))
        return out
    return out.select("conv_id", "at", "n", "line.role", "line.text")
