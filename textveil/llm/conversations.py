"""Repair of damaged conversations at the least cost of edits.

The edits of a conversation form a graph: a node is a place among its rows with what the roles so far allow next, an arc
is an edit. Costs from the start and to the end give the arcs of the cheapest repairs (an arc is tight if cost before it,
own cost and cost behind it make the total); a walk over sets of nodes along tight arcs, the least letter first, spells the
least audit.

Rows are dealt out by ranges of conversation and turn, so that a long conversation lies in several tasks. What begins and
ends inside a task is solved there. The others are cut into blocks of bounded size: a block's costs are a matrix from its
first to its last state, so the blocks of a conversation meet as small matrices, then as small maps of states, and its
texts pass in order through one digest. An audit is one string, so a conversation has under 2 ** 31 rows, and under
2 ** 31 / BLOCK_ROWS blocks meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import durable

SPACES = " \t\n\x0b\x0c\r"
#: A block ends at so many rows or characters.
BLOCK_ROWS, BLOCK_CHARS = 4096, 4 << 20
# Costs of edits.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
#: States: nothing yet, after the system's row, after a user's, after an assistant's. Where a role's initial leads from each.
STATES, ENDS = range(4), (0, 3)
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The state that a user or assistant leads to, and its role.
TURN, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "array<struct<turn: long, role: string, text: string, fault: string>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone (boolean) after the contract's damage; a dropped row stays as one that is gone."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("harm") == 0).alias("gone"), twice)


@lru_cache(maxsize=64)
def arcs(code: str) -> tuple[tuple[str, int, int, int], ...]:
    """letter, from, to, cost of what can be done with a row of a class: x must go, else its role's initial, in capitals if truncated."""
    out = [("D", q, q, DELETE) for q in STATES]
    if code != "x":
        more = TRUNCATED if code.isupper() else 0
        out += [("K", q, to, more) for q, to in enumerate(AFTER.get(code.lower(), ())) if to is not None]
        out += [("R", q, TURN[q], REROLE + more) for q in STATES]
    return tuple(out)


def _inserted(costs: list[int]) -> list[int]:
    """Costs of the states of one place once rows may be inserted there."""
    user = min(costs[2], min(costs[0], costs[1], costs[3]) + INSERT)
    return [costs[0], costs[1], user, min(costs[3], user + INSERT)]


def forward(codes: str, costs: list[int]) -> list[list[int]]:
    """Least costs of the states before each row (inserts there included) and, last, on arrival behind all rows."""
    out = []
    for code in codes:
        costs = _inserted(costs)
        out.append(costs)
        after = [FAR] * 4
        for _, q, to, cost in arcs(code):
            after[to] = min(after[to], costs[q] + cost)
        costs = after
    return [*out, costs]


def backward(codes: str, costs: list[int]) -> list[list[int]]:
    """Least costs from the states of each place to the end, given those of the place behind all rows."""
    out = [costs]
    for code in reversed(codes):
        before = [FAR] * 4
        for _, q, to, cost in arcs(code):
            before[q] = min(before[q], cost + costs[to])
        for _ in range(2):  # two rows at most are worth inserting at a place
            before = [min(before[q], INSERT + before[TURN[q]]) for q in STATES]
        costs = before
        out.append(costs)
    return out[::-1]


#: From each state behind the last row to an end, by inserts.
CLOSING = [0, 2 * INSERT, INSERT, 0]


def walk(codes: str, ahead: list[list[int]], behind: list[list[int]], total: int, states: set[int], last: bool) -> tuple[str, set[int]]:
    """Letters of the least audit along tight arcs from some states before the first row, and the states behind the last one.

    last: the conversation ends here, so that rows may still be inserted and the walk stops at an end.
    """
    letters, place = [], 0
    ahead = [*ahead[:-1], _inserted(ahead[-1])]
    while True:
        if place == len(codes) and (not last or any(q in ENDS and ahead[place][q] == total for q in states)):
            return "".join(letters), states
        found: dict[str, set[int]] = {}
        steps = [("I", q, TURN[q], INSERT, 0) for q in states]
        if place < len(codes):
            steps += [(letter, q, to, cost, 1) for letter, q, to, cost in arcs(codes[place]) if q in states]
        for letter, q, to, cost, on in steps:
            if ahead[place][q] + cost + behind[place + on][to] == total:
                found.setdefault(letter, set()).add(to)
        letter = min(found)
        letters.append(letter)
        states, place = found[letter], place + (letter != "I")


@lru_cache(maxsize=1 << 15)
def solved(codes: str) -> tuple[int, str]:
    """Cost and least audit of a whole conversation."""
    ahead, behind = forward(codes, [0, FAR, FAR, FAR]), backward(codes, CLOSING)
    total = behind[0][0]
    return total, walk(codes, ahead, behind, total, {0}, True)[0]


def faults(roles: list[str], texts: list[str], seen: set | None = None) -> list[str]:
    """Each row's first fault: b, d (among these rows, or its mark is among seen), t or none."""
    out, own = [], set()
    for role, text in zip(roles, texts, strict=True):
        rest = text.rstrip(SPACES)
        if not rest:
            out.append("b")
        elif (role, text) in own or (seen and mark(role, text) in seen):
            out.append("d")
        else:
            own.add((role, text))
            out.append("" if rest[-1] in ".!?" else "t")
    return out


def mark(role: str, text: str) -> bytes:
    return hashlib.md5(f"{role}\0{text}".encode(errors="surrogatepass")).digest()


def classes(roles: list[str], found: list[str]) -> str:
    """A letter for each row, as arcs() takes them."""
    out = []
    for role, fault in zip(roles, found, strict=True):
        initial = role[:1] if role[:1] in AFTER and role else "o"
        out.append("x" if fault in ("b", "d") else initial.upper() if fault == "t" else initial)
    return "".join(out)


def repaired(audit: str, roles: list[str], texts: list[str], state: int = 0) -> tuple[list[str], int]:
    """The repaired rows of an audit, and the state behind them."""
    out, row = [], 0
    for letter in audit:
        if letter == "I":
            out.append(ROLE[state] + ":")
            state = TURN[state]
            continue
        if letter == "K":
            out.append(f"{roles[row]}:{texts[row]}")
            state = AFTER[roles[row][0]][state]
        elif letter == "R":
            out.append(f"{ROLE[state]}:{texts[row]}")
            state = TURN[state]
        row += 1
    return out, state


def _sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode(errors="surrogatepass")).hexdigest()


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _whole(turns: list, roles: list[str], texts: list[str]) -> tuple:
    """The columns of RESULT for a conversation's rows."""
    found = faults(roles, texts)
    cost, audit = solved(classes(roles, found))
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    counts = (found.count("b"), found.count("d"), found.count("t"))
    return gaps, *counts, _illegal([r[:1] for r in roles]), cost, audit, _sha(repaired(audit, roles, texts)[0])


def _schema(conversations: DataFrame, fields: str) -> str:
    return f"conv_id {dict(conversations.dtypes)['conv_id']}, {fields}"


def _arrow(df: DataFrame, fields: str) -> tuple[pa.Schema, str]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = _schema(df, fields)
    return to_arrow_schema(StructType.fromDDL(schema)), schema


def mapped(df: DataFrame, fields: str, one: Callable[[dict], Iterator[dict]]) -> DataFrame:
    """A DataFrame (conv_id, fields) of what one() makes of each row of df."""
    arrow, schema = _arrow(df, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a row is a block
                yield pa.RecordBatch.from_pylist(list(one(batch.slice(k, 1).to_pylist()[0])), schema=arrow)

    return df.mapInArrow(run, schema)


def staged(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, part, no and either the columns of RESULT, for conversations that begin and end in a task, or a block's rows.

    marks: of the block's different rows that are not blank.
    """
    tie = F.md5(F.encode(F.concat("role", F.lit("\0"), "text"), "UTF-8"))
    keyed = rows.select("*", F.substring("role", 1, 40).alias("_role"), F.substring("text", 1, 40).alias("_head"), tie.alias("_tie"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col(c) for c in ("conv_id", "turn", "_role", "_head", "_tie")]
    # equal rows can't be told apart, so that a range may end among them
    dealt = keyed.repartitionByRange(*order, F.col("_row")).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone")
    arrow, schema = _arrow(rows, f"part int, no int, {RESULT}, marks array<binary>, rows {ROWS}")
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begun, alone = TaskContext.get().partitionId(), False, False
        own, no, chars, turns, roles, texts = None, 0, 0, [], [], []

        def block() -> dict:
            found = faults(roles, texts)
            listed = [{"turn": t, "role": r, "text": x, "fault": f} for t, r, x, f in zip(turns, roles, texts, found, strict=True)]
            marks = [mark(r, x) for r, x, f in zip(roles, texts, found, strict=True) if f in ("", "t")]
            return {"conv_id": own, "part": part, "no": no, "marks": marks, "rows": listed}

        def closed() -> dict:
            return {"conv_id": own, "part": part, "no": 0} | dict(zip(names, _whole(turns, roles, texts), strict=True))

        for batch in batches:
            out = []
            for key, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                other = not begun or key != own
                if other or len(roles) >= block_rows or chars > BLOCK_CHARS:
                    if begun:
                        # alone: it began behind another one and lies in one block; if other, it ends here too
                        out.append(closed() if other and alone else block())
                    alone = begun and other
                    own, no, begun, chars, turns, roles, texts = key, 0 if other else no + 1, True, 0, [], [], []
                if not gone:
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                    chars += len(text)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if begun:
            yield pa.RecordBatch.from_pylist([block()], schema=arrow)

    return dealt.mapInArrow(run, schema)


def _known(blocks: DataFrame) -> DataFrame:
    """conv_id, part, no, seen: the marks of each block that an earlier block of its conversation has too."""
    marks = blocks.select("conv_id", "part", "no", F.explode("marks").alias("mark"))
    firsts = marks.groupBy("conv_id", "mark").agg(F.min(F.struct("part", "no")).alias("first"), F.count("*").alias("blocks")).where("blocks > 1")
    both = marks.alias("m").join(firsts.alias("f"), F.col("m.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("m.mark") == F.col("f.mark")))
    later = both.where("struct(m.part, m.no) > f.first")
    return later.groupBy("m.conv_id", "m.part", "m.no").agg(F.collect_list("m.mark").alias("seen"))


def _joined(left: DataFrame, right: DataFrame, how: str, *names: str) -> DataFrame:
    """left with the named columns of right, by conversation and block."""
    same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.no") == F.col("r.no"))
    return left.alias("l").join(right.alias("r"), same, how).select("l.*", *(F.col(f"r.{n}") for n in names))


COSTS = "array<long>"


def _summary(row: dict) -> Iterator[dict]:
    """A block's classes, counts and costs from each of its first states to its last ones."""
    seen, rows = set(row["seen"] or ()), row["rows"]
    found = [("d" if seen and x["fault"] in ("", "t") and mark(x["role"], x["text"]) in seen else x["fault"]) for x in rows]
    codes = classes([x["role"] for x in rows], found)
    costs = [c for q in STATES for c in forward(codes, [0 if p == q else FAR for p in STATES])[-1]]
    initials, turns = [x["role"][:1] for x in rows], [x["turn"] for x in rows if x["turn"] is not None]
    yield {
        "conv_id": row["conv_id"], "part": row["part"], "no": row["no"], "codes": codes, "costs": costs, "blank": found.count("b"), "duplicate": found.count("d"),
        "truncated": found.count("t"), "illegal": _illegal(initials), "first": initials[0] if rows else None, "last": initials[-1] if rows else None,
        "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
    }


SUMMARY = f"part int, no int, codes string, costs {COSTS}, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"


def _met(blocks: list[dict]) -> tuple[dict, list[dict]]:
    """Counts and cost of a conversation from its blocks in order, and each block's costs before its first and behind its last row."""
    total = {k: sum(b[k] for b in blocks) for k in ("blank", "duplicate", "truncated", "illegal")}
    some = [b for b in blocks if b["first"] is not None]
    total["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(some, some[1:]))
    timed = [b for b in blocks if b["low"] is not None]
    distinct = sum(b["turns"] for b in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
    total["gaps"] = timed[-1]["high"] - timed[0]["low"] + 1 - distinct if timed else 0
    behind, costs, ahead = [CLOSING], [0, FAR, FAR, FAR], []
    for b in reversed(blocks[1:]):
        behind.append([min(b["costs"][4 * q + to] + behind[-1][to] for to in STATES) for q in STATES])
    for b in blocks:
        ahead.append(costs)
        costs = [min(costs[q] + b["costs"][4 * q + to] for q in STATES) for to in STATES]
    total["cost"] = min(costs[q] + CLOSING[q] for q in STATES)
    clipped = lambda row: [min(FAR, c) for c in row]
    places = [{"part": b["part"], "no": b["no"], "ahead": clipped(a), "behind": clipped(z), "last": b is blocks[-1]} for b, a, z in zip(blocks, ahead, behind[::-1], strict=True)]
    return total, places


def _exits(row: dict) -> Iterator[dict]:
    """For each state before a block the one behind it on the least tight walk; -1 where no tight walk starts."""
    codes, total = row["codes"], row["cost"]
    ahead, behind = forward(codes, row["ahead"]), backward(codes, row["behind"])
    out = []
    for q in STATES:
        tight = ahead[0][q] + behind[0][q] == total and row["ahead"][q] == ahead[0][q]
        out.append(min(walk(codes, ahead, behind, total, {q}, row["last"])[1]) if tight else -1)
    yield {k: row[k] for k in ("conv_id", "part", "no")} | {"exits": out}


def _spelled(row: dict) -> Iterator[dict]:
    """A block's part of the audit, and of the repaired text, from the state that the blocks before it lead to."""
    ahead, behind = forward(row["codes"], row["ahead"]), backward(row["codes"], row["behind"])
    letters, _ = walk(row["codes"], ahead, behind, row["cost"], {row["state"]}, row["last"])
    lines, _ = repaired(letters, [x["role"] for x in row["rows"]], [x["text"] for x in row["rows"]], row["state"])
    yield {k: row[k] for k in ("conv_id", "part", "no")} | {"letters": letters, "lines": len(lines), "body": "\n".join(lines).encode(errors="surrogatepass")}


def _grouped(df: DataFrame, fields: str, one: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """What one() makes of a conversation's small rows in the order of its blocks."""
    arrow, schema = _arrow(df, fields)
    key = F.struct("conv_id").alias("_key")  # groups nulls too

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["no"]))
        return pa.Table.from_pylist([{"conv_id": rows[0]["conv_id"]} | r for r in one(rows)], schema=arrow)

    return df.groupBy(key).applyInArrow(run, schema)


def _streamed(blocks: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256: blocks in order through one digest a conversation, one block in memory at a time."""
    arrow, schema = _arrow(blocks, "audit string, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, begun, letters, sha, lines = None, False, [], hashlib.sha256(), 0
        told = lambda: pa.RecordBatch.from_pylist([{"conv_id": own, "audit": "".join(letters), "repaired_sha256": sha.hexdigest()}], schema=arrow)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if not begun or row["conv_id"] != own:
                    if begun:
                        yield told()
                    own, begun, letters, sha, lines = row["conv_id"], True, [], hashlib.sha256(), 0
                letters.append(row["letters"])
                if row["lines"]:
                    sha.update(b"\n" * bool(lines) + row["body"])
                    lines += row["lines"]
        if begun:
            yield told()

    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(run, schema)


def repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS, damage: bool = True) -> DataFrame:
    """conv_id and the columns of RESULT for every conv_id of conversations (conv_id, turn, role, text).

    damage: the rows are damaged first, as the contract has it; else they are taken as they are. Null conv_ids are one
    conversation. In roles and texts null is one space, so that a null text is blank; null turns come first and make no
    gap. Rows of one turn come in the order of role, the text's first 40 characters and a digest; equal rows are
    duplicates of each other. A conversation without rows has zeros, an empty audit and the digest of nothing. Other
    columns are left out; no rows give no rows.
    """
    rows = damaged(conversations) if damage else conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(False).alias("gone"))
    parts = durable(staged(rows.withColumn("turn", F.col("turn").cast("long")), block_rows), "conversations")
    names = [f.split()[0] for f in RESULT.split(", ")]
    done = parts.where("cost is not null").select("conv_id", *names)

    blocks = _joined(parts.where("cost is null"), _known(parts.where("cost is null")), "left", "seen")
    summaries = durable(mapped(blocks, SUMMARY, _summary), "conversation-blocks")
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def met(rows: list[dict]) -> list[dict]:
        total, places = _met(rows)
        return [total | p for p in places]

    fields = ", ".join(f"{c} long" for c in sums)
    small = summaries.select("conv_id", "part", "no", "costs", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")
    places = durable(_grouped(small, f"{fields}, part int, no int, ahead {COSTS}, behind {COSTS}, last boolean", met), "conversation-places")
    whole = _joined(summaries.select("conv_id", "part", "no", "codes"), places, "inner", "ahead", "behind", "last", "cost")

    def entered(rows: list[dict]) -> list[dict]:
        state, out = 0, []
        for row in rows:
            out.append({"part": row["part"], "no": row["no"], "state": state})
            state = row["exits"][state]
        return out

    entries = _grouped(mapped(whole, f"part int, no int, exits {COSTS}", _exits), "part int, no int, state int", entered)
    ready = _joined(_joined(whole, entries, "inner", "state"), parts.where("cost is null"), "inner", "rows")
    spelled = _streamed(mapped(ready, "part int, no int, letters string, lines long, body binary", _spelled))
    heads = places.where("last").select("conv_id", *sums)
    both = heads.alias("h").join(spelled.alias("s"), F.col("h.conv_id").eqNullSafe(F.col("s.conv_id")))
    return done.unionByName(both.select("h.*", "s.audit", "s.repaired_sha256"))
