"""Conversation structure repair: cheapest edits by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows read, state); the states are those of the automaton for the
role initials ``(s?(ua)+)?``: nothing yet, after s, after u, after a. Keep, Rerole, Delete
and Insert are its edges. A forward and a reverse heap settle nodes by cost until their
tops together exceed the best crossing, so that all crossings of equal cost are seen; of
these the one with the least concatenated audit wins. At each node equal costs keep the
least audit so far: two of equal cost never start one another, as they differ in a row's
letter before either ends.

Spread over a cluster: rows are dealt by ranges of (conversation, turn, ..), so a
conversation of any length lies on consecutive tasks, and are read in blocks of at most
``BLOCK_ROWS`` different rows. A conversation that lies whole in one block is solved at once.
Other blocks are solved for every entry and exit state and leave sixteen costs and ranks; one
pass from the last block back chooses the exits (a rank is enough to compare audits, as no
block but the last ends in an insertion), and the edits follow from the chosen pair.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from cliplake.llm.tables import stash

BLOCK_ROWS, BLOCK_CHARS = 256, 1 << 20
# fixed values of the contract
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)  # the state after the one role, user or assistant, that may follow
BEFORE = ((), (), (NOTHING, SYSTEM, ASSISTANT), (USER,))
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {USER: "u", ASSISTANT: "a"}
COMPLETE = (NOTHING, ASSISTANT)
CLOSING = ("", "II", "I", "")  # insertions that complete a conversation, by state
PAIRS = ("su", "ua", "au")

_LONGS = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")
_EDIT = pa.struct([("edit", pa.string()), ("copies", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_UNIT = pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("fresh", pa.bool_())])
BLOCKS = pa.schema(
    [
        ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("alone", pa.bool_()),
        *[(c, pa.int64()) for c in _LONGS], ("first", pa.string()), ("last", pa.string()), ("cost", pa.int64()),
        ("edits", pa.list_(_EDIT)), ("units", pa.list_(_UNIT)), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())),
    ]
)
REPORT = pa.schema(
    [
        *[(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        ("audit", pa.string()), ("repaired_sha256", pa.string()),
    ]
)
FAR = 1 << 60


# ------------------------------------------------------------------ lattice
def fault(text: str, fresh: bool) -> str:
    """The first fault of a row: ``blank``, ``duplicate``, ``truncated`` or none (empty)."""
    spoken = text.rstrip(" \t\n\v\f\r")
    if not spoken:
        return "blank"
    if not fresh:
        return "duplicate"
    return "" if spoken[-1] in ".!?" else "truncated"


def steps(units: Sequence[tuple]) -> list[tuple]:
    """Lattice steps of ``(role, text, n, fresh)`` units: ``(initial, extra cost)`` for a row that
    may stay, ``(None, n)`` for ``n`` rows that must go."""
    out = []
    for role, text, n, fresh in units:
        kind = fault(text, fresh)
        if kind in ("blank", "duplicate"):
            out.append((None, n))
            continue
        out.append((role[:1], TRUNCATED if kind else 0))
        if n > 1:
            out.append((None, n - 1))
    return out


def _moves(step: tuple, state: int) -> Iterator[tuple[int, int, str]]:
    """Edges of one step from a state: ``(next state, cost, letters)``."""
    initial, extra = step
    if initial is None:
        yield state, DELETE * extra, "D" * extra
        return
    yield state, DELETE, "D"
    to = FOLLOWS[state]
    yield to, REROLE + extra, "R"
    if initial == INITIAL[to]:
        yield to, KEEP + extra, "K"
    elif initial == "s" and state == NOTHING:
        yield SYSTEM, KEEP + extra, "K"


def _moves_into(step: tuple, state: int) -> Iterator[tuple[int, int, str]]:
    """The same edges by their end: ``(state before, cost, letters)``."""
    for before in {state, *BEFORE[state], NOTHING}:
        for to, cost, letters in _moves(step, before):
            if to == state:
                yield before, cost, letters


def cheapest(todo: Sequence[tuple], entry: int, exits: Sequence[int], may_insert_last: bool = True) -> tuple[int, str] | None:
    """Least cost and audit from ``entry`` before the first step to one of ``exits`` after the
    last, or None. Without ``may_insert_last`` nothing is inserted after the last step."""
    n = len(todo)
    inserting = lambda i: i < n or may_insert_last

    def onward(i: int, state: int) -> Iterator[tuple]:
        if i < n:
            for to, cost, letters in _moves(todo[i], state):
                yield (i + 1, to), cost, letters
        if inserting(i):
            yield (i, FOLLOWS[state]), INSERT, "I"

    def back(i: int, state: int) -> Iterator[tuple]:
        if i:
            for before, cost, letters in _moves_into(todo[i - 1], state):
                yield (i - 1, before), cost, letters
        if inserting(i):
            for before in BEFORE[state]:
                yield (i, before), INSERT, "I"

    best: list = [FAR, ""]

    def cross(cost: int, audit: str) -> None:
        if (cost, audit) < tuple(best):
            best[:] = cost, audit

    # per side: labels (cost, audit), settled nodes, heap of (cost, rows from the side's start, node);
    # edges of cost 0 change the rows read, so equal costs settle in the order of the lattice
    sides = []
    for starts in ([(0, entry)], [(n, q) for q in exits]):
        labels = {node: (0, "") for node in starts}
        sides.append((labels, set(), [(0, 0, node) for node in starts]))
    while sides[0][2] and sides[1][2] and sides[0][2][0][0] + sides[1][2][0][0] <= best[0]:
        reverse = sides[1][2][0][0] < sides[0][2][0][0]
        labels, done, heap = sides[reverse]
        others, finished, _ = sides[not reverse]
        cost, _, node = heapq.heappop(heap)
        if node in done or labels[node][0] != cost:
            continue
        done.add(node)
        audit = labels[node][1]
        if node in finished:
            other, rest = others[node]
            cross(cost + other, rest + audit if reverse else audit + rest)
        for to, more, letters in (back if reverse else onward)(*node):
            label = (cost + more, letters + audit if reverse else audit + letters)
            if to in finished:
                other, rest = others[to]
                cross(label[0] + other, rest + label[1] if reverse else label[1] + rest)
            if to not in done and label < labels.get(to, (FAR, "")):
                labels[to] = label
                heapq.heappush(heap, (label[0], n - to[0] if reverse else to[0], to))
    return None if best[0] == FAR else (best[0], best[1])


def table_of(todo: Sequence[tuple]) -> tuple[list[int], list[int]]:
    """Costs and ranks of the audits from every entry state to every exit state."""
    costs, ranks = [], []
    for entry in range(4):
        found = [cheapest(todo, entry, [q], may_insert_last=False) for q in range(4)]
        order = sorted(f[1] for f in found if f)
        costs += [f[0] if f else FAR for f in found]
        ranks += [order.index(f[1]) if f else len(order) for f in found]
    return costs, ranks


def edits_of(units: Sequence[tuple], audit: str, entry: int = NOTHING) -> tuple[list[dict], int]:
    """The audit as edits with the rows they leave or delete, and the state after them."""
    out, state, at = [], entry, 0

    def insertions() -> None:
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            state = FOLLOWS[state]
            out.append({"edit": "I", "copies": 1, "role": ROLE[state], "text": ""})
            at += 1

    for (role, text, n, fresh) in units:
        for initial, count in steps([(role, text, n, fresh)]):
            insertions()
            if initial is None or audit[at] == "D":
                copies = count if initial is None else 1
                out.append({"edit": "D", "copies": copies, "role": role, "text": text})
                at += copies
                continue
            kept = audit[at] == "K"
            state = SYSTEM if kept and initial == "s" else FOLLOWS[state]
            out.append({"edit": audit[at], "copies": 1, "role": role if kept else ROLE[state], "text": text})
            at += 1
    insertions()
    return out, state


# ------------------------------------------------------------------ tallies
def tally(units: Sequence[tuple], turns: Sequence[int | None]) -> dict:
    """Turns, faults and illegal neighbours of consecutive units of one conversation."""
    known = [t for t in turns if t is not None]
    out = dict(low=min(known, default=None), high=max(known, default=None), turns=len(set(known)), blank=0, duplicate=0, truncated=0, illegal=0)
    last = None
    for role, text, n, fresh in units:
        kind, initial = fault(text, fresh), role[:1]
        if kind == "blank":
            out["blank"] += n
        else:
            out["duplicate"] += n if kind == "duplicate" else n - 1
            out["truncated"] += kind == "truncated"
        out["illegal"] += n - 1 + (last is not None and last + initial not in PAIRS)
        last = initial
    return out | {"first": units[0][0][:1], "last": last}


def together(a: dict, b: dict) -> dict:
    """The tally of two stretches, the second right after the first."""
    both = {k: a[k] + b[k] for k in ("turns", "blank", "duplicate", "truncated", "illegal")}
    both["turns"] -= a["high"] is not None and a["high"] == b["low"]
    both["illegal"] += a["last"] + b["first"] not in PAIRS
    lows, highs = ([x for x in (a[k], b[k]) if x is not None] for k in ("low", "high"))
    return both | {"low": min(lows, default=None), "high": max(highs, default=None), "first": a["first"], "last": b["last"]}


TALLY = (*_LONGS, "first", "last")


# ------------------------------------------------------------------ passes
def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conv_id, turns, units, starts, ends)``: blocks in order. The first conversation of a task
    may have started before and the last may go on, so neither start nor end is claimed."""
    conv, turns, units, chars, starts, seen = None, [], [], 0, False, False
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "fresh")]
        for who, turn, *unit in zip(*columns):
            if units and (who != conv or len(units) >= BLOCK_ROWS or chars + len(unit[1]) > BLOCK_CHARS):
                yield conv, turns, units, starts, who != conv
                starts, turns, units, chars = who != conv, [], [], 0
            conv, seen = who, True
            turns.append(turn)
            units.append(tuple(unit))
            chars += len(unit[1])
    if seen:
        yield conv, turns, units, starts, False


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()

    def rows() -> Iterator[dict]:
        for seq, (conv, turns, units, starts, ends) in enumerate(_cut(batches)):
            row = dict(conv_id=conv, part=part, seq=seq, alone=starts and ends) | tally(units, turns)
            todo = steps(units)
            if row["alone"]:
                row["cost"], audit = cheapest(todo, NOTHING, COMPLETE)
                row["edits"] = edits_of(units, audit)[0]
            else:
                row["costs"], row["ranks"] = table_of(todo)
                row["units"] = [dict(zip(("role", "text", "n", "fresh"), u)) for u in units]
            yield row

    yield from _batched(rows(), BLOCKS)


def _choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exits per entry state, from the last block of every conversation back."""
    conv, rest, fresh = None, [], True
    for pdf in frames:
        out = []
        for who, part, seq, costs, ranks in zip(pdf["conv_id"], pdf["part"], pdf["seq"], pdf["costs"], pdf["ranks"]):
            who = None if pd.isna(who) else int(who)
            closes = fresh or who != conv
            if closes:
                conv, rest, fresh = who, [INSERT * len(c) for c in CLOSING], False
            found = [min((int(costs[4 * e + q]) + rest[q], int(ranks[4 * e + q]), q) for q in range(4)) for e in range(4)]
            rest = [f[0] for f in found]
            out.append((part, seq, closes, [f[2] for f in found]))
        yield pd.DataFrame(out, columns=["part", "seq", "closes", "exits"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of the blocks of long conversations, in order, entering each where the last was left."""

    def rows() -> Iterator[dict]:
        state = NOTHING
        for batch in batches:
            for row in batch.to_pylist():
                units = [(u["role"], u["text"], u["n"], u["fresh"]) for u in row.pop("units")]
                exits, closes = row.pop("exits"), row.pop("closes")
                row["cost"], audit = cheapest(steps(units), state, [exits[state]], may_insert_last=False)
                left = exits[state]
                if closes:
                    audit += CLOSING[left]
                    row["cost"] += INSERT * len(CLOSING[left])
                row["edits"] = edits_of(units, audit, state)[0]
                state = NOTHING if closes else left
                yield row | {"units": None, "costs": None, "ranks": None}

    yield from _batched(rows(), BLOCKS, 16)


# ------------------------------------------------------------------ operator
def damage(conversations: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text, copies)`` as the contract damages them, by
    crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``,
    3 doubles it, 4 sets its role to user. A null role, text, or id or turn inside the key is one
    space; ids and turns themselves stay null."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("code"),
    ).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("code") == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """Blocks of repaired conversations from ``(conv_id, turn, role, text, copies)``.

    One row per block, in order of ``(part, seq)`` within a conversation; the edits of a
    conversation are those of its blocks end to end. ``edits`` names the edit (K, R, D, I), how
    many equal rows it holds for (only D takes more than one), and role and text, after
    the edit unless deleted. ``cost`` and the tallies (lowest and highest turn, different
    turns, faults, illegal neighbours, first and last initial) are the block's own; ``alone``
    says that a conversation has no other block.

    Rows are taken by turn, nulls first; rows of one turn by role, then by the SHA-256 of their text,
    equal rows next to each other. A duplicate has the role and text of an earlier row of its
    conversation. A null conv_id is a conversation; null roles and texts must be replaced before.
    Any role may stand there; one with no or another initial than s, u or a can't be kept. Whole
    texts are carried; an empty table gives no blocks.
    """
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    units = rows.groupBy("conv_id", "turn", "role", "digest", "text").agg(F.sum("copies").alias("n"))
    firsts = rows.groupBy("conv_id", "role", "digest").agg(
        F.min("turn").alias("low"), F.max(F.col("turn").isNull().cast("int")).alias("unset")
    )
    u, f = units.alias("u"), firsts.alias("f")
    same = F.col("u.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("u.role") == F.col("f.role")) & (F.col("u.digest") == F.col("f.digest"))
    fresh = F.when(F.col("unset") == 1, F.col("turn").isNull()).otherwise(F.col("turn") == F.col("low"))
    order = ["conv_id", "turn", "role", "digest"]
    flagged = u.join(f, same).select(*[F.col(f"u.{c}").alias(c) for c in (*order, "text", "n")], fresh.alias("fresh"))
    dealt = flagged.repartitionByRange(*order).sortWithinPartitions(*order)
    solved = stash(dealt.drop("digest").mapInArrow(_solve, from_arrow_schema(BLOCKS)))
    long = solved.where("NOT alone")
    exits = (
        long.select("conv_id", "part", "seq", "costs", "ranks")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
        .mapInPandas(_choose, "part int, seq int, closes boolean, exits array<int>")
    )
    finished = (
        long.join(exits, ["part", "seq"])
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "seq")
        .mapInArrow(_finish, from_arrow_schema(BLOCKS))
    )
    done = [c for c in solved.columns if c not in ("units", "costs", "ranks")]
    return solved.where("alone").select(*done).union(finished.select(*done))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of conversations with several blocks, which stream through in order."""

    def report(conv: int | None, sums: dict, cost: int, audit: list[str], digest) -> dict:
        gaps = 0 if sums["low"] is None else sums["high"] - sums["low"] + 1 - sums["turns"]
        counts = {k: sums[k] for k in ("blank", "duplicate", "truncated", "illegal")}
        return dict(conv_id=conv, gaps=gaps, cost=cost, audit="".join(audit), repaired_sha256=digest.hexdigest()) | counts

    def rows() -> Iterator[dict]:
        conv, sums, cost, audit, digest, first = None, None, 0, [], None, True
        for batch in batches:
            for row in batch.to_pylist():
                own = {k: row[k] for k in TALLY}
                if sums is None or row["conv_id"] != conv:
                    if sums is not None:
                        yield report(conv, sums, cost, audit, digest)
                    conv, sums, cost, audit, digest, first = row["conv_id"], own, 0, [], hashlib.sha256(), True
                else:
                    sums = together(sums, own)
                cost += row["cost"]
                for e in row["edits"]:
                    audit.append(e["edit"] * e["copies"])
                    if e["edit"] != "D":
                        digest.update(("" if first else "\n").encode() + f"{e['role']}:{e['text']}".encode())
                        first = False
        if sums is not None:
            yield report(conv, sums, cost, audit, digest)

    yield from _batched(rows(), REPORT, 16)


def reports(blocks: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repair`: tallies, cost, audit and the digest of the
    repaired ``role:text`` lines. A digest is sequential, so the blocks of a long conversation
    stream through one task; nothing but the audit grows there."""
    kept = F.filter("edits", lambda e: e["edit"] != "D")
    lines = F.array_join(F.transform(kept, lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n")
    letters = F.transform("edits", lambda e: F.repeat(e["edit"], e["copies"].cast("int")))
    alone = blocks.where("alone").select(
        "conv_id",
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost",
        F.array_join(letters, "").alias("audit"),
        F.sha2(lines, 256).alias("repaired_sha256"),
    )
    ordered = blocks.where("NOT alone").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return alone.union(ordered.mapInArrow(_digest, from_arrow_schema(REPORT)))


def with_lost(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """Also the conversations that lost all their rows: zeros, empty audit, digest of nothing."""
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("__id")).distinct()
    zeros = {c: F.lit(0) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = zeros | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}

    def value(name: str, other: Column) -> Column:
        return F.coalesce(F.col(name), other).alias(name)

    return ids.join(found, F.col("__id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("__id").alias("conv_id"), *[value(n, v) for n, v in empty.items()]
    )
