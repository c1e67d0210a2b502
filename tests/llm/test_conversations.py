from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from llm_fixtures import shipped  # noqa: F401
from cliplake.llm import conversations as C

ROWS = "conv_id bigint, turn bigint, role string, text string"


def exhaustive(todo):
    """Least (cost, audit) over all edit scripts with at most two insertions per gap."""
    best = None
    options = [[("D" * x, 2 * x, None)] if i is None else [("D", 2, None), ("R", 1 + x, "u"), ("R", 1 + x, "a"), ("K", x, i)] for i, x in todo]
    inserts = ["", "u", "a", "ua", "au"]
    for picks in itertools.product(*options):
        for gaps in itertools.product(inserts, repeat=len(todo) + 1):
            audit = "I" * len(gaps[0]) + "".join(p[0] + "I" * len(g) for p, g in zip(picks, gaps[1:]))
            roles = gaps[0] + "".join((p[2] or "") + g for p, g in zip(picks, gaps[1:]))
            if any(p[0] == "K" and p[2] == "" for p in picks):
                continue
            rest = roles.removeprefix("s")
            if roles and (not rest or rest != "ua" * (len(rest) // 2)):
                continue
            found = (sum(p[1] for p in picks) + 5 * sum(map(len, gaps)), audit)
            best = found if best is None else min(best, found)
    return best


def test_cheapest_is_the_least_of_all_scripts():
    rng = random.Random(3)
    for _ in range(150):
        todo = [(None, rng.randint(1, 3)) if rng.random() < 0.2 else (rng.choice("suaat") if rng.random() < 0.95 else "", rng.choice([0, 0, 5])) for _ in range(rng.randint(0, 3))]
        assert C.cheapest(todo, C.NOTHING, C.COMPLETE) == exhaustive(todo)


def by_rows(units):
    """Best labels row by row, insertions before each row (the reference for long conversations)."""
    far = (1 << 60, "")
    labels = [(0, ""), far, far, far]
    put = lambda new, q, label: new.__setitem__(q, min(new[q], label))

    def inserted(v):
        v = list(v)
        for q in (0, 1, 3, 2):
            put(v, C.FOLLOWS[q], (v[q][0] + 5, v[q][1] + "I"))
        return v

    for role, text, n, fresh in units:
        for initial, extra in C.steps([(role, text, n, fresh)]):
            v, new = inserted(labels), [far] * 4
            for q, (cost, audit) in enumerate(v):
                if initial is None:
                    put(new, q, (cost + 2 * extra, audit + "D" * extra))
                    continue
                put(new, q, (cost + 2, audit + "D"))
                to = C.FOLLOWS[q]
                put(new, to, (cost + 1 + extra, audit + "R"))
                if initial == C.INITIAL[to]:
                    put(new, to, (cost + extra, audit + "K"))
                if initial == "s" and q == 0:
                    put(new, 1, (cost + extra, audit + "K"))
            labels = new
    v = inserted(labels)
    return min(v[0], v[3])


def expected(rows):
    """Report of one conversation from its rows (turn, role, text) after damage, in order."""
    seen, units = set(), []
    counts = dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in rows:
        fresh = (role, text) not in seen
        seen.add((role, text))
        kind = C.fault(text, fresh)
        if kind:
            counts[kind] += 1
        units.append((role, text, 1, fresh))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = by_rows(units)
    letters, roles, lines = [x for x in audit if x != "D"], [], []
    edits, _ = C.edits_of(units, audit)
    for e in edits:
        if e["edit"] != "D":
            roles.append(e["role"][:1])
            lines.append(f"{e['role']}:{e['text']}")
    assert len(letters) == len(lines)
    whole = "".join(roles).removeprefix("s")
    assert whole == "ua" * (len(whole) // 2)
    return dict(
        gaps=max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        illegal=sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        cost=cost, audit=audit, repaired_sha256=hashlib.sha256("\n".join(lines).encode()).hexdigest(), **counts,
    )


def damaged(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        code = zlib.crc32(key.encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else text.translate({ord(x): None for x in ".!?"}) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def compare(spark, rows):
    given = spark.createDataFrame(rows, ROWS).withColumn("edits", F.lit(1)).repartition(5)
    got = {r.conv_id: r.asDict() for r in C.with_lost(C.reports(C.repair(C.damage(given))), given).collect()}
    after = damaged(rows)
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        mine = [r[1:] for r in after if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        if mine:
            assert {k: v for k, v in row.items() if k != "conv_id"} == expected(mine), conv
        else:
            assert (row["cost"], row["audit"], row["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


def conversation(rng, conv, n):
    roles = ["system", *["user", "assistant"] * n] if rng.random() < 0.3 else ["user", "assistant"] * n
    out = []
    for i in range(n):
        text = rng.choice(["Yes.", "No!", "and so on", " \n", f"Answer {rng.randint(0, 9)}?", f"word {i} without end"])
        out.append((conv, i + rng.choice([0, 0, 0, 1]), roles[i] if rng.random() < 0.8 else rng.choice(["user", "tool", "assistant"]), text))
    return out


def test_short_conversations(spark):
    rng = random.Random(11)
    compare(spark, [r for conv in range(120) for r in conversation(rng, conv, rng.randint(1, 9))])


def test_a_conversation_over_many_tasks_and_blocks(spark):
    rng = random.Random(12)
    rows = conversation(rng, 7, 1500) + conversation(rng, 8, 3) + [(9, 4, "user", "Same.")] * 40
    compare(spark, rows)
    given = spark.createDataFrame(rows, ROWS)
    blocks = C.repair(C.damage(given)).where("conv_id = 7")
    assert blocks.count() > 4 and blocks.where("alone").count() == 0


def test_special_rows(spark):
    long = "word " * 300_000 + "end."
    rows = [
        (1, 0, None, None), (1, None, "user", "Hi."), (1, None, "assistant", "Ho."), (None, 3, "user", "Who?"), (None, None, "user", "a"),
        (2, 0, "user", "A."), (2, 0, "user", "A."), (2, 1, "", "B."), (3, 5, "user", long), (3, 6, "assistant", long), (4, 1, "system", "S."),
        (5, 2, "usher", "U."), (5, 3, "user", "naïve…"), *[(c, 0, "user", "Only.") for c in range(100, 140)],
    ]
    compare(spark, rows)


def test_empty_table(spark):
    given = spark.createDataFrame([], ROWS)
    assert C.with_lost(C.reports(C.repair(C.damage(given))), given).count() == 0


@pytest.mark.parametrize("cut", [1, 3, 5])
def test_ranks_compare_audits(cut):
    """Tables of blocks chosen from the end give what one lattice gives."""
    rng = random.Random(cut)
    for _ in range(40):
        todo = [(rng.choice("suat"), rng.choice([0, 5])) if rng.random() < 0.8 else (None, 1) for _ in range(8)]
        pieces = [todo[i : i + cut] for i in range(0, len(todo), cut)]
        rest, chosen = [5 * len(c) for c in C.CLOSING], []
        for piece in reversed(pieces):
            costs, ranks = C.table_of(piece)
            found = [min((costs[4 * e + q] + rest[q], ranks[4 * e + q], q) for q in range(4)) for e in range(4)]
            rest = [f[0] for f in found]
            chosen.insert(0, [f[2] for f in found])
        state, audit = 0, ""
        for piece, exits in zip(pieces, chosen):
            audit += C.cheapest(piece, state, [exits[state]], may_insert_last=False)[1]
            state = exits[state]
        assert (rest[0], audit + C.CLOSING[state]) == C.cheapest(todo, C.NOTHING, C.COMPLETE)
