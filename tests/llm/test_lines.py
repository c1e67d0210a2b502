from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from llm_fixtures import documents, shipped  # noqa: F401
from cliplake.llm import lines as L

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, num=4, den=5):
    seen, gone = [], set()
    for i, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for n, line in enumerate(text.split("\n")):
            s = set(re.findall(r"[^\x20\x09-\x0D]+", line.translate(LOWER)))
            if not s:
                continue
            if any(den * len(s & t) >= num * len(s | t) for t in seen):
                gone.add((i, n))
            seen.append(s)
    return sorted(gone)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)] + ["The", "the", "of", "é"] * 5
    base = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 9, 20, 50]))] for _ in range(25)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randint(1, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w) if rng.random() < 0.95 else "")
        rows.append((i * 13 % 997, "\n".join(out)))
    return rows


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_removed_lines_are_those_of_all_pairs(documents, monkeypatch):
    rows = corpus(1)
    assert found(L.repeated_lines(documents(rows))) == brute(rows)
    rows = corpus(2)
    assert found(L.repeated_lines(documents(rows))) == brute(rows)
    monkeypatch.setattr(L, "CHUNK", 3)  # every word is frequent, every group large
    monkeypatch.setattr(L, "SMALL", 1)
    assert found(L.repeated_lines(documents(rows))) == brute(rows)
    assert found(L.repeated_lines(documents(rows), 9, 10)) == brute(rows, 9, 10)


def test_texts_follow(documents):
    rows = [(1, "a b c d e\n\nq"), (2, "A b c d e\nz y"), (3, "a b c d e"), (4, None), (5, ""), (6, "\n"), (None, "a b c d e"), (8, "z y\nz y\nnew\n")]
    out = {r.doc_id: (r.text, r.n_chars) for r in L.dedup_lines(documents(rows)).collect()}
    assert out == {1: ("a b c d e\n\nq", 12), 2: ("z y", 3), 4: (None, None), 5: ("", 0), 6: ("\n", 1), None: ("a b c d e", 9), 8: ("new\n", 4)}
    report = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in L.line_report(documents(rows)).collect()}
    assert report[8] == (4, 2, [0, 1]) and report[4] == (0, 0, []) and report[3] == (1, 1, [0]) and report[6] == (2, 0, [])


def test_repeated_and_negative_ids_and_empty_tables(documents):
    assert found(L.repeated_lines(documents([]))) == []
    assert found(L.repeated_lines(documents([(-5, "x y z"), (7, "x y z"), (7, "x y z")]))) == [(7, 0)]
    big = 2**60
    assert found(L.repeated_lines(documents([(big, "x y z"), (big + 1, "k\nx y z"), (-big, "u")]))) == [(big + 1, 1)]
    long = " ".join(f"t{i}" for i in range(40_000))
    assert found(L.repeated_lines(documents([(1, long), (2, "other " + long)]))) == [(2, 0)]


def test_many_lines_of_one_text_and_clashing_names(documents):
    """Linear in the lines of a text: half of 40,000 lines repeat."""
    long = "\n".join(f"line number{i // 2} of{i // 2} a{i // 2} log{i // 2}" for i in range(40_000))
    df = documents([(1, long), (2, "kept as it is\n\n kept too"), (3, None)])
    df = df.selectExpr("*", "1 AS row", "2 AS gone", "'x' AS d", "3 AS parts", "4 AS cut")
    out = L.dedup_lines(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "\n".join(long.split("\n")[::2]) and got[2].text == "kept as it is\n\n kept too" and got[3].text is None
    assert (got[1].row, got[1].gone, got[1].d, got[1].parts, got[1].cut) == (1, 2, "x", 3, 4)


def test_rows_that_repeat_an_id_keep_all_their_lines(documents):
    rows = [(7, "a b c d e"), (7, "v w x y z"), (9, "a b c d e f"), (10, "v w x y z u")]
    assert found(L.repeated_lines(documents(rows))) == [(9, 0), (10, 0)]


class Held:
    def __init__(self, value):
        self.value = value


def dealt(rows, monkeypatch):
    """The rows of groups that the prefixes of the lines of ``rows`` are dealt out to."""
    monkeypatch.setattr(L, "CHUNK", 3)
    monkeypatch.setattr(L, "WIDE", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])
    counts = np.zeros(1 << L.BITS, np.int32)
    for pieces in L._counts(iter([batch.select(["text"])])):
        for piece, own in zip(pieces.column(0).to_pylist(), pieces.column(1).to_pylist()):
            counts[piece * L.PIECE : (piece + 1) * L.PIECE] += np.frombuffer(own, np.int32)
    lines = list(L._described(Held(counts), 4, 5)(iter([batch])))
    return L._dealt(Held(counts), 4, 5, None, None), lines


def test_lines_of_a_frequent_word_all_meet(monkeypatch):
    """Chunks of three: each two lines meet in a group, and groups stay small."""
    deal, lines = dealt([(i, "common") for i in range(20)], monkeypatch)
    out = np.concatenate(list(deal(iter(lines))))
    met, group = set(), {}
    for r in out:
        group.setdefault((int(r["group"])), []).append((int(r["key"][0]) >> 32, int(r["own"])))
    for rows in group.values():
        for a, own in rows:
            met |= {(a, b) for b, other in rows if a < b and (own & 1 or own >> 2 != other >> 2)}
    word = max(sum(1 for a, _ in rows) for rows in group.values())
    assert met >= {(a, b) for a in range(20) for b in range(a + 1, 20)} and word < 20


def test_rows_travel_packed(monkeypatch):
    deal, lines = dealt([(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(30))) for i in range(200)], monkeypatch)
    plain = np.concatenate(list(deal(iter(lines))))
    monkeypatch.setattr(L, "WIDE", 1 << 19)
    values = list(L._in_buckets(deal, 4)(iter(lines)))
    assert sum(v.num_rows for v in values) <= len(plain) // L.PACK + 4
    packed = np.concatenate([L._unpacked(v.column("lines"), L._ROW)[0] for v in values])
    assert sorted(packed.tobytes()[i * 52 : i * 52 + 52] for i in range(len(packed))) == sorted(plain.tobytes()[i * 52 : i * 52 + 52] for i in range(len(plain)))
