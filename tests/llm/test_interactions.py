from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from llm_fixtures import documents, shipped  # noqa: F401
from cliplake.llm import interactions as X

LABELS = "doc_id bigint, quality int, toxic int"


def fails(doc_id, text, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = ""
    if len(words) < 100:
        out += "A"
    if 100 * len(set(words)) < 80 * len(words):
        out += "B"
    if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
        out += "C"
    if re.search(r"[#$%&*|]", text):
        out += "D"
    if doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in rows):
        out += "E"
    return out


def brute(rows, labels):
    """Run every order over every document."""
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(fails(r[0], r[1] or "", rows), r[0]) for r in rows if (r[2] or "") == part]
        good = {d for d, q, _ in labels if q == 1 and d is not None}  # a null id has no label
        toxic = {d for d, _, t in labels if t == 1 and d is not None}
        for order in itertools.permutations("ABCDE"):
            alive = list(mine)
            for step, f in enumerate(order, 1):
                hit = [m for m in alive if f in m[0]]
                before = len([m for m in mine if f in m[0]]) - len(hit)
                alive = [m for m in alive if f not in m[0]]
                out[part, "".join(order), step] = [
                    len(alive), len(hit), before, len([m for m in mine if m[0] == f]),
                    len([m for m in hit if m[1] in good]), len([m for m in hit if m[1] in toxic]),
                ]
        for f in "ABCDE":
            steps = [(part, "".join(o), o.index(f) + 1) for o in itertools.permutations("ABCDE")]
            total = sum(out[s][1] for s in steps)
            for s in steps:
                out[s].append(total)
    return out


def check(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("mask", F.lit("x")).withColumn("n", F.lit(1))
    got = X.filter_interactions(docs, spark.createDataFrame(labels, LABELS)).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows})
    for r in got:
        assert [r[c] for c in X.COUNTERS] == want[r.part, r.filter_order, r.step]


@pytest.mark.parametrize("seed", range(2))
def test_against_all_orders(spark, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        words = [rng.choice(["Alpha", "beta", "GAMMA", f"w{rng.randint(0, 400)}", "a|b", "été"][: rng.randint(3, 6)]) for _ in range(rng.choice([3, 99, 100, 130]))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    rows = [(rng.randint(0, 40), rng.choice(texts), rng.choice(["en", "de", None])) for _ in range(60)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 40, 2)] + [(2, 1, 0), (2, 0, 1)]
    check(spark, rows, labels)


def test_special_rows(spark):
    rows = [
        (1, None, "en"), (2, "", "en"), (2, "", "en"), (None, "", None), (None, "x", ""), (3, "x", "de"), (3, "x", "fr"), (4, "x", "de"),
        (5, "Ab " * 400_000, "en"), (6, " ".join(f"w{i}" for i in range(200_000)), "en"), (5, "z", "en"), (9, "#", "en"),
    ]
    check(spark, rows, [(None, 1, 1), (3, 1, 0), (3, None, 1), (9, 0, None)])


def test_empty_tables(spark, documents):  # noqa: F811
    assert X.filter_interactions(documents([]), spark.createDataFrame([], LABELS)).count() == 0


def test_fields_hold_large_counts():
    """Sums of counts near the limit stay in their fields."""
    n = 2**63 // 120 // 3
    total = sum(n * X.packed(m, True, True) for m in (0, 5, 31))
    fields = X.unpack(total)
    assert (fields[:, :, 0] >= n).all() and int(fields.max()) < 2**63
    want = sum(n * X.outcomes(m, True, True).astype(object) for m in (0, 5, 31))
    assert (fields.astype(object) == want).all()
