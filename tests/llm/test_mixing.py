from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from llm_fixtures import documents, shipped  # noqa: F401
from cliplake.llm import mixing as M


def targets(sizes, cap=3):
    """Share by weight, cut at the cap, share what is left again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}é"[: rng.randint(2, 9)] + str(i): rng.choice([0, 3, 50, 4000]) for i in range(9)} | {None: 70}
    df = M.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"))
    want = targets(sizes)
    got = {r.source: r.target for r in df.collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def corpus(seed, n=900):
    rng = random.Random(seed)
    words = lambda k: " ".join("w" for _ in range(k))
    return [(i, words(rng.choice([1, 2, 5, 9, 30])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]


def test_mix(spark, documents):
    rows = corpus(5) + [(5000, None, "a"), (5001, "", "z"), (None, "one two", "b")]
    df = documents(rows)
    got = M.mix_sources(df).collect()
    assert len(got) == len(rows)
    sums, taken = {}, {}
    for r in got:
        assert 0 <= r.copies <= 3
        sums[r.source] = sums.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    want = targets(sums)
    for r in got:
        assert r.source_size == sums[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert abs(taken[r.source] - r.target) <= 30
    again = M.mix_sources(df.repartition(7, F.rand())).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(got, key=key) == sorted(again, key=key)
    out = M.mixed_documents(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)


def test_expected_copies(documents):
    """Documents of one source are taken about equally often, whatever their size."""
    rows = [(i, "w " * (1 + i % 10), "a") for i in range(3000)] + [(10_000 + i, "w " * 40, "b") for i in range(300)]
    got = [r for r in M.mix_sources(documents(rows)).collect() if r.source == "a"]
    rho = got[0].target / got[0].source_size
    small = [r.copies for r in got if r["size"] <= 5]
    large = [r.copies for r in got if r["size"] > 5]
    assert abs(sum(small) / len(small) - rho) < 0.06 and abs(sum(large) / len(large) - rho) < 0.06


def test_repeated_rows_and_empty_tables(documents):
    assert M.mix_sources(documents([])).count() == 0
    got = M.mix_sources(documents([(1, "a b", "x")] * 5 + [(2, "c", "y")] * 3)).collect()
    # 10 and 3 words at weights 1 and 2: y stops at 9 words, x shares the other 4
    assert sorted((r.doc_id, r.copies) for r in got) == [(1, 0)] * 3 + [(1, 1)] * 2 + [(2, 3)] * 3
    assert {r.copies for r in M.mix_sources(documents([(1, None, None), (2, "", "q")])).collect()} == {0}


def test_many_repeats_of_one_document(documents):
    """Copies are spread over the repeats, so a source meets its target to within a row."""
    rows = [(1, "w " * 7, "a")] * 2500 + [(i, "w " * (1 + i % 9), "b") for i in range(10, 900)] + [(2, None, "a")] * 3
    df = documents(rows)
    got = M.mix_sources(df).collect()
    assert len(got) == len(rows)
    for source, most in (("a", 7), ("b", 9)):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= most
    assert len({r.copies for r in got if r.doc_id == 1}) == 2
    out = M.mixed_documents(df).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in out} == {s: sum(r.copies for r in got if r.source == s) for s in "ab"}


def test_repeats_with_other_texts_and_clashing_names(documents):
    df = documents([(1, f"w {i}", "a") for i in range(40)] + [(1, "w w", "a")] * 40 + [(9, "w " * 400, "b")])
    df = df.withColumn("row", F.lit(1)).withColumn("print", F.lit(None).cast("string")).withColumn("copies", F.lit("x"))
    key = lambda r: repr(tuple(r))
    got = sorted(M.mixed_documents(df).collect(), key=key)
    assert got == sorted(M.mixed_documents(df.repartition(5, F.rand())).collect(), key=key)
    assert M.mixed_documents(df).columns == df.columns
    copies = {}
    for r in got:
        copies[r.text] = copies.get(r.text, 0) + 1
    assert sum(copies.values()) == sum(r.copies for r in M.mix_sources(df).collect())
    assert all(copies.get(f"w {i}", 0) <= 3 for i in range(40)) and copies.get("w w", 0) <= 120
