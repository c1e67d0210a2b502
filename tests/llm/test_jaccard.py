from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import documents, shipped  # noqa: F401
from cliplake.llm import jaccard as J
from cliplake.llm.components import components
from cliplake.llm.text import shingle_sets, slices

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return sorted((i, len(shingles(t, k)), None if i is None else find(i)) for i, t in rows if i is not None)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Ünï", "THE", "the", "a-b."]
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.6:
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 90, 200]))]
            base.append(words)
        rows.append((i * 7 % 1001, rng.choice([" ", "\n", "  \t"]).join(words)))
    return rows


@pytest.mark.parametrize("k,num,den,seed", [(3, 9, 10, 1), (5, 4, 5, 2), (3, 4, 5, 3)])
def test_components_are_those_of_all_pairs(documents, k, num, den, seed):
    rows = corpus(seed)
    got = J.jaccard_components(documents(rows), k, num, den)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, k, num, den)


def test_blocks_with_many_members_are_cut(documents, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 3)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):  # one group of near copies around the threshold
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    for num, den in ((9, 10), (4, 5)):
        assert sorted(tuple(r) for r in J.jaccard_components(documents(rows), 3, num, den).collect()) == brute(rows, 3, num, den)


def test_special_rows(documents):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (7, "one two"), (8, "x two"), (8, "one"), (9, long), (10, long + " y")]
    rows += [(None, "one")]
    got = sorted((tuple(r) for r in J.jaccard_components(documents(rows), 3, 9, 10).collect()), key=repr)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (7, 1, 6), (8, 1, 4), (8, 1, 4), (9, 29998, 9), (10, 29999, 9), (None, 1, None)]
    assert got == sorted(want, key=repr)
    assert J.jaccard_components(documents([])).count() == 0


def test_blocks_keep_every_pair_within_the_bound():
    rng = np.random.default_rng(4)
    for n in (5, 11, 19, 40, 300, 2000):
        for num, den in ((9, 10), (4, 5)):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop = 0
            while True:  # as many changes as the threshold allows, on one side and on both
                b = np.concatenate((a[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)))
                both, union = len(a) - drop, len(a) + drop
                if both * den < num * union:
                    break
                x, y = J.block_words(a, num, den), J.block_words(b, num, den)
                assert drop == 0 or np.intersect1d(x, y).size
                assert J.hamming(J.parity_bits(a).tobytes(), J.parity_bits(b).tobytes()) <= union - both
                drop += 1


def test_sketches_of_different_width_fold():
    a = np.arange(60, dtype=np.uint64)
    assert J.hamming(J.parity_bits(a).tobytes(), J.parity_bits(a[:50]).tobytes()) <= 10


def test_shingles_do_not_depend_on_slices():
    texts = ["a b c d", None, "", "x", "A  b\tC d"] * 3
    whole = [s.tolist() for t in slices(pa.array(texts)) for s in shingle_sets(t, 3)]
    cut = [s.tolist() for t in slices(pa.array(texts), 4) for s in shingle_sets(t, 3)]
    assert whole == cut and whole[0] == whole[4] and whole[1] == whole[2] == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 130)] + [(5, 5), (None, 3), (200, 300), (300, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[300] == 200
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
