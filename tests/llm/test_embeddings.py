from __future__ import annotations

import numpy as np
import pytest

from llm_fixtures import documents, shipped  # noqa: F401
from cliplake.llm import embeddings as E


def brute(rows, cosine):
    ok = []
    for i, v in rows:
        x = None if v is None else np.array([np.nan if c is None else c for c in v], np.float64)
        ok.append(x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    ids = [i for i, _ in rows]
    links = {i: set() for i in ids}
    for a, x in enumerate(ok):
        for b, y in enumerate(ok):
            if a != b and x is not None and y is not None and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[ids[a]].add(ids[b])
    comp = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        comp[i] = min(seen)
    return sorted((i, len(links[i]), comp[i]) for i in ids)


def vectors(seed, dim, n=160):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((20, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(20)] + rng.standard_normal(dim) * rng.choice([0, 0.02, 0.15, 0.25, 0.4])
        rows.append((int(i * 3), (v * rng.choice([0.1, 1, 30])).astype(np.float32).tolist()))
    return rows


@pytest.mark.parametrize("dim,bits,seed", [(64, None, 1), (64, 11, 2), (10, 5, 3), (3, 6, 4), (100, 17, 5)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, dim, bits, seed):
    rows = vectors(seed, dim)
    if bits is not None:  # fine grids and chunks, as large tables have them
        monkeypatch.setattr(E, "CELL", len(rows) / 2**bits)
        monkeypatch.setattr(E, "CHUNK", 16)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted(tuple(r) for r in E.embedding_links(df, 0.95).collect())
    assert got == brute(rows, 0.95)


def test_special_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]),
        (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e-30, 1e-31]),
    ]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id bigint, embedding array<double>, id string, n_links int")
    got = {r[0]: (r[1], r[2]) for r in E.embedding_links(df, 0.95).collect()}
    assert got[1] == got[2] == got[10] == (3, 1)
    assert all(got[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 11)) and got[12] == (3, 1)
    assert E.embedding_links(df.limit(0), 0.95).count() == 0
    assert E.embedding_links(df, 0.95).count() == len(rows)
