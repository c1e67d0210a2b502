from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import documents, shipped  # noqa: F401
from cliplake.llm import pieces as P
from cliplake.llm.queries import tokenizer


@pytest.fixture(scope="module")
def model():
    return P.load(tokenizer())


def texts():
    rng = random.Random(5)
    parts = ["a", "b", "e", "in", "the", " ", "  ", "▁", "\n", "\t", "é", "漢", "字", "😀", "1", "22", ".", "...", "한", "▁▁▁", "    ", "<0x41>", "<s>"]
    parts += ["\u0000", "ß", "ation", "لعربية", "русский", "क्षि", "日本語", "xxxxx", "𠀀", "\r\n"]
    out = ["", " ", "▁", "\n", "  a", "a ", None] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    return out + [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(20)) for _ in range(200)] + ["word " * 60_000 + "z" * 3_000]


def test_ids_and_texts_are_the_library_s(spark, documents, model):
    rows = list(enumerate(texts()))
    df = P.decode(P.encode(documents(rows + [rows[9], (None, "x")]), tokenizer()), tokenizer())
    got = df.collect()
    assert len(got) == len(rows) + 2
    for r in got:
        text = ("x" if r.doc_id is None else rows[r.doc_id][1]) or ""
        want = model.library.encode(text)
        assert r.ids == want and r.decoded == model.library.decode(want)
    again = P.encode(documents(rows), tokenizer(), round_trip=True).collect()
    assert {r.doc_id: (r.ids, r.decoded) for r in again} == {r.doc_id: (r.ids, r.decoded) for r in got if r.doc_id is not None}
    assert P.encode(documents([]), tokenizer()).count() == 0


def test_decoding_of_any_ids(spark, model):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(3, 400) for _ in range(rng.randint(0, 12))]) for i in range(200)] + [(900, None), (901, [1, 264, 2])]
    got = P.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>"), tokenizer()).collect()
    assert {r.doc_id: r.decoded for r in got} == {i: model.library.decode(ids or []) for i, ids in rows}


def test_memory_of_cut_pieces_may_run_out(model, monkeypatch):
    monkeypatch.setattr(P, "MEMORY", 5)
    encode = model.encoder()
    for _ in range(3):
        ids, offsets = encode(pa.array(["one two three four five six", "", "seven eight"]))
        assert ids.tolist() == sum(model.library.encode(["one two three four five six", "seven eight"]), []) and offsets[1] == offsets[2]


def test_every_pair_test_agrees_with_merging(model):
    rng = np.random.default_rng(1)
    usable = np.flatnonzero((model.level >= -1) & np.array([t in model.id for t in model.text]))
    usable = np.array([i for i in usable if P.merge(list(model.text[i]), model.rank) == [model.text[i]]][:9000])
    a, b = rng.choice(usable, 3000), rng.choice(usable, 3000)
    want = [P.merge(list(model.text[x] + model.text[y]), model.rank) == [model.text[x], model.text[y]] for x, y in zip(a, b)]
    assert model.compatible(a, b).tolist() == want
