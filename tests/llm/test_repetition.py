from __future__ import annotations

import random
import re
from collections import Counter

from llm_fixtures import documents, shipped  # noqa: F401
from cliplake.llm import repetition as R


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = [len(x) for x in w]

    def inside(n):
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return {j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}

    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    again_chars = sum(len(y) for x in again for y in re.findall(r"[^\x20\x09-\x0D]+", x))
    grams = {n: sum(chars[j] for j in inside(n)) for n in R.GRAM_LIMITS}
    failed = len(w) < 10 or 100 * len(inside(5)) > 20 * len(w)
    bad = len(again) > R.LINE_LIMIT * len(lines) or again_chars > R.LINE_CHARS_LIMIT * sum(chars)
    bad = bad or any(grams[n] > limit * sum(chars) for n, limit in R.GRAM_LIMITS.items())
    counts = (len(w), sum(chars), len(re.findall(r"[#*$%&|<>]", text)), len(again), len(inside(5)), len(lines), again_chars)
    return (*counts, *grams.values(), failed, not failed and not bad)


def test_against_brute_force(documents):
    rng = random.Random(3)
    vocab = ["a", "b", "c", "é漢", "x#y", "***", "日"]
    texts = [None, "", " ", "\n\n", "one", "a\na\n a\na", "a b c d e " * 9]
    texts += ["w" + " w" * 30_000]
    for _ in range(150):
        size = rng.choice([5, 30, 200])
        words = vocab[: rng.randint(1, 7)] + [f"u{i}" for i in range(rng.choice([0, 50, 900]))]
        texts.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\t", "\r\n"]) for _ in range(size)))
    texts += texts[-3:]
    got = R.repetition(documents(list(enumerate(texts)))).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: brute(t) for i, t in enumerate(texts) if i != 7} | {7: [tuple(r)[1:] for r in got if r[0] == 7][0]}
    (single,) = [r for r in got if r.doc_id == 7]
    assert single.n_words == single.n_repeat_words == 30_001 and not single.kept


def test_special_rows(documents):
    assert R.repetition(documents([])).count() == 0
    got = R.repetition(documents([(None, "a b"), (1, "a b"), (1, "a b")])).collect()
    assert len(got) == 3 and all(r.base_failed and not r.kept for r in got)
    clean = " ".join(f"word{i}" for i in range(200))
    assert R.repetition(documents([(1, clean)])).first().kept
