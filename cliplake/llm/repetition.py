"""Quality rules on repetition: how much of a text lies inside repeated n-grams and lines.

One pass, no shuffle. Rolling hashes of the words give the windows of every length at
once; windows that occur twice or more in their text mark the words they cover, and the
characters of marked words are measured against all word characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplake.llm.text import U, Texts, grams, hash_ranges, mix, runs, slices, words

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
STARTS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
# Largest share of word characters inside n-grams that occur more than once, by length;
# and of lines, and characters in lines, that repeat an earlier line.
GRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT, LINE_CHARS_LIMIT = 0.30, 0.20
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars")


def _repeated(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which hashes occur twice or more in their text."""
    key = hashes ^ mix(doc.astype(U), 77)
    order = np.argsort(key, kind="stable")
    same = np.concatenate(([False], key[order][1:] == key[order][:-1]))
    twice = same | np.concatenate((same[1:], [False]))
    out = np.zeros(len(key), bool)
    out[order] = twice
    return out


def _covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Positions below ``n`` inside windows that begin at ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + width, 1)
    return np.cumsum(edge[:n]) > 0


def _per_text(n: int, doc: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    if values is None:
        return np.bincount(doc, minlength=n)
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def measure(texts: Texts, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts per text; ``gram_<n>`` are characters inside repeated windows of n words."""
    n = len(texts)
    w = words(texts, lower=False)
    points = np.concatenate(([0], np.cumsum(STARTS[texts.data])))
    chars = points[w.end] - points[w.start]
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[texts.data])))
    out = {
        "n_words": _per_text(n, w.doc),
        "word_chars": _per_text(n, w.doc, chars),
        "n_symbols": symbols[texts.offsets[1:]] - symbols[texts.offsets[:-1]],
    }
    for length in lengths:
        hashes, at = grams(w.hash, w.doc, length)
        inside = _covered(len(w.doc), at[_repeated(hashes, w.doc[at])], length)
        if length == 5:
            out["n_repeat_words"] = _per_text(n, w.doc, inside)
        out[f"gram_{length}"] = _per_text(n, w.doc, chars * inside)
    start, end = runs(texts.data != 10, texts.offsets)
    doc = np.searchsorted(texts.offsets[1:], start, "right")
    first = np.searchsorted(w.start, start)
    used = (first < len(w.start)) & (np.append(w.start, 1 << 62)[first] < end)  # lines with a word
    start, end, doc = start[used], end[used], doc[used]
    key = hash_ranges(texts.data, start, end) ^ mix(doc.astype(U), 78)
    earliest = np.unique(key, return_index=True)[1]
    again = np.ones(len(key), bool)
    again[earliest] = False
    line_chars = np.add.reduceat(np.append(chars, 0), np.searchsorted(w.start, start)) if len(start) else np.zeros(0)
    out |= {"n_lines": _per_text(n, doc), "n_dup_lines": _per_text(n, doc[again]), "dup_line_chars": _per_text(n, doc[again], line_chars[again])}
    return out


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdicts, a row for each row of ``docs``.

    ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    dup_line_chars, gram_5 .. gram_10, base_failed, kept)``. Null and empty texts have no
    words, so they fail. Ids may be null or repeat, every row is measured by itself; other
    columns are not read. A text is kept if the base rule holds and no limit is exceeded:
    characters in repeated n-grams (``GRAM_LIMITS``), repeated lines, characters in them.
    """
    lengths = tuple(GRAM_LIMITS)
    names = [*_COUNTS, *[f"gram_{n}" for n in lengths]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                got = measure(texts, lengths)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, len(texts)), *[pa.array(got[c], pa.int64()) for c in names]],
                    ["doc_id", *names],
                )

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(
        run, ", ".join(["doc_id bigint", *[f"{c} bigint" for c in names]])
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    bad = (F.col("n_dup_lines") > LINE_LIMIT * F.col("n_lines")) | (
        F.col("dup_line_chars") > LINE_CHARS_LIMIT * F.col("word_chars")
    )
    for n, limit in GRAM_LIMITS.items():
        bad = bad | (F.col(f"gram_{n}") > limit * F.col("word_chars"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~bad)
