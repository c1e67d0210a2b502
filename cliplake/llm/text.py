"""Vectorised work on the words of many texts at once (numpy over Arrow buffers).

Texts are taken in slices of about 256 kB, a longer text alone and whole, so memory
does not depend on how Spark cuts its batches. Words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 18
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20_011).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_WEIGHTS = np.random.default_rng(20_012).integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, SLICE_BYTES + 1), U(base))
        table[0] = 1
        have = _powers[base] = np.multiply.accumulate(table)
    return have[:n]


@dataclass
class Texts:
    """Consecutive rows of a batch: bytes, and where each text starts (n + 1 offsets)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Rows in order, nulls as empty texts, about ``limit`` bytes at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield Texts(start, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
        start = end


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, after which the freed memory goes back to the system: Spark
    keeps a task's Python process for later ones, beside those that are at work then."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return tidied


@dataclass
class Words:
    """Words of a slice: byte ranges, text number, 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def bounds(self, n: int) -> np.ndarray:
        """Where the words of each of the ``n`` texts begin (n + 1 positions)."""
        return np.searchsorted(self.doc, np.arange(n + 1))


def runs(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the positions ``cuts``."""
    n = len(inside)
    fresh = np.zeros(n + 1, bool)
    fresh[cuts[cuts <= n]] = True
    before = np.concatenate(([False], inside[:-1])) if n else inside
    after = np.concatenate((inside[1:], [False])) if n else inside
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return starts, ends


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same wherever the range stands."""
    n = len(data)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * powers(_BASE, n), out=total[1:])
    raw = (total[end] - total[start]) * powers(_INVERSE, n + 1)[start]
    return mix(raw ^ ((end - start).astype(U) << U(48)))


def words(texts: Texts, lower: bool) -> Words:
    data = LOWER[texts.data] if lower else texts.data
    start, end = runs(~SEPARATOR[data], texts.offsets)
    doc = np.searchsorted(texts.offsets[1:], start, "right")
    return Words(start, end, doc, hash_ranges(data, start, end))


def grams(values: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` values within a text, and where each starts."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = values[:m] * _WEIGHTS[0]
    for j in range(1, n):
        total += values[j : j + m] * _WEIGHTS[j]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(total[at], n), at


def shingle_sets(texts: Texts, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its windows of ``k`` lower-cased words.

    A text with fewer words has its whole sequence as the only member, one without
    words the empty set.
    """
    w = words(texts, lower=True)
    hashes, at = grams(w.hash, w.doc, k)
    count = np.bincount(w.doc, minlength=len(texts))
    where = np.searchsorted(w.doc[at], np.arange(len(texts) + 1))
    bounds = w.bounds(len(texts))
    out = []
    for i in range(len(texts)):
        if 0 < count[i] < k:
            own = w.hash[bounds[i] : bounds[i + 1]]
            out.append(mix(np.sum(own * _WEIGHTS[: len(own)], dtype=U, keepdims=True), len(own)))
        else:
            out.append(np.unique(hashes[where[i] : where[i + 1]]))
    return out
