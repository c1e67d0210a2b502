"""Streaming over rows that are sorted by group, a bounded number of groups at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches, dealt anew so that no group is in two batches."""
    kept: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        differs = np.zeros(batch.num_rows, bool)  # from the last group of the batch
        for c in columns:
            differs |= c != c[-1]
        cut = np.flatnonzero(differs)
        end = int(cut[-1]) + 1 if len(cut) else 0
        goes_on = kept and all(kept[-1].column(k)[-1].as_py() == c[0] for k, c in zip(keys, columns))
        if end or (kept and not goes_on):
            kept.append(batch.slice(0, end))
            yield joined()
            kept = []
        kept.append(batch.slice(end))
    if kept:
        yield joined()


def starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Where the groups of a sorted batch begin, and its length."""
    fresh = np.zeros(batch.num_rows, bool)
    fresh[:1] = True
    for k in keys:
        c = batch.column(k).to_numpy()
        fresh[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(fresh), batch.num_rows)
