"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= t are at squared distance <= e = 2 - 2t. After a fixed random
rotation the coordinates are split into blocks; a block of k of the d dimensions has the
budget e k / d. The budgets add up to e, so in at least one block a pair stays within its
budget (pigeonhole). Each block is a range join: vectors have a home cell of a grid on the
block's coordinates (edges at normal quantiles, as many as the number of vectors asks for)
and probe all cells that the ball of their budget touches. What meets in a cell is tested
in numpy: the block's distance, then whether this is the pair's first block within budget
(so the union of candidates has every pair once), then the cosine in double precision.

Equal vectors are one node with a weight. Cells with many homes are cut into chunks, and
probes are streamed past the homes of a chunk, so a task holds a bounded number of vectors
whatever the group. No pair leaves a task: it returns link counts per vector and, for every
linked vector, the smallest one that its batch connects it with.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplake.llm.components import components
from cliplake.llm.tables import stash

BLOCK = 8  # dimensions of a block, about
CELL = 6_400  # vectors in a cell of evenly spread data, about
CHUNK = 8_192  # homes that a task holds, about
PART = 2_048  # vectors unpacked together
HEAVY = 100_000  # most cells that are cut into chunks; a cell must be above its share for that
PAIRS = 1 << 16  # candidates tested together
SLACK = 1e-9
ROOM = 1e-5  # error of single precision on squared distances of unit vectors


class Space:
    """Rotation, blocks, budgets and grids for vectors of one dimension."""

    def __init__(self, dim: int, bits: int, cosine: float):
        q, r = np.linalg.qr(np.random.default_rng(2_021 + dim).standard_normal((dim, dim)))
        self.rotation = q * np.sign(np.diag(r))
        self.blocks = np.array_split(np.arange(dim), max(1, dim // BLOCK))
        self.budgets = [(2 - 2 * cosine) * len(b) / dim + SLACK for b in self.blocks]
        self.edges = []  # per block and dimension
        for b in self.blocks:
            per = [min(3, bits // len(b) + (j < bits % len(b))) for j in range(len(b))]
            self.edges.append([np.array([NormalDist().inv_cdf(i / 2**p) / dim**0.5 for i in range(1, 2**p)]) for p in per])

    def home(self, y: np.ndarray, block: int) -> np.ndarray:
        cell = np.zeros(len(y), np.int64)
        for x, edges in zip(y[:, self.blocks[block]].T, self.edges[block]):
            cell = cell * (len(edges) + 1) + np.searchsorted(edges, x, "right")
        return cell

    def probes(self, y: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for all cells within the block's budget of a vector."""
        row, cell, used = np.arange(len(y)), np.zeros(len(y), np.int64), np.zeros(len(y))
        for x, edges in zip(y[:, self.blocks[block]].T, self.edges[block]):
            if not len(edges):
                continue
            low, high = np.append(-np.inf, edges), np.append(edges, np.inf)
            parts = []
            for k in range(len(low)):
                d = np.maximum(0.0, np.maximum(low[k] - x[row], x[row] - high[k]))
                total = used + d * d
                ok = total <= self.budgets[block] + SLACK
                parts.append((row[ok], cell[ok] * len(low) + k, total[ok]))
            row, cell, used = (np.concatenate(p) for p in zip(*parts))
        return row, cell

    def block_distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distances per block of rotated vectors, pair by pair (the same for a pair
        wherever it is computed)."""
        d = (a - b) ** 2
        return np.stack([d[:, b].sum(1) for b in self.blocks], 1)


@lru_cache(maxsize=8)
def space(dim: int, bits: int, cosine: float) -> Space:
    return Space(dim, bits, cosine)


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _checked(kind: str):
    """(id, dim, raw) of the vectors that can link: not empty, all finite, not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws, dims = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not v.is_valid or i is None or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    dims.append(len(x))
                    raws.append(x.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], ["id", "dim", "raw"]
            )

    return run


def _by_dim(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dim, rows, raw, rotated unit vectors), at most a chunk at a time."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        for at in range(0, len(rows), PART):
            part = rows[at : at + PART]
            raw = np.frombuffer(b"".join(batch.column("raw").take(pa.array(part)).to_pylist()), kind).reshape(len(part), dim)
            yield int(dim), part, raw, unit(raw)


def _homes(kind: str, bits: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, _, u in _by_dim(batch, kind):
                s = space(dim, bits, cosine)
                y = u @ s.rotation.T
                for b in range(len(s.blocks)):
                    cell = s.home(y, b)
                    n = len(cell)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim), pa.int32()), pa.array(np.full(n, b), pa.int32()), pa.array(cell)], ["dim", "block", "cell"])

    return run


def _spread(kind: str, bits: int, cosine: float, heavy: dict[tuple[int, int, int], int]):
    """Rows for the cells: side 0 at home, side 1 for every probe, once per chunk of the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weights = batch.column("id").to_numpy(), batch.column("weight").to_numpy()
            for dim, rows, raw, u in _by_dim(batch, kind):
                s = space(dim, bits, cosine)
                y = u @ s.rotation.T
                texts = np.array([r.tobytes() for r in raw], object)
                for b in range(len(s.blocks)):
                    cell = s.home(y, b)
                    chunks = np.array([heavy.get((dim, b, int(c)), 1) for c in cell], np.int64)
                    chunk = ids[rows] % chunks
                    r, c = s.probes(y, b)
                    times = np.array([heavy.get((dim, b, int(x)), 1) for x in c], np.int64)
                    probe_chunk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    r, c = np.repeat(r, times), np.repeat(c, times)
                    at = np.concatenate((np.arange(len(cell)), r))
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, dim), pa.int32()),
                            pa.array(np.full(n, b), pa.int32()),
                            pa.array(np.concatenate((cell, c))),
                            pa.array(np.concatenate((chunk, probe_chunk))),
                            pa.array(np.concatenate((np.zeros(len(cell)), np.ones(len(r)))), pa.int32()),
                            pa.array(ids[rows][at]),
                            pa.array(weights[rows][at]),
                            pa.array(texts[at], pa.binary()),
                        ],
                        ["dim", "block", "cell", "chunk", "side", "id", "weight", "raw"],
                    )

    return run


def _least(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest id that the links (a, b) connect it with."""
    label = ids.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            return label
        label = new


def _test(kind: str, bits: int, cosine: float):
    """(id, n, peer): links found for a probe, and the smallest id its batch connects it with."""
    names = ["dim", "block", "cell", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple = ()
        homes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in [*names, "side"]], 1)
            cuts = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))), len(keys))
            for a, b in zip(cuts[:-1], cuts[1:]):
                for at in range(a, b, PART):
                    part = batch.slice(at, min(PART, b - at))
                    key = tuple(keys[a][:4].tolist())
                    dim, block = key[:2]
                    s = space(dim, bits, cosine)
                    raw = np.frombuffer(b"".join(part.column("raw").to_pylist()), kind).reshape(part.num_rows, dim)
                    u = unit(raw)
                    mine = (part.column("id").to_numpy(), part.column("weight").to_numpy(), u, u @ s.rotation.T)
                    if key != here:
                        here, homes, held = key, [], None
                    if keys[a][4] == 0:
                        homes.append(mine)
                        held = None
                        continue
                    if not homes:
                        continue
                    if held is None:
                        held = tuple(np.concatenate(x) for x in zip(*homes))
                    out = _compare(s, block, cosine, mine, held)
                    if out is not None:
                        yield out

    return run


def _compare(s: Space, block: int, cosine: float, probes: tuple, homes: tuple) -> pa.RecordBatch | None:
    ids, _, u, y = probes
    home_ids, weights, v, z = homes
    dims = s.blocks[block]
    p, h = y[:, dims], z[:, dims]
    # |p|^2 + |h|^2 - 2 p.h as one product, in single precision with room for its error
    one = np.ones((len(p), 1)), np.ones((len(h), 1))
    p32 = np.hstack((-2 * p, (p * p).sum(1, keepdims=True), one[0])).astype(np.float32)
    h32 = np.hstack((h, one[1], (h * h).sum(1, keepdims=True))).astype(np.float32).T
    limit = np.float32(s.budgets[block] + ROOM)
    step = max(1, (1 << 18) // len(h))
    left, right = [], []
    for at in range(0, len(p), step):
        found = np.flatnonzero(p32[at : at + step] @ h32 <= limit)
        if not len(found):
            continue
        i, j = found // len(h) + at, found % len(h)
        other = ids[i] != home_ids[j]
        i, j = i[other], j[other]
        for c in range(0, len(i), PAIRS):
            a, b = i[c : c + PAIRS], j[c : c + PAIRS]
            within = s.block_distances(y[a], z[b]) <= np.array(s.budgets)
            first = within[:, block] & ~within[:, :block].any(1)
            a, b = a[first], b[first]
            linked = np.einsum("ij,ij->i", u[a], v[b]) >= cosine
            left.append(a[linked])
            right.append(b[linked])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    if not len(a):
        return None
    nodes, where = np.unique(np.concatenate((ids[a], home_ids[b])), return_inverse=True)
    peer = _least(len(nodes), where[: len(a)], where[len(a) :], nodes)
    n = np.zeros(len(nodes), np.int64)
    np.add.at(n, where[: len(a)], weights[b])
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(n), pa.array(peer)], ["id", "n", "peer"])


def embedding_links(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id)``, a row for each row of ``vectors``.

    Vectors of one length link when the cosine, in double precision, is at least
    ``cosine``; labels and other columns are not read. Vectors that are null, empty or
    zero or hold null or non-finite components, and rows with a null id, link with
    nothing. Rows that repeat an id and its vector are one vector; an id with several
    vectors has the links of all. An empty table gives an empty result.
    """
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, (T.FloatType, T.ByteType, T.ShortType)) else "<f8"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    usable = rows.mapInArrow(_checked(kind), "id bigint, dim int, raw binary").distinct()
    usable = stash(usable)
    nodes = usable.groupBy("dim", "raw").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    nodes = stash(nodes)
    copies = usable.join(nodes.where("weight > 1"), ["dim", "raw"]).select("id", "rep", "weight")
    total = nodes.count()
    bits = max(0, round(np.log2(max(1, total) / CELL)))
    reps = nodes.select(F.col("rep").alias("id"), "weight", "dim", "raw")
    limit = max(CHUNK, 8 * total // HEAVY)  # eight homes a vector, so at most HEAVY cells are above
    crowded = reps.select("dim", "raw").mapInArrow(_homes(kind, bits, cosine), "dim int, block int, cell bigint")
    crowded = crowded.groupBy("dim", "block", "cell").count().where(F.col("count") > limit)
    heavy = {(r[0], r[1], r[2]): -(-r[3] // CHUNK) for r in crowded.collect()}
    keys = ["dim", "block", "cell", "chunk"]
    met = (
        reps.mapInArrow(
            _spread(kind, bits, cosine, heavy),
            "dim int, block int, cell bigint, chunk bigint, side int, id bigint, weight bigint, raw binary",
        )
        .repartition(*keys)
        .sortWithinPartitions(*keys, "side")
        .mapInArrow(_test(kind, bits, cosine), "id bigint, n bigint, peer bigint")
    )
    found = stash(met.groupBy("id", "peer").agg(F.sum("n").alias("n")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    links = found.select(F.col("id").alias("a"), F.col("peer").alias("b")).union(copies.select(F.col("id"), F.col("rep")))
    placed = components(links)
    own = (
        usable.select("id").join(copies.select("id", "rep", "weight"), "id", "left")
        .select("id", F.coalesce("rep", "id").alias("rep"), (F.coalesce("weight", F.lit(1)) - 1).alias("twins"))
        .distinct()
    )
    own = own.join(counts.withColumnRenamed("id", "rep"), "rep", "left").groupBy("id").agg(
        F.sum(F.col("twins") + F.coalesce("n", F.lit(0))).alias("n_links")
    )
    return (
        rows.select("id").join(own, "id", "left").join(placed, "id", "left")
        .select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    )
