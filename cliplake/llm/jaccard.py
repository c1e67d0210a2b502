"""N-gram Jaccard join by parity sketches.

Method. A text's set S of word shingles is cut into M blocks by hash; a block is held as
the XOR of the 64-bit hashes of its members (a parity sketch 2**64 bits wide, folded into
one word), so two blocks agree exactly when their members do. Every element of the
symmetric difference spoils at most one block. Two sets with Jaccard >= t differ in at
most D = (|A|+|B|)(1-t)/(1+t) elements, so at least M - D blocks agree (pigeonhole) and a
join on single blocks finds the pair.

* Size bands. Band i has the sizes 2**i .. 2**(i+1)-1 and M fixed from its largest pair.
  A text enters its own band and, as the smaller partner, the next one if a partner can
  be there.
* Of its M blocks a text of size n joins on D_n + 1 only, D_n for its own largest partner:
  those with most members (ties by block word). If two texts share at least M - D blocks,
  the best shared one in this order, which depends on content alone, is kept by both.
  Blocks with few members are the ones that unrelated texts share, so they go first.
* A second sketch of 4 to 8 parity bits per element gives a Hamming distance that never
  exceeds the symmetric difference; candidates above D are dropped before any set moves.
  The survivors are verified on the sets.
* Groups of copies: texts with equal sets are one representative. Candidates of a block
  are first its members against its smallest id (linear). Blocks whose members these links
  leave in different components are then compared across components, by their sketches,
  where they meet: first every member names its earliest partner (linear again), and once
  these links have joined what they can, all partners left in other components. A block
  with many members is cut into chunks, every pair of chunks compared on its own. Every
  pair is decided, so the components are those of all links; pairs that fail the Hamming
  bound never leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplake.llm.components import components
from cliplake.llm.groups import starts, whole_groups
from cliplake.llm.tables import sieve, stash
from cliplake.llm.text import U, mix, shingle_sets, slices, tidy

CHUNK = 2_000  # members of a block in one chunk, about
SPARE = 8  # one block in SPARE is added to M, so that poor blocks can be left out
_SKETCH = "id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, sketch binary, blocks array<bigint>"


def largest_difference(total: int, num: int, den: int) -> int:
    """Most elements two sets of ``total`` members together may differ in at num/den."""
    return total * (den - num) // (den + num)


def block_words(members: np.ndarray, num: int, den: int) -> np.ndarray:
    """The block words a set joins on, of all its size bands, as 64-bit join keys."""
    n, keys = len(members), []
    top = n * den // num  # the largest partner
    for band in range(n.bit_length() - 1, top.bit_length()):
        last = 2 ** (band + 1) - 1
        d = largest_difference(2 * last, num, den)
        if d == 0:  # equal sets only, which fingerprints group
            continue
        m = d + 1 + d // SPARE
        where = ((mix(members, 1) >> U(32)) * U(m)) >> U(32)
        where = where.astype(np.int64)
        word = np.zeros(m, U)
        np.bitwise_xor.at(word, where, mix(members, 2))
        size = np.bincount(where, minlength=m)
        keep = largest_difference(n + min(last, top), num, den) + 1
        best = np.lexsort((word, -size))[:keep] if keep < m else np.arange(m)
        keys.append(mix(word[best] + mix(best.astype(U), 1000 + band)))
    return np.concatenate(keys) if keys else np.zeros(0, U)


def parity_bits(members: np.ndarray) -> np.ndarray:
    """Parity bits by hash; the width is a power of two, so a wide sketch folds."""
    width = max(64, 1 << (4 * len(members) - 1).bit_length()) if len(members) else 64
    odd = np.bincount((mix(members, 3) & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, width), axis=0)


def hamming(a: bytes, b: bytes) -> int:
    """Hamming distance of two parity sketches, the wider one folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, width) ^ _fold(y, width)).sum())


def _sketches(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for texts in slices(batch.column(1)):
                sets = shingle_sets(texts, k)
                blocks = [block_words(s, num, den).view(np.int64) for s in sets]
                sizes = np.cumsum([0, *map(len, blocks)])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(texts.first, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([int(np.sum(mix(s, 4), dtype=U).view(np.int64)) for s in sets], pa.int64()),
                        pa.array([int(np.bitwise_xor.reduce(mix(s, 5)).astype(U).view(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
                        pa.array([parity_bits(s).tobytes() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(blocks), pa.int64())),
                    ],
                    ["id", "n_shingles", "fp1", "fp2", "sketch", "blocks"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                sets = [s.view(np.int64) for s in shingle_sets(texts, k)]
                sizes = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, len(texts)),
                        pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(sets), pa.int64())),
                    ],
                    ["id", "members"],
                )

    return run


def _near(num: int, den: int):
    """Keep the candidates (a, b, na, sa, nb, sb) whose sketches are close enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, sa, nb, sb = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [hamming(x, y) <= largest_difference(m + n, num, den) for m, x, n, y in zip(na, sa, nb, sb)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _across(num: int, den: int, everything: bool):
    """(a, b) of rows (block, low, high, own, id, label, n, sketch): pairs of different
    components within the bounds; unless ``everything``, the earliest ``a`` for every ``b``."""

    def group(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids, label, n, own = (rows.column(c).to_numpy() for c in ("id", "label", "n", "own"))
        cross = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
        raw = rows.column("sketch").to_pylist()
        width = min(map(len, raw))
        bits = np.stack([_fold(np.frombuffer(r, np.uint8), width) for r in raw]).view(U)
        out = []
        step = max(1, (1 << 19) // (len(ids) * bits.shape[1]))
        for at in range(0, len(ids), step):
            b = np.arange(at, min(at + step, len(ids)))
            total, less = n[b, None] + n[None, :], np.minimum(n[b, None], n[None, :])
            ok = (ids[b, None] > ids[None, :]) & (label[b, None] != label[None, :]) & (less * den >= (total - less) * num)
            if cross:
                ok &= own[b, None] != own[None, :]
            x, y = np.nonzero(ok)
            far = np.bitwise_count(bits[b[x]] ^ bits[y]).sum(1, dtype=np.int64)
            near = far <= total[x, y] * (den - num) // (den + num)
            x, y = b[x[near]], y[near]
            if not everything and len(x):  # rows are sorted by id
                x, first = np.unique(x, return_index=True)
                y = y[first]
            out.append((ids[y], ids[x]))
        return tuple(np.concatenate(p) for p in zip(*out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("block", "low", "high")
        for batch in whole_groups(batches, keys):
            edges = starts(batch, keys)
            found = [group(batch.slice(i, j - i)) for i, j in zip(edges[:-1], edges[1:]) if j - i > 1]
            if found:
                a, b = (np.concatenate(p) for p in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _crossing(shared: DataFrame, found: DataFrame, sketches: DataFrame, num: int, den: int, everything: bool) -> DataFrame:
    """Candidates between the components ``found`` among the members of common blocks."""
    placed = shared.join(found, "id", "left").withColumn("label", F.coalesce("component_id", "id")).select("block", "id", "label")
    apart = placed.groupBy("block").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).where("x < y")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit("chunk")), chunks).cast("int")
    dealt = (
        placed.join(apart.select("block", "size"), "block")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .join(sketches.select("id", F.col("n_shingles").alias("n"), "sketch"), "id")
        .select("block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "label", "n", "sketch")
    )
    keys = ["block", "low", "high"]
    met = dealt.repartition(*keys).sortWithinPartitions(*keys, "id")
    return met.mapInArrow(tidy(_across(num, den, everything)), "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the candidate pairs ``(a, b)`` that link."""
    s = sketches.select("id", "n_shingles", "sketch")
    for end in "ab":
        own = s.select(F.col("id").alias(end), F.col("n_shingles").alias(f"n{end}"), F.col("sketch").alias(f"s{end}"))
        pairs = pairs.join(own, end)
    near = pairs.where(f"least(na, nb) * {den} >= greatest(na, nb) * {num}").select("a", "b", "na", "sa", "nb", "sb")
    near = stash(near.mapInArrow(tidy(_near(num, den)), "a bigint, b bigint").distinct())
    ends = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    ends = stash(ends)
    members = stash(sieve(texts, ends, "id").join(ends, "id", "left_semi").select("id", "text").mapInArrow(tidy(_sets(k)), "id bigint, members array<bigint>"))
    for end in "ba":
        near = near.join(members.select(F.col("id").alias(end), F.col("members").alias(f"m{end}")), end)
    both = F.size(F.array_intersect("ma", "mb")).cast("bigint")
    return (
        near.select("a", "b", both.alias("both"), (F.size("ma") + F.size("mb")).cast("bigint").alias("total"))
        .where(F.col("both") * den >= (F.col("total") - F.col("both")) * num)
        .select("a", "b")
    )


def jaccard_components(
    docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_shingles, component_id)``, a row for each row of ``docs``.

    Texts link when the Jaccard similarity of their sets of ``k``-word shingles is at
    least ``num / den``. Null and empty texts, and texts without words, have no shingles
    and link with nothing; texts with fewer than ``k`` words have one. Rows that repeat an
    id are one node with all their texts. A row with a null id keeps a null component and
    links with nothing. Only ``id_col`` and ``text_col`` are read; an empty table gives an
    empty result.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sketches = stash(texts.mapInArrow(tidy(_sketches(k, num, den)), _SKETCH))
    full = sketches.where("n_shingles > 0 and id is not null")
    classes = full.groupBy("n_shingles", "fp1", "fp2").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    copies = full.join(classes.where("rep < last"), ["n_shingles", "fp1", "fp2"]).select(
        F.col("rep").alias("a"), F.col("id").alias("b")
    ).where("a < b")
    chosen = full.join(classes.select("n_shingles", "fp1", "fp2", F.col("rep").alias("id")), ["n_shingles", "fp1", "fp2", "id"], "left_semi")

    facts = stash(chosen.select("id", "n_shingles", "sketch").distinct())
    rows = chosen.select("id", F.explode("blocks").alias("block"))
    heads = rows.groupBy("block").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last")
    shared = stash(rows.join(heads.select("block", "head"), "block").distinct())
    star = shared.where("head < id").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    links = stash(_verified(star, facts, texts, k, num, den).union(copies))
    found = components(links)

    for everything in (False, True):
        candidates = stash(_crossing(shared, found, facts, num, den, everything))
        if candidates.isEmpty():
            break
        links = stash(links.union(_verified(candidates, facts, texts, k, num, den)))
        found = components(links)
    return sketches.select("id", "n_shingles").join(found, "id", "left").select(
        "id", "n_shingles", F.coalesce("component_id", "id").alias("component_id")
    )
