"""Line dedup: an exact set-similarity join of lines, removing the later of each match.

A line is the set of its lower-cased words. Words are ordered by rarity (counts of hash
buckets over the whole table; any fixed order is valid, a rare-first one is fast). Two
sets with Jaccard >= t share a word among the first ``n - ceil(t n) + 1`` of each (prefix
filter); the pair must also have sizes within t (length filter) and, at the first shared
word, enough words left on both sides (positional filter). Survivors are verified on the
whole sets.

* Lines with equal sets are one node, represented by its first line; the later ones go
  without any join of pairs.
* Texts are cut into words once for the counts and once for all lines: sizes, bits and prefix
  words are stored, four bytes a word. Words whose hashes agree in these 32 bits share a
  group, which costs pairs to look at and loses none.
* Groups are dealt out by hash into buckets of about ``BUCKET`` lines, as many as the input
  needs; the rows of a bucket travel packed, some dozens in one value.
* Lines that share a prefix word meet in one group. Each takes the earliest line of the
  group that passes the filters, among them the Hamming distance of 128 parity bits, which
  never exceeds the symmetric difference; so a group of near copies gives as many pairs as
  lines. A line whose first candidates fail the exact test, and that had more, asks for
  all of them in a second pass over the groups of its words.
* A frequent word's lines are cut into chunks, and every pair of chunks is a group of its
  own, so no group is larger than two chunks and none loses a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplake.llm.groups import whole_groups
from cliplake.llm.tables import stash
from cliplake.llm.text import U, Texts, mix, runs, slices, tidy, words

BITS = 22  # buckets of the word counts: 16 megabytes travel with a task, whatever the input
PIECE = 1 << 12  # buckets in a row
CHUNK = 50_000  # lines of a word in one chunk, about
SMALL = 64  # lines of a group that is compared all at once
MARKS = 1 << 24  # bits of a bitmap of hashed keys: two megabytes, whatever the input
WIDE = 1 << 19  # rows of groups dealt out at a time
BUCKET = 2_500  # lines for every bucket of groups
PACK = 80  # rows in one value at most, 4 kB
_KEY = "decimal(38,0)"  # doc_id * 2**32 + number of the line, so keys are in text order
#: A line in a group, which is named by the word (upper half) and the pair of chunks. own: 4 * number of the line's chunk,
#: 2 if it asks for all candidates, 1 if the group is no pair of chunks.
_ROW = np.dtype([("group", "<u8"), ("key", "<i8", 2), ("bits", "<u8", 2), ("n", "<i4"), ("at", "<i4"), ("own", "<i4")])


def _keys(ids: np.ndarray, lines: np.ndarray) -> pa.Array:
    """``ids * 2**32 + lines`` as 128-bit decimals."""
    both = np.empty((len(ids), 2), np.int64)
    both[:, 0] = (ids << 32) | lines
    both[:, 1] = ids >> 32
    return pa.Array.from_buffers(pa.decimal128(38), len(ids), [None, pa.py_buffer(both.tobytes())])


def _key_words(keys: pa.Array) -> np.ndarray:
    """The two words of every key, the lower one first."""
    return np.frombuffer(keys.buffers()[1], np.int64).reshape(-1, 2)[keys.offset : keys.offset + len(keys)]


def _key_hash(key: np.ndarray) -> np.ndarray:
    return mix(key[:, 0].astype(U) ^ mix(key[:, 1].astype(U), 12), 11)


def _id_hash(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(U), 13)


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``values`` up to every end."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(values.tobytes())])


def _unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All binary values as one array of ``kind``, and their offsets in it."""
    column = column.cast(pa.large_binary())
    where = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], kind, (where[-1] - where[0]) // size, where[0]), (where - where[0]) // size


def line_ranges(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and number (from 0, in its text) of every non-empty ``\\n``-split line."""
    breaks = texts.data == 10
    start, end = runs(~breaks, texts.offsets)
    doc = np.searchsorted(texts.offsets[1:], start, "right")
    before = np.concatenate(([0], np.cumsum(breaks)))
    return start, end, doc, before[start] - before[texts.offsets[:-1]][doc]


def line_tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and number of every line with a word; hash and line (index) of every word."""
    start, _, doc, number = line_ranges(texts)
    w = words(texts, lower=True)
    owner = np.searchsorted(start, w.start, "right") - 1
    used = np.zeros(len(start), bool)
    used[owner] = True
    return doc[used], number[used], w.hash, (np.cumsum(used) - 1)[owner]


def needed(n: np.ndarray | int, num: int, den: int):
    """Smallest overlap of a set of ``n`` members with any set at Jaccard num/den or more."""
    return -(-n * num // den)


def _pieces(total: np.ndarray) -> pa.RecordBatch:
    rows = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(-1, PIECE)
    used = np.flatnonzero(rows.any(1))
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([rows[i].tobytes() for i in used], pa.binary())], ["piece", "counts"]
    )


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for texts in slices(batch.column(0)):
            np.add.at(total, (words(texts, lower=True).hash >> U(64 - BITS)).astype(np.int64), 1)
    yield _pieces(total)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the same pieces summed, per task."""
    total: np.ndarray | None = None
    for batch in batches:
        if total is None:
            total = np.zeros((1 << BITS) // PIECE * PIECE, np.int64).reshape(-1, PIECE)
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[piece] += np.frombuffer(counts, np.int32)
    if total is not None:
        yield _pieces(total.reshape(-1))


def word_counts(docs: DataFrame, text_col: str) -> Broadcast:
    """Occurrences of words by hash bucket over all texts, ``2**BITS`` numbers.

    Tasks send their counts in pieces; those of a piece are added where they meet.
    """
    schema = "piece int, counts binary"
    rows = docs.select(text_col).mapInArrow(tidy(_counts), schema).repartition("piece").mapInArrow(tidy(_added), schema)
    total = np.zeros(1 << BITS, np.int32)
    for piece, counts in rows.collect():
        total[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(counts, np.int32)
    return docs.sparkSession.sparkContext.broadcast(total)


def _line_sets(texts: Texts, rarity: np.ndarray):
    """Text and number of every line with a word, and its distinct words: hash, line,
    occurrences; sorted by line, then rarest first."""
    doc, number, token, line = line_tokens(texts)
    seen = np.minimum(rarity[(token >> U(64 - BITS)).astype(np.int64)], (1 << 24) - 1)
    used = 24 + max(len(doc) - 1, 0).bit_length()
    order = None
    if used < 56:  # one sort of numbers; the last bits hold as much of the hash as there is room for
        number_of = (line.astype(U) << U(64 + 24 - used) if used > 24 else U(0)) | (seen.astype(U) << U(64 - used)) | (token >> U(used))
        order = np.argsort(number_of)
        sorted_token, sorted_number = token[order], number_of[order]
        if ((sorted_number[1:] == sorted_number[:-1]) & (sorted_token[1:] != sorted_token[:-1])).any():
            order = None
    if order is None:
        order = np.lexsort((token, seen, line))
    token, line, seen = token[order], line[order], seen[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
    return doc, number, token[fresh], line[fresh], seen[fresh]


def _prints(token: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    return [
        pa.array(np.add.reduceat(mix(token, 4), first).view(np.int64)),
        pa.array(np.bitwise_xor.reduceat(mix(token, 5), first).view(np.int64)),
    ]


def _described(counts: Broadcast, num: int, den: int):
    """(key, n, fp1, fp2, body) of every line with a word. The body is 128 parity bits and the
    words of the prefix, the last ones of its positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = counts.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for texts in slices(batch.column(1)):
                doc, number, token, line, seen = _line_sets(texts, rarity)
                if not len(doc):
                    continue
                n = np.bincount(line, minlength=len(doc))
                first = np.cumsum(n) - n
                at = np.arange(len(token)) - first[line]
                # a word that occurs once in all texts is in no other line; such words come first
                prefix = (at < (n - needed(n, num, den) + 1)[line]) & (seen > 1)
                place = mix(token, 9) & U(127)
                bit = U(1) << (place & U(63))
                half = place < U(64)
                sizes = np.bincount(line[prefix], minlength=len(doc)) + 4
                ends = np.cumsum(sizes)
                body, head = np.empty(ends[-1], np.uint32), np.zeros(ends[-1], bool)
                at = (ends - sizes)[:, None] + np.arange(4)
                head[at] = True
                bits = [np.bitwise_xor.reduceat(np.where(h, bit, U(0)), first) for h in (half, ~half)]
                body[at] = np.stack(bits, 1).view(np.uint32)
                body[~head] = token[prefix] >> U(32)
                yield pa.RecordBatch.from_arrays(
                    [_keys(ids[texts.first + doc], number), pa.array(n, pa.int32()), *_prints(token, first), _packed(body, ends * 4)],
                    ["key", "n", "fp1", "fp2", "body"],
                )

    return run


def _dealt(counts: Broadcast, num: int, den: int, asked: Broadcast | None, words_asked: Broadcast | None):
    """Rows for every prefix word of a line and every group that it is in."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        rarity = counts.value
        for batch in batches:
            key, n = _key_words(batch.column("key")), batch.column("n").to_numpy().astype(np.int64)
            flat, where = _unpacked(batch.column("body"), np.uint32)
            inside = np.ones(len(flat), bool)
            head = where[:-1, None] + np.arange(4)
            inside[head] = False
            bits = flat[head].view(U)
            size = np.diff(where) - 4
            row, token = np.repeat(np.arange(len(n)), size), flat[inside]
            first = n - needed(n, num, den) + 1 - size - (np.cumsum(size) - size)
            at = np.arange(len(row)) + first[row]
            if words_asked is not None:
                keep = _passes(words_asked.value, _id_hash(token))
                row, token, at = row[keep], token[keep], at[keep]
            ask = np.zeros(len(n), bool) if asked is None else _passes(asked.value, _key_hash(key))
            chunks = rarity[token >> np.uint32(32 - BITS)].astype(np.int64) // CHUNK + 1
            mine = (mix(_key_hash(key), 8) >> U(1)).astype(np.int64)[row] % chunks
            total = np.cumsum(chunks)
            begin = 0
            while begin < len(row):
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + WIDE, "right")))
                part = np.repeat(np.arange(begin, end), chunks[begin:end])
                other = np.arange(len(part)) - np.repeat(total[begin:end] - chunks[begin:end] - (total[begin - 1] if begin else 0), chunks[begin:end])
                own = mine[part]
                low, high = np.minimum(own, other), np.maximum(own, other)
                r = row[part]
                out = np.empty(len(part), _ROW)
                out["key"], out["bits"], out["n"], out["at"] = key[r], bits[r], n[r], at[part]
                out["own"] = own * 4 + ask[r] * 2 + (low == high)
                pair = (low * 65536 + high) & 0xFFFFFFFF
                out["group"] = (token[part].astype(U) << U(32)) | pair.astype(U)
                yield out
                begin = end

    return rows


def _in_buckets(rows, buckets: int):
    """(bucket, rows) of the given rows, packed."""

    def packed(kept: list[np.ndarray]) -> pa.RecordBatch:
        out = np.concatenate(kept)
        bucket = (mix(out["group"], 14) % U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        place = np.arange(len(out)) - np.repeat(first, np.diff(np.append(first, len(out))))
        begin = np.flatnonzero(place % PACK == 0)
        ends = np.append(begin[1:], len(out)) * _ROW.itemsize
        return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), _packed(out[order], ends)], ["bucket", "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for out in rows(batches):
            kept.append(out)
            if sum(map(len, kept)) >= WIDE:
                yield packed(kept)
                kept = []
        if kept:
            yield packed(kept)

    return run


def _passes(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h & U(MARKS - 1)
    return (bitmap[(h >> U(3)).astype(np.int64)] >> (h & U(7)).astype(np.uint8)) & 1 == 1


def _key_marks(column: pa.Array) -> np.ndarray:
    return _key_hash(_key_words(column))


def _doc_marks(column: pa.Array) -> np.ndarray:
    """Of the keys' documents."""
    key = _key_words(column)
    return _id_hash((key[:, 1] << 32) | (key[:, 0] >> 32 & 0xFFFFFFFF))


def _word_marks(column: pa.Array) -> np.ndarray:
    return _id_hash(column.to_numpy())


def bitmap_of(keys: DataFrame, marks) -> Broadcast:
    """A bitmap of hashed values (one column), ``MARKS`` bits whatever their number.

    Tasks send their bits in pieces; those of a piece are joined where they meet.
    """

    def pieces(own: np.ndarray) -> pa.RecordBatch:
        rows = own.reshape(-1, PIECE)
        used = np.flatnonzero(rows.any(1))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([rows[i].tobytes() for i in used], pa.binary())], ["piece", "bits"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(MARKS // 8, np.uint8)
        for batch in batches:
            h = marks(batch.column(0)) & U(MARKS - 1)
            np.bitwise_or.at(own, (h >> U(3)).astype(np.int64), (U(1) << (h & U(7))).astype(np.uint8))
        yield pieces(own)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((MARKS // 8 // PIECE, PIECE), np.uint8)
        for batch in batches:
            for piece, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own[piece] |= np.frombuffer(bits, np.uint8)
        yield pieces(own)

    schema = "piece int, bits binary"
    out = np.zeros(MARKS // 8, np.uint8)
    for piece, bits in keys.mapInArrow(tidy(marked), schema).repartition("piece").mapInArrow(tidy(joined), schema).collect():
        out[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out)


class _Rows:
    """Columns of the rows of whole groups in numpy, by group; keys as two words."""

    def __init__(self, batch: pa.RecordBatch):
        rows, _ = _unpacked(batch.column("lines"), _ROW)
        rows = rows[np.argsort(rows["group"], kind="stable")]
        self.group = rows["group"].copy()
        col = lambda name: np.ascontiguousarray(rows[name])
        self.n, self.key, self.bits, self.bits2 = col("n").astype(np.int64), col("key"), col("bits")[:, 0].copy(), col("bits")[:, 1].copy()
        self.high, self.low = self.key[:, 1].copy(), self.key[:, 0].astype(U)
        self.rest = self.n - rows["at"]
        self.own, self.ask, self.alone = rows["own"] >> 2, rows["own"] & 2 > 0, rows["own"] & 1 > 0

    def fit(self, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Where the pairs of rows stand that pass all filters."""
        na, nb = self.n[a], self.n[b]
        total = na + nb
        left = np.flatnonzero(np.minimum(na, nb) * (den + num) >= total * num)
        for test in (self._enough, self._near, self._meet):
            left = left[test(a[left], b[left], total[left], num, den)]
        return left

    def _enough(self, a, b, total, num, den):
        return np.minimum(self.rest[a], self.rest[b]) * (num + den) >= total * num

    def _near(self, a, b, total, num, den):
        differ = np.bitwise_count(self.bits[a] ^ self.bits[b]).astype(np.int64) + np.bitwise_count(self.bits2[a] ^ self.bits2[b])
        return differ * (den + num) <= total * (den - num)

    def _meet(self, a, b, total, num, den):
        return (self.alone[a] | (self.own[a] != self.own[b])) & ((self.low[a] != self.low[b]) | (self.high[a] != self.high[b]))

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the key of ``a`` is the greater one."""
        return (self.high[a] > self.high[b]) | ((self.high[a] == self.high[b]) & (self.low[a] > self.low[b]))


def _small_groups(rows: _Rows, start: np.ndarray, later: np.ndarray, everything: bool, num: int, den: int):
    """All passing pairs of the rows ``later`` with the rows before them in their group; with
    ``everything``, those whose later row asks."""
    width = later - start
    cut = np.searchsorted(np.cumsum(width), np.arange(1 << 18, int(width.sum()) + (1 << 18), 1 << 18), "left") + 1
    at = 0
    for end in np.unique(np.minimum(cut, len(later))):
        w, s = width[at:end], start[at:end]
        b = np.repeat(later[at:end], w)
        a = np.arange(len(b)) - np.repeat(np.cumsum(w) - w - s, w)
        ok = rows.fit(a, b, num, den)
        a, b = a[ok], b[ok]
        swap = rows.after(a, b)
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        yield (a[rows.ask[b]], b[rows.ask[b]]) if everything else (a, b)
        at = end


def _large_group(rows: _Rows, index: np.ndarray, everything: bool, num: int, den: int):
    """The first passing pair of every row of a group, or all pairs whose later row asks.
    ``index`` holds its rows in the order of their keys."""
    for at in range(0, len(index), 256):
        b = np.arange(at, min(len(index), at + 256))
        if everything:
            b = b[rows.ask[index[b]]]
            if not len(b):
                continue
        for low in range(0, b[-1], 1024):
            a = np.arange(low, min(low + 1024, b[-1]))
            x, y = np.tile(a, len(b)), np.repeat(b, len(a))
            chosen = x < y
            x, y = x[chosen], y[chosen]
            ok = rows.fit(index[x], index[y], num, den)
            x, y = x[ok], y[ok]
            if everything:
                yield index[x], index[y]
                continue
            y, where = np.unique(y, return_index=True)
            yield index[x[where]], index[y]
            b = np.setdiff1d(b, y)
            if not len(b):
                break


def _candidates(num: int, den: int, everything: bool):
    """(a, b, word): pairs of keys, ``a`` earlier; the group's word if ``b`` may have other
    candidates there, else null."""

    def pairs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = _Rows(batch)
        begin = np.flatnonzero(np.append(True, rows.group[1:] != rows.group[:-1]))
        size = np.diff(np.append(begin, len(rows.group)))
        start = np.repeat(begin, size)
        small = np.repeat(size <= SMALL, size)
        later = np.flatnonzero(small & (np.arange(len(start)) > start))
        found = list(_small_groups(rows, start[later], later, everything, num, den))
        for g in np.flatnonzero(size > SMALL):
            index = np.arange(begin[g], begin[g] + size[g])
            index = index[np.lexsort((rows.low[index], rows.high[index]))]
            found += _large_group(rows, index, everything, num, den)
        if not found:
            return
        a, b = (np.concatenate(x) for x in zip(*found))
        if everything:
            more = np.zeros(len(b), bool)
        else:
            order = np.lexsort((rows.low[a], rows.high[a], b))
            a, b = a[order], b[order]
            first = np.concatenate(([True], b[1:] != b[:-1])) if len(b) else np.zeros(0, bool)
            count = np.diff(np.append(np.flatnonzero(first), len(b)))
            a, b = a[first], b[first]
            more = (count > 1) | ~small[b]
        word = (rows.group[b] >> U(32)).astype(np.int64)
        keys = [pa.Array.from_buffers(pa.decimal128(38), len(x), [None, pa.py_buffer(rows.key[x].tobytes())]) for x in (a, b)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(word, mask=~more)], ["a", "b", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ("bucket",)):
            yield from pairs(batch)

    return run


def _wanted_sets(docs_wanted: Broadcast, wanted: Broadcast):
    """(key, sorted distinct word hashes) of lines of (doc_id, text): all wanted ones, and some others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_passes(docs_wanted.value, _id_hash(batch.column(0).to_numpy()))))
            ids = batch.column(0).to_numpy()
            for texts in slices(batch.column(1)):
                start, end, doc, number = line_ranges(texts)
                key = _keys(ids[texts.first + doc], number)
                pick = np.flatnonzero(_passes(wanted.value, _key_marks(key)))
                size = (end - start)[pick]
                ends = np.cumsum(size)
                # the bytes of these lines alone
                where = np.arange(size.sum()) + np.repeat(start[pick] - (ends - size), size)
                w = words(Texts(0, texts.data[where], np.append(0, ends)), lower=True)
                token, line = w.hash, w.doc
                order = np.lexsort((token, line))
                token, line = token[order], line[order]
                fresh = np.ones(len(token), bool)
                fresh[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
                sizes = np.append(0, np.cumsum(np.bincount(line[fresh], minlength=len(pick))))
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array(pick)), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(token[fresh].view(np.int64)))],
                    ["key", "members"],
                )

    return run


def _verified(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` of stored keys, ``a`` earlier, whose lines match."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    sets = _wanted_sets(bitmap_of(keys, _doc_marks), bitmap_of(keys, _key_marks))
    # rows that repeat an id may give a key several sets
    members = stash(texts.mapInArrow(tidy(sets), f"key {_KEY}, members array<bigint>").distinct())
    for end in "ba":
        pairs = pairs.join(members.select(F.col("key").alias(end), F.col("members").alias(f"m{end}")), end)
    both = F.size(F.array_intersect("ma", "mb")).cast("bigint")
    return (
        pairs.select("a", "b", both.alias("both"), (F.size("ma") + F.size("mb")).cast("bigint").alias("total"))
        .where(F.col("both") * den >= (F.col("total") - F.col("both")) * num)
        .select("a", "b")
    )


def repeated_lines(docs: DataFrame, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, line)``: every line to remove, with no row for other lines.

    ``line`` counts ``\\n``-split lines from 0. A line goes if an earlier one, in the order
    of (doc_id, line), has Jaccard similarity of at least num/den with it on the sets of
    lower-cased words; it does not matter whether the earlier one goes itself. Lines
    without words never match. Documents with a null id keep all lines. Rows that repeat
    an id are one document: a line goes if it goes in one of them. An empty table gives an
    empty result; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    counts = word_counts(texts, "text")
    described = stash(texts.mapInArrow(tidy(_described(counts, num, den)), f"key {_KEY}, n int, fp1 bigint, fp2 bigint, body binary"))
    same = ["n", "fp1", "fp2"]
    sets = stash(described.groupBy(*same).agg(F.min("key").alias("first"), F.count("*").alias("lines")).where("lines > 1").drop("lines"))
    copies = stash(described.select(*same, "key").join(sets, same).where("key > first").drop("first"))
    marked = bitmap_of(copies.select("key"), _key_marks)

    def among_copies(yes: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_passes(marked.value, _key_marks(batch.column("key"))) == yes))

        return run

    # most lines are no copy by the bitmap and need no join
    cleared = stash(described.mapInArrow(tidy(among_copies(True)), described.schema).join(copies, [*same, "key"], "left_anti").select("key", "n", "body"))
    buckets = max(1 << 10, described.count() // BUCKET)

    def candidates(asked: Broadcast | None = None, words_asked: Broadcast | None = None) -> DataFrame:
        deal, schema = tidy(_in_buckets(_dealt(counts, num, den, asked, words_asked), buckets)), "bucket int, lines binary"
        single = described.select("key", "n", "body").mapInArrow(lambda batches: deal(among_copies(False)(batches)), schema)
        met = single.union(cleared.mapInArrow(deal, schema)).repartition("bucket").sortWithinPartitions("bucket")
        found = met.mapInArrow(tidy(_candidates(num, den, asked is not None)), f"a {_KEY}, b {_KEY}, word bigint")
        # a line has few prefix words, so the list is short
        return stash(found.groupBy("a", "b").agg(F.collect_set("word").alias("words")))

    tried = candidates()
    gone = stash(_verified(tried.select("a", "b"), texts, num, den).select(F.col("b").alias("key")).distinct())
    removed = copies.select("key").union(gone)
    open_ = stash(tried.where("size(words) > 0").select(F.col("b").alias("key"), "words").join(gone, "key", "left_anti"))
    if not open_.isEmpty():
        # only in the groups of these words candidates are left
        prefixes = open_.select(F.explode("words").alias("token"))
        rest = candidates(bitmap_of(open_.select("key"), _key_marks), bitmap_of(prefixes, _word_marks))
        rest = stash(rest.select("a", "b").join(tried.select("a", "b"), ["a", "b"], "left_anti"))
        removed = removed.union(_verified(rest, texts, num, den).select(F.col("b").alias("key")))
    removed = removed.distinct()
    return removed.select(
        F.floor(F.col("key") / F.lit(2**32)).cast("bigint").alias("doc_id"), F.pmod("key", F.lit(2**32)).cast("bigint").alias("line")
    )


def line_report(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """``(doc_id, n_lines, n_removed, removed)`` per document id: ``\\n``-split lines, and
    the numbers of those that go. Null ids form one row without removals."""
    gone = repeated_lines(docs, num, den).groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    count = F.when(F.col("text") == "", 0).otherwise(breaks + 1)
    sizes = docs.select("doc_id", F.coalesce(count, F.lit(0)).cast("bigint").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n_lines"))
    return sizes.join(gone, "doc_id", "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"),
    )


def dedup_lines(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` without the repeated lines, the same columns; ``n_chars``, where present,
    follows the text. Documents that lose all their words go; those without any stay."""
    gone = repeated_lines(docs, num, den).groupBy(F.col("doc_id").alias("d")).agg(F.collect_set("line").alias("gone"))
    rows = docs.select(F.struct("*").alias("row")).join(gone, F.col("row.doc_id") == F.col("d"), "left")

    def left_of(text: Column) -> Column:
        # by hash, so linear in the lines of a text
        stay = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.size(text["parts"]).cast("bigint") - 1), text["gone"])
        return F.array_join(F.transform(stay, lambda i: F.get(text["parts"], i.cast("int"))), "\n")

    # an argument of a lambda is computed once, wherever the optimizer moves the expression
    split = F.array(F.struct(F.split("row.text", "\n").alias("parts"), "gone"))
    joined = F.get(F.transform(split, left_of), F.lit(0))
    cut = rows.select("row", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(joined).alias("text"), F.col("gone").isNotNull().alias("cut"))
    cut = cut.where("not cut or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("cut"), n_chars).otherwise(F.col("row.n_chars"))
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
