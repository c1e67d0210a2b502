"""SentencePiece BPE encoding by a prefix table, and decoding.

For every prefix of a text there is exactly one piece that can be last in its encoding:
the piece ``t`` that ends there such that the last piece before ``t`` and ``t`` are
compatible, that is, merging their two strings alone leaves them as they are. The table of
these last pieces is filled from left to right: all pieces that end at a position come
from an automaton (a trie walked from every start at once), the pair test picks the one
that fits, and the ids are read backwards from the end.

The pair test follows the merge types along the boundary: the right spine of the left
piece and the left spine of the right piece, each piece knowing the two it is merged from.
Pieces whose parts are not merged strictly earlier (runs of the space mark) are tested by
merging the two strings outright.

No piece holds a space mark after another character, so texts are cut before such marks,
and around characters that no longer piece contains. Different cut pieces of a batch are
encoded once, together, in numpy; ids are gathered for all texts at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplake.llm.text import slices, tidy

MARK = "▁"
MODEL = "piece_bpe_32k.model"
SLICE = 2 << 20  # bytes of text at a time
CHUNK = 1 << 14  # cut pieces encoded together
MEMORY = 300_000  # different cut pieces remembered by a task


def merge(symbols: list[str], rank: dict[str, int]) -> list[str]:
    """Plain BPE: join the adjacent pair of best rank, the leftmost of equals, until none is left."""
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank), default=None)
        if best is None:
            return symbols
        i = best[1]
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


class Lookup:
    """A fixed map of non-negative integers: one hashed slot, keys that collide in a sorted rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int):
        self.shift = np.uint64(64 - bits)
        slot = self._slot(keys)
        own, first = np.unique(slot, return_index=True)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        self.keys[own], self.values[own] = keys[first], values[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.rest, self.rest_values = keys[rest], values[rest]
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[slot[rest]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for keys that are not in the map."""
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1).astype(np.int64)
        again = np.flatnonzero(self.crowded[slot] & (out < 0))
        if len(again):
            at = np.minimum(np.searchsorted(self.rest, keys[again]), len(self.rest) - 1)
            out[again] = np.where(self.rest[at] == keys[again], self.rest_values[at], -1)
        return out


class Pieces:
    """Tables of a model: trie, merge types (the two parts of every piece), bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(MARK in self.text[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece holds a space mark inside")
        # equal scores are equal ranks: the leftmost pair goes first
        scores = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        self.rank = {self.text[i]: scores[sp.get_score(i)] for i in normal}
        self.id = {self.text[i]: i for i in normal}
        self.level = np.full(n, -1, np.int64)  # the rank, -1 for single characters
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.odd = np.zeros(n, bool)  # parts not merged strictly earlier
        reachable = []
        for i in normal:
            piece = self.text[i]
            if len(piece) > 1:
                parts = self._halves(piece)
                if parts is None:
                    continue  # merging never yields it
                self.level[i] = self.rank[piece]
                a, b = self.id.get(parts[0]), self.id.get(parts[1])
                if a is None or b is None:
                    self.odd[i] = True
                else:
                    self.left[i], self.right[i] = a, b
                    own = self.rank[piece]
                    self.odd[i] = any(len(p) > 1 and self.rank[p] >= own for p in parts)
            reachable.append(i)
        self._spread_odd(reachable)
        self._build_trie(reachable)
        self._build_pairs(reachable)
        long = {c for i in reachable if len(self.text[i]) > 1 for c in self.text[i]}
        cut = "".join(re.escape(c) for c in "\n\t\r" if c not in long)
        body = f"[^{MARK}{cut}]"
        self.cutter = re.compile(f"{MARK}*{body}+|{MARK}+" + (f"|[{cut}]" if cut else ""))
        self.surface = [self.text[i].replace(MARK, " ").encode() for i in range(n)]
        for value, i in self.bytes.items():
            self.surface[i] = bytes([value])
        for i in range(n):
            if sp.is_control(i):
                self.surface[i] = b""
        self.tested_pair, self.outcome = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.odd_pairs: dict[tuple[int, int], bool] = {}

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge of the piece's own characters joins."""
        symbols = list(piece)
        while len(symbols) > 2:
            best = min(
                ((self.rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.rank), default=None
            )
            if best is None:
                return None
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return (symbols[0], symbols[1]) if symbols[0] + symbols[1] in self.rank else None

    def _spread_odd(self, pieces: list[int]) -> None:
        for i in sorted(pieces, key=lambda i: len(self.text[i])):
            if self.left[i] >= 0 and (self.odd[self.left[i]] or self.odd[self.right[i]]):
                self.odd[i] = True

    def _build_trie(self, pieces: list[int]) -> None:
        chars = sorted({c for i in pieces for c in self.text[i]})
        self.n_chars = len(chars)
        self.char = np.full(0x110000, -1, np.int32)  # by code point
        self.char[[ord(c) for c in chars]] = np.arange(len(chars))
        number = {c: k for k, c in enumerate(chars)}
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i in pieces:
            at = 0
            for c in self.text[i]:
                at = nodes.setdefault((at, number[c]), len(ends))
                if at == len(ends):
                    ends.append(-1)
            ends[at] = i
        self.ends = np.array(ends, np.int64)
        keys = np.array([a * len(chars) + c for a, c in nodes], np.int64)
        self.edges = Lookup(keys, np.array(list(nodes.values()), np.int64), 19)
        self.roots = self.edges(np.arange(len(chars)))  # nodes after a first character

    def _build_pairs(self, pieces: list[int]) -> None:
        """All (a, b) whose strings together are a piece, with its rank."""
        keys, ranks = [], []
        for i in pieces:
            piece = self.text[i]
            for k in range(1, len(piece)):
                a, b = self.id.get(piece[:k]), self.id.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a * len(self.text) + b)
                    ranks.append(self.rank[piece])
        self.pairs = Lookup(np.array(keys, np.int64), np.array(ranks, np.int64), 20)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As :meth:`tested`, with the outcome of every pair kept in its slot until another needs it."""
        pair = a * len(self.text) + b
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        out = self.outcome[slot]
        new = np.flatnonzero(self.tested_pair[slot] != pair)
        if len(new):
            out[new] = self.tested(a[new], b[new])
            # of new pairs with one slot the last one written stays, in both arrays
            self.tested_pair[slot[new]], self.outcome[slot[new]] = pair[new], out[new]
        return out

    def tested(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the strings of piece ``a`` and piece ``b`` leaves the two apart.

        From the pieces inwards: a pair at the boundary would have merged if its rank is
        below that of the next merge on either side. The later one of the two sides is
        then undone.
        """
        out = np.ones(len(a), bool)
        odd = self.odd[a] | self.odd[b]
        for i in np.flatnonzero(odd):
            pair = (int(a[i]), int(b[i]))
            if pair not in self.odd_pairs:
                x, y = self.text[pair[0]], self.text[pair[1]]
                self.odd_pairs[pair] = merge(list(x + y), self.rank) == [x, y]
            out[i] = self.odd_pairs[pair]
        live = np.flatnonzero(~odd)
        x, y = a[live], b[live]
        far = np.int64(1) << 40
        # ranks of the merges that end each side's present piece; the boundary pair must be better
        after_x, after_y = np.full(len(live), far), np.full(len(live), far)
        while len(live):
            rank = self.pairs(x * len(self.text) + y)
            # of equal ranks the leftmost goes first: the left side's before the pair, the pair before the right side's
            merged = (rank >= 0) & (rank < after_x) & (rank <= after_y)
            out[live[merged]] = False
            lx, ly = self.level[x], self.level[y]
            go = ~merged & ((lx >= 0) | (ly >= 0))
            live, x, y, lx, ly, after_x, after_y = (v[go] for v in (live, x, y, lx, ly, after_x, after_y))
            undo_y = ly >= lx  # the right side's merge comes later, also of equals
            after_x, after_y = np.where(undo_y, after_x, lx), np.where(undo_y, ly, after_y)
            x, y = np.where(undo_y, x, self.right[x]), np.where(undo_y, self.left[y], y)
        return out

    def encode_cuts(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each string (without any mark added) as flat values and offsets."""
        lengths = np.array([len(c) for c in cuts], np.int64)
        base = np.concatenate(([0], np.cumsum(lengths)))
        points = np.frombuffer("".join(cuts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        total = len(points)
        char = self.char[points].astype(np.int64)
        stop = np.repeat(base[1:], lengths)
        # automaton: all matches (start, length, piece), grouped by the position where they end
        ends, sizes, found = [], [], []
        start = np.flatnonzero(char >= 0)
        node = self.roots[char[start]]
        depth = 1
        while len(start):
            piece = self.ends[node]
            hit = piece >= 0
            ends.append(start[hit] + depth)
            sizes.append(np.full(int(hit.sum()), depth))
            found.append(piece[hit])
            at = start + depth
            on = np.flatnonzero(at < stop[start])
            step = char[at[on]]
            on, step = on[step >= 0], step[step >= 0]
            target = self.edges(node[on] * self.n_chars + step)
            start, node = start[on][target >= 0], target[target >= 0]
            depth += 1
        lone = np.flatnonzero((char < 0) | (self.ends[self.roots[np.maximum(char, 0)]] < 0))
        ends.append(lone + 1)
        sizes.append(np.ones(len(lone), np.int64))
        found.append(np.full(len(lone), -1))  # a character without a piece stands alone
        ends, sizes, found = map(np.concatenate, (ends, sizes, found))
        column = ends - 1 - np.repeat(base[:-1], lengths)[ends - 1]  # position inside its string
        order = np.argsort(column.astype(np.uint16) if lengths.max(initial=0) < 1 << 16 else column, kind="stable")
        ends, sizes, found, column = ends[order], sizes[order], found[order], column[order]
        last = np.full(total + 1, -3, np.int64)  # the prefix table, by global end position
        size = np.zeros(total + 1, np.int64)
        steps = np.searchsorted(column, np.arange(int(lengths.max(initial=0)) + 1))
        for a, b in zip(steps[:-1], steps[1:]):  # all strings advance by one character
            e, s, t = ends[a:b], sizes[a:b], found[a:b]
            first = column[a:b] + 1 == s
            before = np.where(first, -2, last[e - s])
            ok = first | (before == -1) | (t == -1)
            test = np.flatnonzero(~ok & (before >= 0))
            ok[test] = self.compatible(before[test], t[test])
            last[e[ok]], size[e[ok]] = t[ok], s[ok]
        # backwards from every end at once
        at = base[1:].copy()
        rows, ids, spans = [], [], []
        active = np.flatnonzero(lengths > 0)
        while len(active):
            e = at[active]
            rows.append(active)
            ids.append(last[e])
            spans.append(e)
            at[active] = e - size[e]
            active = active[at[active] > base[active]]
        if not rows:
            return np.zeros(0, np.int32), np.zeros(len(cuts) + 1, np.int64)
        rows, ids, spans = map(np.concatenate, (rows, ids, spans))
        if (ids < -1).any():
            raise AssertionError("a prefix without a last piece")
        order = np.argsort(spans, kind="stable")
        rows, ids, spans = rows[order], ids[order], spans[order]
        fallback = ids == -1
        if fallback.any():
            raw = {int(p): [self.bytes[b] for b in chr(p).encode("utf-8", "surrogatepass")] for p in np.unique(points[spans[fallback] - 1])}
            width = np.ones(len(ids), np.int64)
            width[fallback] = [len(raw[int(p)]) for p in points[spans[fallback] - 1]]
            rows = np.repeat(rows, width)
            flat = np.repeat(ids, width)
            flat[flat == -1] = [i for p in points[spans[fallback] - 1] for i in raw[int(p)]]
            ids = flat
        return ids.astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(cuts)))))

    def cuts(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The cut pieces of all texts, dictionary encoded, and how many each text has.

        Between single spaces every word is a cut piece behind a space mark; a line break
        begins one without. Texts with runs of spaces or space marks go through the regular
        expression.
        """
        plain = pc.invert(pc.match_substring_regex(texts, f"^ |  | \n| $|{MARK}"))
        plain = pc.and_(plain, pc.not_equal(texts, ""))
        words = pc.split_pattern(pc.replace_substring(texts.filter(plain), "\n", " \n"), " ")
        flat = words.flatten()
        marked = pc.binary_join_element_wise(pc.if_else(pc.starts_with(flat, "\n"), "", MARK), flat, "")
        counts = np.zeros(len(texts), np.int64)
        chosen = plain.to_numpy(zero_copy_only=False)
        counts[chosen] = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        if not chosen.all():
            own = [self.cutter.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts.filter(pc.invert(plain)).to_pylist()]
            counts[~chosen] = [len(o) for o in own]
            # texts stay in order: the pieces of the two kinds are put where their text stands
            mixed = pa.concat_arrays([marked, pa.array([c for o in own for c in o], marked.type)])
            text = np.concatenate((np.repeat(np.flatnonzero(chosen), counts[chosen]), np.repeat(np.flatnonzero(~chosen), counts[~chosen])))
            marked = mixed.take(pa.array(np.argsort(text, kind="stable")))
        return marked.dictionary_encode(), counts

    def encoder(self):
        """A function from texts to (flat ids, offsets) that remembers cut pieces it has met."""
        known: dict[str, int] = {}
        values, offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

        def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            nonlocal values, offsets
            if len(known) > MEMORY:
                known.clear()
                values, offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
            coded, count = self.cuts(texts)
            own = coded.dictionary.to_pylist()
            fresh = [c for c in own if c not in known]
            parts = [self.encode_cuts(fresh[i : i + CHUNK]) for i in range(0, len(fresh), CHUNK)]
            if fresh:
                known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
                widths = np.concatenate([np.diff(ends) for _, ends in parts])
                offsets = np.concatenate((offsets, offsets[-1] + np.cumsum(widths)))
                values = np.concatenate((values, *[v for v, _ in parts]))
            place = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
            code = place[coded.indices.to_numpy()]
            width = offsets[code + 1] - offsets[code]
            where = np.concatenate(([0], np.cumsum(width)))
            take = np.arange(where[-1]) - np.repeat(where[:-1] - offsets[code], width)
            return values[take], where[np.concatenate(([0], np.cumsum(count)))]

        return encode

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are not UTF-8 are left to the library's rule."""
        raw = b"".join([self.surface[i] for i in ids])
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            return self.library.decode([int(i) for i in ids])
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def _shipped(spark, model_path: str) -> str:
    """Send the model file to the executors; returns its name there."""
    spark.sparkContext.addFile(model_path)
    return model_path.rsplit("/", 1)[-1]


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", round_trip: bool = False
) -> DataFrame:
    """``(doc_id, ids array<int>)``, a row for each row of ``docs``; no begin or end ids.

    With ``round_trip`` a column ``decoded`` follows: the ids decoded again in the same
    pass. Null and empty texts have no ids. Characters without a piece become byte pieces.
    Ids of documents may be null or repeat; other columns are not read.
    """
    name = _shipped(docs.sparkSession, model_path)
    names = ["doc_id", "ids", *["decoded"] * round_trip]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(SparkFiles.get(name))
        encoder = pieces.encoder()
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            for texts in slices(column, SLICE):
                ids, offsets = encoder(column.slice(texts.first, len(texts)))
                out = [
                    batch.column(0).slice(texts.first, len(texts)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                ]
                if round_trip:
                    out.append(pa.array([pieces.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id bigint, ids array<int>" + ", decoded string" * round_trip
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` from ``(doc_id, ids)``; null ids count as none."""
    name = _shipped(encoded.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(SparkFiles.get(name))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(1)
                flat, where = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
                out = [pieces.decode(flat[a:b].tolist()) for a, b in zip(where[:-1], where[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

    filled = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return filled.mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")
