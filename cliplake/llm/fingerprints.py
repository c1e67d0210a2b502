"""SimHash fingerprints and a Hamming search by permuted block tables (DataFrame functions only).

Terms are the pairs of neighbouring lower-cased words, the last word also alone. Every
occurrence of a term votes with the 64 bits of its hash, a set bit for and a clear bit
against, so a term weighs as often as it occurs; a bit of the fingerprint is set where more
votes are for it. Votes are counted eight bits at a time: ``h >>> j & 0x0101..01`` holds the
bits ``j, j + 8, ..`` as bytes, 127 terms add up in one long before its top byte meets the sign,
and only these sums are taken apart.

The search splits the 64 bits into ``radius + 3`` blocks. Two fingerprints within the
radius differ in at most ``radius`` blocks and agree in three others. There is a table for
every choice of three blocks (Manku et al. permute them to the front); rows meet where the
three blocks are equal, some 30 bits for radius 3, and the whole distance is tested there. A pair
counts in the table of its three lowest agreeing blocks alone, so none is met twice.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplake.llm.tables import stash

BITS = 64
LANES = 0x0101010101010101
PER_CHUNK = 127  # the top byte must stay below the sign bit
SEPARATORS = r"[\x20\x09-\x0D]+"


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _long(x: int) -> Column:
    return F.lit(_signed(x)).cast("bigint")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda over a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_hashes(text: Column) -> Column:
    """Hashes of all terms of a text in order, with repeats."""
    words = F.array_remove(F.split(F.lower(text), SEPARATORS), "")
    return _let(words, lambda w: F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.xxhash64(a, b)))


def _chunk_votes(terms: Column) -> Column:
    """Eight longs: byte ``i`` of long ``j`` counts the terms with bit ``8 * i + j``."""

    def lane(j: int) -> Column:
        return F.aggregate(terms, _long(0), lambda acc, h: acc + F.shiftrightunsigned(h, j).bitwiseAND(_long(LANES)))

    return F.array(*[lane(j) for j in range(8)])


def votes(hashes: Column) -> Column:
    """For every bit the number of terms that have it set."""

    def from_chunks(chunks: Column) -> Column:
        def bit(b: Column) -> Column:
            lane, shift = (b % 8).cast("int"), (b - b % 8).cast("int")
            return F.aggregate(
                chunks,
                _long(0),
                lambda acc, c: acc + F.call_function("shiftrightunsigned", F.get(c, lane), shift).bitwiseAND(_long(255)),
            )

        return F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit)

    def from_terms(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(h), F.lit(1)), F.lit(PER_CHUNK))
        return _let(F.transform(starts, lambda s: _chunk_votes_of(F.slice(h, s, F.lit(PER_CHUNK)))), from_chunks)

    def _chunk_votes_of(piece: Column) -> Column:
        return _let(piece, _chunk_votes)

    return _let(hashes, from_terms)


def simhash(text: Column) -> Column:
    """The 64-bit fingerprint of a text as a bigint; 0 without words. Null counts as empty."""

    def decide(h: Column) -> Column:
        half = F.size(h).cast("bigint")
        return F.aggregate(
            F.zip_with(votes(h), F.sequence(F.lit(0), F.lit(BITS - 1)), lambda n, b: F.when(n * 2 > half, F.call_function("shiftleft", _long(1), b)).otherwise(_long(0))),
            _long(0),
            lambda acc, x: acc.bitwiseOR(x),
        )

    return _let(term_hashes(F.coalesce(text, F.lit(""))), decide)


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), BITS // 4, "0")


def likeness(a: Column, b: Column) -> Column:
    """1 minus the share of bits that differ."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


# ------------------------------------------------------------------ search
def block_masks(radius: int) -> list[int]:
    """``radius + 3`` blocks of nearly equal width that cover all bits."""
    n = radius + 3
    if not 0 <= radius <= BITS - 3:
        raise ValueError("radius must lie between 0 and 61")
    edges = [BITS * i // n for i in range(n + 1)]
    return [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]


def near_fingerprints(queries: DataFrame, index: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs ``(fingerprint, found, distance)`` within the radius, each once.

    Both inputs have a bigint column ``fingerprint``; repeats and nulls are dropped first.
    Pairs of equal values are found at distance 0. Every table is keyed by its number and
    the bits of its blocks, so a hot key is a bucket of different fingerprints in one table;
    adaptive execution splits it and the join emits only what passes the whole test.
    """
    blocks = block_masks(radius)
    tables = list(combinations(range(len(blocks)), 3))
    entries = [
        F.struct(F.lit(t).alias("t"), F.col("fingerprint").bitwiseAND(_long(sum(blocks[b] for b in table))).alias("key"))
        for t, table in enumerate(tables)
    ]

    def filed(rows: DataFrame, name: str) -> DataFrame:
        distinct = rows.where(F.col("fingerprint").isNotNull()).select("fingerprint").distinct()
        return distinct.select(F.col("fingerprint").alias(name), F.inline(F.array(*entries)))

    differ = F.col("a").bitwiseXOR(F.col("b"))
    met_first = F.lit(False)  # the table's blocks are the three lowest that agree
    for t, table in enumerate(tables):
        lower = [b for b in range(table[-1]) if b not in table]
        apart = F.col("q.t") == t
        for b in lower:
            apart = apart & (differ.bitwiseAND(_long(blocks[b])) != 0)
        met_first = met_first | apart
    met = (F.col("q.t") == F.col("i.t")) & (F.col("q.key") == F.col("i.key"))
    pairs = filed(queries, "a").alias("q").join(
        filed(index, "b").alias("i"), met & (F.bit_count(differ) <= radius) & met_first
    )
    return pairs.select(
        F.col("a").alias("fingerprint"), F.col("b").alias("found"), F.bit_count(differ).cast("int").alias("distance")
    )


def near_counts(prints: DataFrame, asked: Column, radius: int = 3) -> DataFrame:
    """``prints`` (with ``fingerprint``) and ``n_near``: how many other rows have a fingerprint
    within the radius; null where ``asked`` is not true.

    Rows with one fingerprint are one entry with a count, so copies are never paired.
    """
    counts = prints.groupBy("fingerprint").agg(F.count("*").alias("rows"))
    queries = prints.where(asked).select("fingerprint")
    pairs = near_fingerprints(queries, prints.select("fingerprint"), radius)
    sums = (
        pairs.join(counts.withColumnRenamed("fingerprint", "found"), "found")
        .groupBy("fingerprint").agg(F.sum("rows").alias("__all"))
    )
    return prints.join(sums, "fingerprint", "left").select(
        *[prints[c] for c in prints.columns], F.when(asked, F.col("__all") - 1).alias("n_near")
    )


# ------------------------------------------------------------------ edited texts
def next_ids(docs: DataFrame) -> DataFrame:
    """``(id, next_id, next_key, need)`` for every distinct id of ``(id, text)`` rows.

    Ids ascend, null first, and the last is followed by the first. ``next_key`` tells the
    row of the next id whose text counts (least hash), ``need`` is the largest quarter of
    the id's texts. Only ids and hashes are ordered, by range partitions: each is chained
    in itself, and the first row of every partition follows the last of the one before.
    """
    ids = docs.groupBy("id").agg(
        F.min(F.xxhash64("text")).alias("key"), F.max(F.floor(F.length("text") / 4)).cast("int").alias("need")
    )
    placed = stash(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    row = F.struct("id", "key")
    inside = Window.partitionBy("part").orderBy("id")
    parts = placed.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull(), F.col("id"), F.col("key"))).alias("f"))
    order = Window.orderBy("part")  # one row for each partition
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.struct(F.col("f.id").alias("id"), F.col("f.key").alias("key"))
    following = parts.select("part", F.coalesce(F.lead(head).over(order), F.first(head).over(whole)).alias("follow"))
    chained = placed.withColumn("n", F.lead(row).over(inside)).join(following, "part")
    chained = chained.withColumn("n", F.coalesce("n", "follow"))
    return chained.select("id", F.col("n.id").alias("next_id"), F.col("n.key").alias("next_key"), "need")


def _key(id_col: str) -> Column:
    """An id as a join key that is never null."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit("null"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint)``, a row
    for each row of ``docs``; fingerprints are bigints.

    The edited text has its last ``floor(n_chars / 4)`` code points replaced by as many (or
    all) from the start of the next document by id; the document of the last id is
    followed by that of the first, a lone one by itself. Null texts are empty ones. Rows that
    share an id have the same next document; where the next id has several rows, that of the
    least text hash counts. A null id is an id, before all others. An empty table gives none.

    Texts move once, by id. The next document sends only as much of its start as is asked for.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    links = stash(next_ids(rows)).select(_key("id").alias("owner"), _key("next_id").alias("next_id"), "next_key", "need")
    # both uses below read all these columns and no other, so that Spark deals the texts out once
    texts = rows.select(_key("id").alias("k"), "text", simhash(F.col("text")).alias("fp")).repartition("k")
    # the hash is tested beside the join, not by it, so that the texts stay where they are
    chosen = F.xxhash64("text").bitwiseXOR(F.col("next_key")) == 0
    starts = (
        texts.join(links, (F.col("k") == F.col("next_id")) & chosen)
        .select("owner", F.struct(F.left("text", F.col("need")).alias("start"), "fp").alias("next"))
        .groupBy("owner").agg(F.max("next").alias("next"))  # equal rows of one id give equal starts
    )
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - quarter), F.left("next.start", quarter))
    both = texts.join(starts, F.col("k") == F.col("owner"), "left").select(
        F.when(F.col("k") != "null", F.col("k").cast("bigint")).alias("id"), n.cast("bigint").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"), edited.alias("edited")
    )
    return both.select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"),
        simhash(F.col("edited")).alias("edited_fingerprint"), F.col("next_fp").alias("next_fingerprint"),
    )
