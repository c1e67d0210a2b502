"""How document filters interact over all orders: wide packed counters.

A document's outcome under every order of the filters depends on nothing but the set of
filters it fails (its mask) and two marks. So each of the 128 (mask, good, toxic) triples is
mapped once to a big integer whose 64-bit fields hold what one such document adds to the
seven counters of all 600 (order, step) pairs. Documents are counted per part and triple;
a part's result is the sum of at most 128 integers times their counts, unpacked field by
field. No field can overflow: the largest is 120 times the rows of a part, and that is
checked to lie below 2^63.

What moves between tasks is a narrow row per document (id, digest of the text, mask). Copies
of a text are combined per task before they meet, and which copy was first is settled on the
combinations of one text, never on its documents.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
FIELD = np.dtype("<u8")
SEPARATORS = r"[\x20\x09-\x0D]+"
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTERS)


def outcomes(mask: int, good: bool, toxic: bool) -> np.ndarray:
    """What one document that fails the filters of ``mask`` (bit 0 is A) adds to every counter,
    by order, step and counter."""
    fails = [bool(mask >> i & 1) for i in range(len(FILTERS))]
    out = np.zeros((len(ORDERS), len(FILTERS), len(COUNTERS)), FIELD)
    first_in = dict.fromkeys(FILTERS, 0)  # orders in which a filter is the one that removes
    for o, order in enumerate(ORDERS):
        gone = False
        for s, letter in enumerate(order):
            failing = fails[FILTERS.index(letter)]
            removed = failing and not gone
            out[o, s, 1:6] = removed, failing and gone, failing and sum(fails) == 1, removed and good, removed and toxic
            first_in[letter] += removed
            gone = gone or failing
            out[o, s, 0] = not gone
    for o, order in enumerate(ORDERS):
        out[o, :, 6] = [first_in[letter] for letter in order]
    return out


_packed: dict[tuple[int, bool, bool], int] = {}


def packed(mask: int, good: bool, toxic: bool) -> int:
    """The outcomes as one integer, a 64-bit field for each counter."""
    key = (mask, good, toxic)
    if key not in _packed:
        _packed[key] = int.from_bytes(outcomes(*key).tobytes(), "little")
    return _packed[key]


def unpack(total: int) -> np.ndarray:
    shape = (len(ORDERS), len(FILTERS), len(COUNTERS))
    return np.frombuffer(total.to_bytes(int(np.prod(shape)) * FIELD.itemsize, "little"), FIELD).reshape(shape)


def text_masks(text: Column) -> Column:
    """Bits of the filters A to D that a text fails, as an int.

    A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * ``[A-Z]`` > 10 * code
    points; D: holds any of ``#$%&*|``. Words are cut at ``[\\x20\\x09-\\x0D]``.
    """

    def bits(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        return F.when(n < 100, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(words)) < 80 * n, 2).otherwise(0)

    # a lambda over a one-element array splits the text once for both uses
    by_words = F.get(F.transform(F.array(F.array_remove(F.split(text, SEPARATORS), "")), bits), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (
        by_words
        + F.when(F.lit(100).cast("bigint") * capitals > F.lit(10).cast("bigint") * F.length(text), 4).otherwise(0)
        + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)
    ).cast("int")


def mask_counts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """``(part, mask, good, toxic, n)``: documents per part by failed filters and marks.

    Filter E fails where a smaller id anywhere in the table has the identical text. Equal
    ids with one text are copies of each other but not smaller, and a null id is neither
    smaller nor larger than any. A null text is the empty one, a null part the empty string.
    Several label rows of a document count together (any 1 is a 1); a null id has none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    facts = docs.select(
        F.col(id_col).cast("bigint").alias("doc"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text_masks(text).alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    facts = facts.groupBy("doc", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marks = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    marked = facts.join(marks, "doc", "left").select(
        "doc", "digest", "part", "mask", "n",
        *[(F.coalesce(c, F.lit(0)) == 1).alias(c) for c in ("good", "toxic")],
    )
    # per text a row for each part and pair of marks, with its smallest id and the rows that have it
    texts = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("doc").alias("low"),
        F.min_by("n", "doc").alias("at_low"),
        F.sum(F.when(F.col("doc").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
    )
    first = F.min("low").over(Window.partitionBy("digest"))
    split = texts.withColumn("fresh", F.col("unnamed") + F.when(F.col("low") == first, F.col("at_low")).otherwise(0))
    both = split.select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(F.col("mask").alias("mask"), F.col("fresh").alias("n")),
            F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")),
        )),
    )
    return both.where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _audit(pdf: pd.DataFrame) -> pd.DataFrame:
    """The 600 rows of one part from its at most 128 counts."""
    counts = [int(n) for n in pdf["n"]]
    if sum(counts) * len(ORDERS) >= 2**63:
        raise OverflowError("a part has too many documents for 64-bit counters")
    total = sum(n * packed(int(m), bool(g), bool(t)) for n, m, g, t in zip(counts, pdf["mask"], pdf["good"], pdf["toxic"]))
    fields = unpack(total).astype(np.int64).reshape(-1, len(COUNTERS))
    steps = range(1, len(FILTERS) + 1)
    return pd.DataFrame(
        {
            "part": pdf["part"].iloc[0],
            "filter_order": [o for o in ORDERS for _ in steps],
            "step": np.array([s for _ in ORDERS for s in steps], np.int32),
            **{c: fields[:, i] for i, c in enumerate(COUNTERS)},
        }
    )


def filter_interactions(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """A row for each part, order of the filters and step, zeros included.

    ``kept``, ``removed``, ``redundant`` (failing the step's filter, removed earlier),
    ``unique_fails`` (failing no other), ``good_lost``, ``toxic_lost`` count documents of the
    part; ``shapley`` is what the step's filter removes, summed over all orders. See
    :func:`mask_counts` for nulls, repeated rows and ties. An empty table has no parts and
    gives no rows; columns that are not named are not read.
    """
    return mask_counts(docs, labels, id_col, text_col, part_col).groupBy("part").applyInPandas(_audit, SCHEMA)
