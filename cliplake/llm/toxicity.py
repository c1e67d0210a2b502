"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes ratios.

A text's features are the hashed character n-grams that it contains (present or not),
each scaled by the log ratio of its smoothed frequencies in toxic and clean texts; a
logistic regression is fitted on the scaled features. The fit uses a bounded sample of
labelled rows (``per_class`` of each label, drawn by hash); their sparse features go to
the driver, the model is one vector of ``BUCKETS`` numbers. Scoring is one pass without a
shuffle over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplake.llm.tables import crc_fold
from cliplake.llm.text import LOWER, SEPARATOR, Texts, slices, tidy

BUCKETS = 1 << 18
LENGTHS = (3, 5, 8)  # bytes: every word has one, and starts of longer words
PER_CLASS = 1_500
THRESHOLD = 0.7
LEAST_RATIO = 1.5


def presence(texts: Texts) -> Iterator[np.ndarray]:
    """Per text the sorted buckets of its n-grams: bytes, A-Z lower-cased, every white
    space character as one space and one space around the text."""
    data = np.where(SEPARATOR[texts.data], np.uint8(32), LOWER[texts.data])
    seen = np.zeros(BUCKETS, bool)
    for a, b in zip(texts.offsets[:-1], texts.offsets[1:]):
        if a == b:
            yield np.zeros(0, np.int64)
            continue
        x = np.concatenate(([32], data[a:b], [32])).astype(np.uint64)
        for n in LENGTHS:
            m = len(x) - n + 1
            if m <= 0:
                continue
            code = x[:m].copy()
            for j in range(1, n):
                code = (code << np.uint64(8)) | x[j : j + m]
            seen[((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)] = True
        found = np.flatnonzero(seen)
        yield found
        seen[found] = False


@dataclass
class Model:
    weights: np.ndarray  # float32, naive Bayes ratio times coefficient
    bias: float

    def score(self, features: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.bias + self.weights[features].sum(dtype=np.float64), -60, 60))))


def fit(features: list[np.ndarray], toxic: np.ndarray, alpha: float = 1.0, ridge: float = 1e-3, rounds: int = 150) -> Model:
    """Both labels count alike. Where either label is missing nothing can be told
    apart and every score is 0."""
    toxic = np.asarray(toxic, np.float64)
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    if not n1 or not n0:
        return Model(np.zeros(BUCKETS, np.float32), -60.0)
    p, q = np.full(BUCKETS, alpha), np.full(BUCKETS, alpha)
    for f, t in zip(features, toxic):  # a text has every feature once
        (p if t else q)[f] += 1
    ratio = np.log(p / (n1 + 2 * alpha)) - np.log(q / (n0 + 2 * alpha))
    # features that say next to nothing, or were seen in less than three texts, weigh nothing
    ratio[(np.abs(ratio) < LEAST_RATIO) | (p + q - 2 * alpha < 3)] = 0.0
    features = [f[ratio[f] != 0] for f in features]
    flat = np.concatenate(features)
    row = np.repeat(np.arange(len(features), dtype=np.int32), [len(f) for f in features])
    weight = np.where(toxic == 1, 0.5 / n1, 0.5 / n0)
    scaled = ratio[flat]
    step = 4.0 / max(1e-9, np.max(np.bincount(row, weights=scaled**2, minlength=len(features))) ** 0.5)
    w, b = np.zeros(BUCKETS), 0.0
    mw, vw, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    rate = min(step, 0.02)
    for i in range(1, rounds + 1):  # Adam on the whole sample
        z = b + np.bincount(row, weights=scaled * w[flat], minlength=len(features))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - toxic)
        gw, gb = np.bincount(flat, weights=scaled * error[row], minlength=BUCKETS) + ridge * w, error.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        c, d = 1 - 0.9**i, 1 - 0.99**i
        w -= rate * (mw / c) / (np.sqrt(vw / d) + 1e-8)
        b -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return Model((w * ratio).astype(np.float32), float(b))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` rows of either label; ``usable`` restricts the labels.

    A document with several labels counts as toxic if one says so; null labels and ids are
    left out. Of repeated ids in ``docs`` every row is used.
    """
    known = labels.where("toxic is not null and doc_id is not null")
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit("fold")), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(per_class).union(
        known.where("toxic = 0").orderBy(*order).limit(per_class)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, len(texts)),
                        pa.array([f.astype(np.int32).tobytes() for f in presence(texts)], pa.binary()),
                    ],
                    ["toxic", "features"],
                )

    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")  # two times per_class rows at most
        .select(F.col("toxic").cast("int"), "text")
        .mapInArrow(tidy(run), "toxic int, features binary")
        .collect()
    )
    rows.sort(key=lambda r: (r[0], bytes(r[1])))  # the fit does not depend on the order of tasks
    return fit([np.frombuffer(r[1], np.int32) for r in rows], np.array([r[0] for r in rows]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)``, a row for each row; null texts count as empty, and texts
    without words score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for texts in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, len(texts)),
                        pa.array(list(scores(texts, fitted)), pa.float64()),
                    ],
                    ["doc_id", "score"],
                )

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(tidy(run), "doc_id bigint, score double")


def scores(texts: Texts, model: Model) -> Iterator[float]:
    """Per text the score; 0 for texts without words, which the bias says nothing about."""
    letters = np.concatenate(([0], np.cumsum(~SEPARATOR[texts.data])))[texts.offsets]
    for features, n in zip(presence(texts), np.diff(letters)):
        yield model.score(features) if n else 0.0


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 is 1; a null id is not held out."""
    return F.coalesce(crc_fold(doc_id) == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row for each row of ``docs``.

    Labels of held-out ids never reach the fit. Rows with null ids or texts are scored
    too; repeated rows get equal scores; an empty table gives an empty result.
    """
    model = train(docs, labels, ~held_out(F.col("doc_id")), per_class)
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def clean_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns unchanged; null texts and
    texts without words always stay."""
    model = train(docs, labels, ~held_out(F.col("doc_id")), per_class)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def stays(column: pa.Array) -> pa.Array:
        fitted = shared.value
        return pa.array([x == 0 or x < threshold for texts in slices(column) for x in scores(texts, fitted)], pa.bool_())

    return docs.where(stays("text"))  # only the texts go to Python, and none comes back
