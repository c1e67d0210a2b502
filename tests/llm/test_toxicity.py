from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from llm_fixtures import documents, shipped  # noqa: F401
from cliplake.llm import toxicity as X
from cliplake.llm.tables import table
from cliplake.llm.text import slices


def test_held_out_accuracy(spark):
    """With some 300 toxic rows to learn from, words that few of them have stay unknown."""
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    got = X.toxicity(table(spark, sf, "documents"), labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    clean = [r.predicted for r in got if r.toxic == 0]
    assert len(toxic) > 50 and np.mean(toxic) > 0.5 and np.mean(clean) < 0.01


def test_held_out_labels_and_other_columns_do_not_matter(spark, documents):
    rows = [(i, f"text number {i} " + ("awful nasty" if i % 3 == 0 else "nice day")) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id").isin(out), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda d, l: {r.doc_id: (r.held_out, round(r.score, 9), r.predicted) for r in X.toxicity(d, l).collect()}
    a = score(documents(rows), labels)
    assert a == score(documents(rows).withColumn("lang", F.lit("zz")).repartition(5), flipped)
    assert [i for i in a if a[i][0]] and sorted(i for i in a if a[i][0]) == out
    assert all(a[i][2] == int(i % 3 == 0) for i in out)


def test_special_rows(spark, documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (3, 0), (None, 1), (5, 1), (5, 0)], "doc_id bigint, toxic int")
    rows = [(1, "bad"), (2, "good"), (3, None), (None, ""), (4, "x " * 200_000), (2, "good"), (5, "bad")]
    got = X.toxicity(documents(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.predicted for r in X.toxicity(documents(rows), none).collect()} == {0}
    assert X.toxicity(documents([]), labels).count() == 0
    kept = X.clean_documents(documents(rows), labels)
    assert kept.columns == documents(rows).columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in got if not r.predicted)


def test_presence_is_that_of_all_grams():
    def code(g):
        return ((int.from_bytes(g, "big") + len(g)) * 0x9E3779B97F4A7C15 % 2**64) >> 46

    texts = ["Ab c", "", "é\n\n!", "aaaaaa"]
    got = [f.tolist() for t in slices(pa.array(texts)) for f in X.presence(t)]
    for text, f in zip(texts, got):
        x = b" " + text.encode().replace(b"\n", b" ").lower() + b" " if text else b""
        assert f == sorted({code(x[i : i + n]) for n in X.LENGTHS for i in range(len(x) - n + 1)})


def test_nothing_is_rejected_without_both_labels_or_without_words(spark, documents):
    # ids 2, 3 and 5 are held out: only a toxic label is left to learn from
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (5, 1)], "doc_id bigint, toxic int")
    rows = [(1, "bad"), (2, "good"), (3, None), (None, ""), (4, " \n\t"), (5, "bad")]
    kept = [(r.doc_id, r.text) for r in X.clean_documents(documents(rows), labels).collect()]
    assert {"good", None, ""} <= {t for _, t in kept} and len(kept) == len(rows)
    assert {r.predicted for r in X.toxicity(documents(rows), labels).collect()} == {0}


def test_texts_without_words_pass_any_model(spark, documents):
    texts = next(slices(pa.array(["", None, " \n\t", "word"]), 1 << 62))
    assert [x > 0.9 for x in X.scores(texts, X.Model(np.zeros(X.BUCKETS, np.float32), 60.0))] == [False, False, False, True]
