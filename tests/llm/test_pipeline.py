from __future__ import annotations

import duckdb
import pyarrow as pa
import pytest

from llm_fixtures import documents, shipped  # noqa: F401
import corpus_pipeline
from __spark_entry__ import queries
from cliplake.llm import jaccard, lines, mixing, toxicity
from cliplake.llm.queries import ORACLE, QUERIES
from cliplake.llm.tables import stash, table
from verify import rows_of

SF = "/root/testdata/sf0.001"


def test_registered():
    names = queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_rows(spark, name):
    df = QUERIES[name](spark, SF)
    key = "page_id" if "page_id" in df.columns else "doc_id"
    given = table(spark, SF, "pages" if key == "page_id" else "documents").count()
    assert df.count() == given or name.startswith("op10_")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    (_, drop_toxic), (_, drop_lines), (_, drop_copies), (_, mix), (_, encode) = corpus_pipeline.STAGES
    one = stash(drop_toxic(spark, docs, SF))
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, p in scored.items() if not p}
    two = stash(drop_lines(spark, one, SF))
    gone = {tuple(r) for r in lines.repeated_lines(one).collect()}
    want = {}
    for r in one.collect():
        rest = [x for i, x in enumerate(r.text.split("\n")) if (r.doc_id, i) not in gone]
        if len(rest) == len(r.text.split("\n")) or "".join(rest).split():
            want[r.doc_id] = "\n".join(rest)
    assert two.columns == docs.columns and {r.doc_id: r.text for r in two.collect()} == want
    three = stash(drop_copies(spark, two, SF))
    kept = {r.id for r in jaccard.jaccard_components(two).collect() if r.id == r.component_id}
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == kept
    four = stash(mix(spark, three, SF))
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(three).collect()}
    ids = [r.doc_id for r in four.collect()]
    assert four.columns == docs.columns and {i: ids.count(i) for i in copies} == copies
    five = encode(spark, four, SF)
    assert five.count() == len(ids)


def test_stages_take_odd_tables(spark, documents):
    rows = [(1, None), (2, ""), (3, "a b c d e f g h i j"), (3, "a b c d e f g h i j"), (None, "a b"), (4, "A b c d e f g h i j")]
    for given in (rows, []):
        docs = documents(given)
        for _, stage in corpus_pipeline.STAGES:
            docs = stash(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_python_sees_few_megabytes_of_texts_at_a_time(spark):
    had = spark.conf.get(corpus_pipeline.BATCH, None)
    spark.conf.unset(corpus_pipeline.BATCH)
    try:
        texts = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 800) AS text")
        corpus_pipeline.ready(spark)
        sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["doc_id"]) for b in batches), "doc_id bigint")
        assert max(r.doc_id for r in sizes.collect()) < 2000
        spark.conf.set(corpus_pipeline.BATCH, "7m")
        corpus_pipeline.ready(spark)
        assert spark.conf.get(corpus_pipeline.BATCH) == "7m"
    finally:
        spark.conf.unset(corpus_pipeline.BATCH) if had is None else spark.conf.set(corpus_pipeline.BATCH, had)
