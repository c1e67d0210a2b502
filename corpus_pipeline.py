"""Five stages that turn the table of documents into encoded training text.

Every stage takes ``(spark, docs, sf_dir)`` with all rows that the stage before kept and
returns a DataFrame; all but the last return the columns of ``docs``. The result of a
stage is written as Parquet and read again as the next one's documents.

* toxicity: documents predicted toxic go; the classifier learns from ``labels``.
* lines: repeated lines go, and documents that lose all their words.
* copies: of each group of near copies (five-word shingles, Jaccard 0.8) one document
  stays, that of the smallest id. Rows that repeat that id stay as they are.
* mix: documents appear as often as the mix of sources takes them, up to three times.
* encode: ids by the tokenizer, and whether decoding gives the text back.

Null and empty texts pass all filters; an empty table stays empty.

Rows go to Python at most 4 MB at a time, unless the session sets its own limit; Spark has
none by default but 10,000 rows, which are some 40 MB of texts in each of several buffers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplake.llm import jaccard, lines, mixing, pieces, toxicity
from cliplake.llm.queries import ship, tokenizer
from cliplake.llm.tables import stash, table


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> None:
    ship(spark)
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, "4m")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return lines.dedup_lines(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    found = jaccard.jaccard_components(docs, k=5, num=4, den=5)
    later = found.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    both = pieces.encode(docs, tokenizer(), round_trip=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("ngram jaccard join", drop_copies),
    ("source mixing", mix),
    ("sentencepiece", encode),
]
ORACLE_SQL = None  # the classifier's fit, the draws of the mix and the encoding are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
