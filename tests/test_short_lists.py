"""Lists that are known to be short take one exchange, and give what the blocks give."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cliplake.operators import extract as I
from cliplake.operators import sequences as E
from cliplake.operators import state as K
from cliplake.operators.ordered import WHOLE, fused, position_block

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize(
    "name, most",
    [
        ("I11_summary_document", 2),  # F3
        ("I11_part_description", 5),  # F6
        ("K16_merge_jobs", 2),  # F8
        ("I11_description", 1),  # F9
        ("C9_interval_overlap", 2),  # F10
        ("I11_clip_summary", 1),  # F11
        ("I9_flatten_clips", 1),  # F16
    ],
)
def test_exchanges_of_merges(spark, name, most):
    assert exchanges(queries()[name](spark, SF)) <= most


@pytest.fixture(scope="module")
def clips(spark):
    # merges of 0 to 2,300 clips, runs, devices that come back, empty and missing ones
    sizes = spark.createDataFrame([(1, 1), (2, 7), (3, 1000), (4, 1001), (5, 2300)], "merge_id bigint, n int")
    return sizes.select("merge_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n").cast("bigint"))).alias("position")).selectExpr(
        "merge_id", "position", "position % 90 AS video_id", "concat('c', position % 50, '.mp4') AS name",
        "cast(position % 7 AS double) + 0.5D AS duration", "CASE WHEN position % 5 < 3 THEN concat('g', position div 5) END AS grp",
        "CASE WHEN position % 11 = 0 THEN '' WHEN position % 4 > 0 THEN concat('Cam ', position * 7 % 3) END AS device",
        "CASE WHEN position % 3 > 0 THEN '10:00:00' END AS shot_time",
    ).cache()


def test_windows_give_what_blocks_give(spark, clips):
    marks = clips.withColumn("mark", F.col("position") % 6 == 4)
    values = dict(
        run=("sum", F.coalesce(F.col("p.grp") == F.col("grp"), F.lit(False)).cast("bigint")),
        earlier=("sum_before", F.col("duration")), top=("max", F.col("duration")), latest=("last_before", F.col("device")),
        since=("since", F.col("mark")),
    )
    one, other = (fused(marks, ["merge_id"], ["position"], b, ["grp"], "p", **values) for b in (WHOLE, position_block(size=64)))
    assert rows(one) == rows(other)


def test_documents_of_short_lists_are_those_of_long_ones(spark, clips):
    outputs = spark.createDataFrame(
        [(i, f"T{i}", "2024-01-02" if i % 2 else None, 10 * i, f"/o/{i}.mp4", f"/m/d{i}/a.mov") for i in range(1, 8)],
        "merge_id bigint, title string, date string, size_bytes bigint, output_path string, target string",
    )
    parts = E.timeline(clips.selectExpr("merge_id", "position AS part_no", "duration * 2 AS length"), ["merge_id"], "part_no", "length")
    spans = {s: E.overlap_parts(E.timed_runs(clips, ["merge_id"], short=s), parts, short=s) for s in (False, True)}
    assert rows(spans[True]) == rows(spans[False])
    told = spans[False].selectExpr("merge_id", "part_no", "run", "cast(relative_s AS string) AS clock", "name AS title")
    for build in (
        lambda s: I.clip_summaries(clips, short=s),
        lambda s: I.descriptions(clips, short=s),
        lambda s: I.summary_documents(outputs, clips, short=s),
        lambda s: I.merge_jobs(outputs, clips, short=s),
        lambda s: K.merge_records(clips, short=s),
        lambda s: I.part_descriptions(told, clips, short=s),
    ):
        long = build(False)
        assert rows(build(True), *long.columns) == rows(long)
