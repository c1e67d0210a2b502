from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cliplake.functions import labels as L
from cliplake.functions import media as M
from cliplake.functions import predicates as P
from cliplake.functions import specs as S
from cliplake.operators import catalog as C
from cliplake.operators import extract as I
from cliplake.operators import stats as D


def each(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_labels(spark):
    assert each(spark, L.duration_label, [5.9, 90.0, 3720.0, 0.0], "double") == ["5s", "1m 30s", "1h 2m", "0s"]
    assert each(spark, lambda c: L.clock_label(c, True), [0.5, 1.5, 2.5, 3599.5], "double") == ["0:00", "0:02", "0:02", "1:00:00"]
    assert each(spark, L.clock_label, [59.9, 3661.0], "double") == ["0:59", "1:01:01"]
    assert each(spark, L.size_label, [0, 1023, 1024, 1280, 1792, 5 * 1024**3, 2 * 1024**5], "bigint") == [
        "0 B", "1023 B", "1.0 KB", "1.2 KB", "1.8 KB", "5.0 GB", "2.0 PB",
    ]
    assert each(spark, lambda c: L.path_tail(c, 10), ["short", "/a/very/long/path"]) == ["short", "...ng/path"]
    assert each(spark, L.capture_date, ["2025-01-02T03:04:05", "20250102T0304", "bad value here", "", None]) == [
        "2025-01-02", "2025-01-02", "bad value ", "-", "-",
    ]
    assert each(spark, L.device_label, [" A ", "  ", None]) == ["A", "미상", "미상"]
    assert each(spark, L.dated_title, ["20240115 도쿄", "20240115", "trip"]) == ["2024년 1월 15일 도쿄", "2024년 1월 15일", "trip"]
    assert each(spark, L.file_suffix, ["/a/b.tar.gz", "/a/.hidden", "/a/b.", "c"]) == [".gz", "", "", ""]
    assert each(spark, L.folder_topic, ["/x/2024-01-15 Tokyo/a.mp4", "/x/2024_01_15  Osaka", "/x/plain/a.mp4", "a.mp4"]) == [
        ("2024-01-15", "Tokyo"), ("2024-01-15", "Osaka"), (None, "plain"), (None, ""),
    ]


def test_one_decimal_is_that_of_printf(spark):
    values = [n / 100 for n in range(-300, 20000)] + [n / 3600 for n in range(0, 7200, 90)] + [0.25, 0.35, 1.15, 2.675]
    assert each(spark, L.one_decimal, values, "double") == [f"{v:.1f}" for v in values]


def test_descriptions_end_at_a_line(spark):
    long = "x" * 4000 + "\n" + "y" * 2000
    plain = "z" * 6000
    out = each(spark, L.clean_description, ["<a>", long, plain])
    assert out == ["a", "x" * 4000 + "\n\n...", "z" * 4995 + "\n\n..."]


def test_specs(spark):
    assert each(spark, S.duration_spec, ["90", "1h30m", "2H", "0", "0h", "", "-5", "5x", "1m1h"]) == [90, 5400, 7200] + [None] * 6
    assert each(spark, S.size_spec, ["10", "1.5G", "256m", "1K", "2B", "0", "-1G", "1T", "1.2.3", ""]) == [
        10, 1610612736, 268435456, 1024, 2, None, None, None, None, None,
    ]
    assert each(spark, S.clock_spec, ["01:02:03.5", "2:03", "7.25", "-1", "a", "", "1:2:3:4"]) == [3723.5, 123.0, 7.25] + [None] * 4
    assert each(spark, S.frame_rate, ["30000/1001", "60", "0/0", "x"]) == [30000 / 1001, 60.0, 0.0, 0.0]
    assert each(spark, S.resolution_spec, ["4K", "1920x1080", "0x5", "wide"]) == [(3840, 2160), (1920, 1080), None, None]


def test_media_rules(spark):
    assert each(spark, M.speed_chain, [1, 2, 5, 10, 60, 61], "int") == [
        None, ["2.0"], ["2.0", "2.0", "1.2"], ["2.0", "2.0", "2.0", "1.2"], ["2.0"] * 5 + ["1.9"], None,
    ]
    df = spark.createDataFrame([(4.0,), (0.5,), (0.05,)], "t double")
    out = [tuple(r[0]) for r in df.select(M.fade_plan(F.col("t"), F.lit(0.5), F.lit(0.5))).collect()]
    assert out == [(0.5, 0.5, 3.5), (0.25, 0.25, 0.25), (0.0, 0.0, 0.0)]


def test_filters(spark):
    names = ["GH010128.MP4", "a.mts", "IMG.mov"]
    assert each(spark, lambda c: P.glob_filter(c, ["gh*", "*.MTS"], ["*.mts"]), names) == [True, False, False]
    assert each(spark, lambda c: P.contains_pattern(c, "a\\"), ["xa\\b", "xab"]) == [True, False]
    assert each(spark, lambda c: P.ingest_reason(c, F.lit(0)), ["/a.MP4", "/a.txt"]) == ["empty file", "unsupported extension"]
    with pytest.raises(ValueError):
        P.normal_status("paused")
    assert P.normal_status(P.STATUS_SENTINEL) is None


def test_average_speed_is_the_mean_of_ratios(spark):
    videos = spark.createDataFrame([(1, 120.0), (2, 60.0), (3, None), (4, 0.0)], "id bigint, duration_seconds double")
    jobs = spark.sql("""SELECT video_id, status, timestamp_ntz'2025-01-01 00:00:00' started_at, timestamp_ntz'2025-01-01 00:01:00' completed_at, timestamp_ntz'2025-01-01 00:00:00' created_at
      FROM VALUES (1L, 'completed'), (2L, 'merged'), (1L, 'failed'), (3L, 'completed'), (4L, 'completed') AS t(video_id, status)""")
    assert D.average_speed(jobs, videos).first()[0] == pytest.approx(1.5)
    assert D.average_speed(jobs, videos, "2031").first()[0] is None


def test_catalogue_ties_and_labels(spark):
    videos = spark.sql("SELECT 1L id, '/a' original_path, timestamp_ntz'2025-01-01 00:00:00' creation_time, 1.0D duration_seconds, cast(null as string) device_model, '2025-01-01T00:00:00' creation_text UNION ALL SELECT 2, '/b', timestamp_ntz'2025-01-02 00:00:00', null, 'Z', '2025-01-02T00:00:00'")
    jobs = spark.sql("SELECT 10L id, 1L video_id, 'failed' status, 1 progress_percent, timestamp_ntz'2025-01-01 00:00:00' created_at UNION ALL SELECT 11, 1, 'completed', 2, timestamp_ntz'2025-01-01 00:00:00'")
    out = C.catalogue(videos, jobs).select("id", "device", "status").collect()
    assert [tuple(r) for r in out] == [(2, "Z", "untracked"), (1, "미상", "completed")]
    assert C.catalogue(videos, jobs, status="untracked").count() == 1


def test_latest_job_is_limited_before_the_shuffle(spark):
    plan = C.latest_jobs(spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "user_id video_id", "event_type status", "1 progress_percent", "ts created_at", "event_id id"
    ))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_device_names(spark):
    df = spark.createDataFrame([("NIKON CORPORATION", "NIKON Z 8"), ("", "HERO9"), ("acme corp", "X1"), ("Sony", "sony"), ("Sony", " "), (None, "Foo")], "make string, model string")
    assert [r[0] for r in df.select(I.maker_model(F.col("make"), F.col("model"))).collect()] == [
        "Nikon Z 8", "GoPro HERO9", "Acme X1", "Sony", None, "Foo",
    ]


def test_long_documents_come_in_parts(spark):
    lines = spark.createDataFrame([(1, 0, i, f"l{i}") for i in range(1, 8)], "merge_id bigint, block int, pos bigint, line string")
    out = I.pack_lines(lines, ["merge_id"], ["block", "pos"], F.lit("H\n"), F.lit("\nT"), per_row=3)
    parts = [r.body for r in out.orderBy("part").collect()]
    assert parts == ["H\nl1\nl2\nl3", "l4\nl5\nl6", "l7\nT"]


def test_vmaf_layouts(spark):
    texts = ['{"pooled_metrics": {"vmaf": {"min": 1.5, "mean": 9}}}', '{"frames": [{"metrics": {"vmaf": 7}}]}', 'x {"vmaf": "nan"}', 'VMAF score: 3\n{"vmaf": 8}']
    df = spark.createDataFrame(list(enumerate(texts)), "media_id int, raw string")
    assert [r[0] for r in I.quality_scores(df).orderBy("media_id").select("vmaf").collect()] == [1.5, 7.0, None, 3.0]


def test_dates_without_rows_give_nulls(spark):
    links = spark.createDataFrame([], "project_id bigint, merge_job_id bigint")
    merges = spark.createDataFrame([], "id bigint, date string")
    assert rows(D.project_date_range(links, merges)) == []
