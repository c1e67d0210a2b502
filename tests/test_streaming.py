from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cliplake.operators.stats import status_counts
from cliplake.operators.state import apply_job_events
from cliplake.plans import views as V
from cliplake.streaming import progress as P
from cliplake.streaming import routing as R
from cliplake.streaming import upkeep as U
from cliplake.streaming import watch as W
from cliplake.streaming.sources import stream_files

SF = "/root/testdata/sf0.001"


def as_stream(spark, df, folder, files=3):
    """The rows as several files, read back one file per micro-batch."""
    df.repartition(files).write.mode("overwrite").parquet(folder)
    return stream_files(spark, folder, df.schema, files_per_batch=1)


def run(stream, tmp_path, name, mode="append"):
    q = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    )
    assert q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def run_batches(stream, tmp_path, name, writer):
    q = stream.writeStream.foreachBatch(writer).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert q.exception() is None


def watch_events(spark):
    start = datetime(2025, 1, 1)
    data = [
        ("created", "/in/a.mp4", None, False, 10, start),
        ("modified", "/in/a.mp4", None, False, 10, start + timedelta(seconds=5)),
        ("modified", "/in/a.mp4", None, False, 20, start + timedelta(seconds=9)),
        ("created", "/in/.b.mp4", None, False, 1, start),
        ("created", "/in/c.txt", None, False, 1, start),
        ("created", "/in/dir.mp4", None, True, 1, start),
        ("moved", "/in/x.tmp", "/in/X.MOV", False, 3, start),
    ]
    return spark.createDataFrame(data, "kind string, path string, dest_path string, is_directory boolean, size bigint, at timestamp")


def test_watch_stream_equals_batch(spark, tmp_path):
    events = watch_events(spark)
    want = [("/in/X.MOV", 3), ("/in/a.mp4", 10), ("/in/a.mp4", 20)]
    assert rows(W.watch_batch(events), "path", "size") == want
    out = run(W.watch_stream(as_stream(spark, events, str(tmp_path / "ev"))), tmp_path, "watched")
    assert rows(out, "path", "size") == want


def observations(spark):
    rng = random.Random(9)
    start = datetime(2025, 1, 1)
    data = [
        (f"/in/{rng.randrange(4)}.mp4", i, None if rng.random() < 0.1 else rng.randrange(2), start + timedelta(seconds=i)) for i in range(150)
    ]
    return spark.createDataFrame(data, "path string, seq bigint, size bigint, at timestamp")


def gate(data, checks):
    state, hits = {}, []
    for path, seq, size, _ in data:
        last, seen = state.get(path, (None, 0))
        if size is None:
            state.pop(path, None)
            continue
        seen = seen + 1 if size == last else 1
        if seen >= checks:
            hits.append((path, seq))
            state.pop(path, None)
        else:
            state[path] = (size, seen)
    return sorted(hits)


@pytest.mark.parametrize("checks", [1, 3])
def test_stability_gate_stream_equals_batch_and_loop(spark, tmp_path, checks):
    obs = observations(spark)
    want = gate([tuple(r) for r in obs.orderBy("seq").collect()], checks)
    assert sorted((r.path, r.seq) for r in W.stable_batch(obs, checks).collect()) == want
    # one file after the other, oldest first
    folder = str(tmp_path / "obs")
    for low in range(0, 150, 50):
        obs.filter(f"seq >= {low} AND seq < {low + 50}").coalesce(1).write.mode("append").parquet(folder)
    stream = stream_files(spark, folder, obs.schema, files_per_batch=1)
    out = run(W.stable_stream(stream, checks), tmp_path, f"stable{checks}")
    assert sorted((r.path, r.seq) for r in out.collect()) == want
    single = run(W.stable_stream(as_stream(spark, obs, str(tmp_path / "one"), files=1), checks), tmp_path, f"one{checks}")
    assert sorted((r.path, r.seq) for r in single.collect()) == want


def test_no_checks_lets_everything_through(spark):
    obs = observations(spark)
    assert W.stable_batch(obs, 0).count() == obs.filter("size IS NOT NULL").count()


def test_progress_stream_equals_batch(spark, tmp_path):
    events = V.load(spark, SF, "events").selectExpr(
        "user_id AS file_id", "event_id AS seq",
        "CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'purchase' THEN 'done' ELSE 'progress' END AS kind",
        "cast(value AS int) AS percent", "value AS eta_s", "event_id % 3 > 0 AS success", "99L AS total_files",
    )
    stream = as_stream(spark, events, str(tmp_path / "p"))
    assert rows(run(P.file_progress(stream), tmp_path, "per_file", "complete")) == rows(P.file_progress(events))
    assert rows(run(P.overall_progress(stream), tmp_path, "overall", "complete")) == rows(P.overall_progress(events))


CHANNELS = [("macos", None, None), ("telegram", True, {"bot_token": "t"}), ("discord", True, {"webhook_url": "u"}), ("slack", False, {"webhook_url": "u"})]


def test_outbox_survives_failing_channels_and_sees_new_rules(spark, tmp_path):
    events = spark.createDataFrame([(i, R.EVENT_TYPES[i % 4]) for i in range(40)], "event_id bigint, event_type string")
    channels = lambda: spark.createDataFrame(CHANNELS, "channel string, enabled boolean, settings map<string,string>")
    assert rows(R.ready_channels(channels())) == [("discord",), ("macos",)]
    calls, sent = [], []

    def rules():
        calls.append(1)
        off = [("on_error", False)] if len(calls) > 1 else []
        return spark.createDataFrame(off, "event_type string, enabled boolean")

    def broken(df, batch):
        raise RuntimeError("no connection")

    writer = R.outbox_writer(
        str(tmp_path / "out"), rules, channels, {"discord": broken, "macos": lambda df, b: sent.append(df.count())}
    )
    run_batches(as_stream(spark, events, str(tmp_path / "n"), files=2), tmp_path, "outbox", writer)
    box = spark.read.parquet(str(tmp_path / "out" / "outbox"))
    by_batch = {r.batch: r["count"] for r in box.filter("event_type = 'on_error'").groupBy("batch").count().collect()}
    assert set(by_batch) == {0} and len(calls) == 2
    assert sum(sent) == box.filter("channel = 'macos'").count()
    assert {r.channel for r in spark.read.parquet(str(tmp_path / "out" / "failures")).collect()} == {"discord"}


def test_upkeep_equals_one_batch_and_is_idempotent(spark, tmp_path):
    jobs = V.jobs(spark, SF)
    events = V.load(spark, SF, "lineitem").selectExpr(
        "l_partkey AS job_id", "l_orderkey * 8 + l_linenumber AS seq",
        "element_at(array('processing', 'progress', 'finish', 'fail', 'reset', 'merged', 'pending'), l_linenumber) AS action",
        "l_shipdate AS at", "cast(cast(l_quantity AS int) AS string) AS detail",
    )
    folder = str(tmp_path / "cat")
    writer = U.job_event_writer(folder)
    run_batches(as_stream(spark, events, str(tmp_path / "e")), tmp_path, "upkeep", writer)
    want = rows(status_counts(apply_job_events(jobs, events)))
    assert rows(U.current_status_counts(jobs, folder)) == want
    writer(spark.read.parquet(f"{folder}/job_events").filter("batch = 1").drop("batch"), 7)  # the same events once more
    assert rows(U.current_status_counts(jobs, folder)) == want


def test_streamed_registration_keeps_ids(spark, tmp_path):
    base = V.videos(spark, SF)
    top = base.agg(F.max("id")).first()[0]
    folder = str(tmp_path / "v")
    writer = U.video_writer(base, folder)
    first = spark.sql("SELECT '/n/1.mp4' original_path, timestamp_ntz'2025-01-01 00:00:00' creation_time UNION ALL SELECT '/n/2.mp4', timestamp_ntz'2025-01-02 00:00:00'")
    second = first.unionByName(spark.sql("SELECT '/n/3.mp4' original_path, timestamp_ntz'2024-01-02 00:00:00' creation_time"))
    writer(first, 0)
    writer(second, 1)
    writer(second, 1)  # a retried batch
    new = U.current_videos(base, folder).filter("original_path LIKE '/n/%'")
    assert rows(new, "original_path", "id") == [("/n/1.mp4", top + 1), ("/n/2.mp4", top + 2), ("/n/3.mp4", top + 3)]
