from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from cliplake.operators import matching as M
from cliplake.operators import signals as S

SAMPLES = "session bigint, role string, idx bigint, sample double"


def peaks_of(samples, rate, ratio, gap_s=0.25, window_ms=20.0):
    """The detector as a plain walk over the samples."""
    size = [abs(x) for x in samples]
    floor = max(float(np.median(size)), 1e-6)
    gap, window = max(1, int(rate * gap_s)), max(1, int(rate * window_ms / 1000))
    out, i = [], 0
    while i < len(size):
        if size[i] >= floor * ratio:
            span = size[i : i + window]
            best = i + span.index(max(span))
            out.append((best, round(size[best] / floor, 6)))
            i = best + gap
        else:
            i += 1
    return out


def test_clap_offset_of_two_pulses(spark):
    data = []
    for role, at in (("reference", 2100), ("external", 1600)):
        wave = [0.01] * 5000
        wave[at : at + 2] = [1.0, 0.7]
        data += [(1, role, i, v) for i, v in enumerate(wave)]
    peaks = S.transient_peaks(spark.createDataFrame(data, SAMPLES), ["session", "role"], 1000)
    out = S.clap_offset(peaks, ["session"]).first()
    assert out.offset_s == pytest.approx(0.5)
    assert out.confidence == 1.0


def test_peaks_match_the_walk(spark):
    rng = random.Random(2)
    data, want = [], []
    for session in range(4):
        wave = [rng.uniform(-1, 1) * (30 if rng.random() < 0.2 else 1) for _ in range(600)]
        data += [(session, "r", i, v) for i, v in enumerate(wave)]
        want += [(session, i, s) for i, s in peaks_of(wave, 100, 8.0, 0.1, 50.0)]
    got = S.transient_peaks(
        spark.createDataFrame(data, SAMPLES), ["session", "role"], 100, min_gap_seconds=0.1, window_ms=50.0
    )
    assert sorted((r.session, r.idx, round(r.score, 6)) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("loud", [0.15, 0.6, 1.0])
def test_one_recording_over_many_blocks(spark, loud):
    """A recording without a pause, cut into blocks a little longer than a gap."""
    rng = random.Random(int(loud * 100))
    wave = [rng.choice([1.0, 2.0, 3.0, 4.0]) * (20 if rng.random() < loud else 1) for _ in range(6000)]
    data = [(7, "r", i, v) for i, v in enumerate(wave)] + [(8, "r", i, v) for i, v in enumerate(wave[:50])]
    ratio = 1.0 if loud == 1.0 else 3.0 if loud < 0.5 else 0.4
    want = [(s, i, x) for s, w in ((7, wave), (8, wave[:50])) for i, x in peaks_of(w, 100, ratio, 0.3, 120.0)]
    got = S.transient_peaks(
        spark.createDataFrame(data, SAMPLES), ["session", "role"], 100, ratio, min_gap_seconds=0.3, window_ms=120.0, block=64
    )
    assert sorted((r.session, r.idx, round(r.score, 6)) for r in got.collect()) == sorted(want)


def test_no_peak_gives_a_reason(spark):
    peaks = spark.createDataFrame([(1, "reference", 5, 9.0, 0.5)], "session bigint, role string, idx bigint, score double, time_s double")
    assert S.clap_offset(peaks, ["session"]).first().reason == "no clear peak"
    assert S.clap_drift(peaks, ["session"]).first().reason == "fewer than two peaks"


@pytest.mark.parametrize("chunk", [1024, 7])
def test_correlation_over_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "FRAMES_PER_CHUNK", chunk)
    rng = np.random.default_rng(4)
    ext, start = rng.random(400), 137
    ref = ext[start * 1 : start + 100]
    df = spark.createDataFrame(
        [(1, "external", i, float(v)) for i, v in enumerate(ext)] + [(1, "reference", i, float(v)) for i, v in enumerate(ref)], SAMPLES
    )
    env = S.normal_envelope(df, ["session", "role"], 10)
    corr = S.lag_correlation(env.filter("role = 'reference'").drop("role"), env.filter("role = 'external'").drop("role"), ["session"])
    z = lambda v: (v - v.mean()) / v.std()
    want = np.correlate(z(ext), z(ref), "valid") / 100
    got = {r.lag: r.corr for r in corr.collect()}
    assert sorted(got) == list(range(301))
    assert np.allclose([got[i] for i in range(301)], want)
    best = S.best_segment(corr, ["session"]).first()
    assert best.start_s == pytest.approx(13.7)
    assert S.best_segment(corr, ["session"], search_start=20.0).first().start_s >= 20.0
    assert S.best_segment(corr, ["session"], search_start=999.0).first().start_s == pytest.approx(30.0)


def test_flat_envelopes_have_no_z(spark):
    df = spark.createDataFrame([(1, "r", i, 0.5) for i in range(50)], SAMPLES)
    assert {r.z for r in S.normal_envelope(df, ["session", "role"], 10).collect()} == {None}


def best_match(video, recordings, window, least):
    scored = []
    for path, at, length in sorted(recordings):
        by_len = max(0.0, 1.0 - abs(length - video[2]) / video[2])
        by_time = max(0.0, 1.0 - abs(at - video[1]) / window)
        scored.append((by_len * 0.65 + by_time * 0.35, path))
    top = max(s for s, _ in scored)
    return (min(p for s, p in scored if s == top), round(top, 6)) if top >= least else (None, round(top, 6))


@pytest.mark.parametrize("seed", [1, 2])
def test_scored_match_is_the_optimum(spark, seed):
    rng = random.Random(seed)
    videos = [(i, rng.randrange(0, 5000), rng.choice([30.0, 60.0, 61.0, 500.0])) for i in range(30)]
    recs = [(f"/r/{i:03d}.wav", rng.randrange(0, 5000), rng.choice([10.0, 29.0, 60.0, 62.0, 480.0])) for i in range(25)]
    at = lambda c: F.timestamp_seconds(c)
    v = spark.createDataFrame(videos, "id bigint, s bigint, length double").select("id", F.lit("f").alias("folder"), at("s").alias("at"), "length")
    r = spark.createDataFrame(recs, "path string, s bigint, length double").select(F.lit("f").alias("folder"), "path", at("s").alias("at"), "length")
    got = {x.id: (x.recording, round(x.score, 6)) for x in M.match_recordings(v, r, min_score=0.6).collect()}
    assert got == {video[0]: best_match(video, recs, 300.0, 0.6) for video in videos}


@pytest.mark.parametrize("spread", [0, 200, 4000])
def test_many_recordings_in_one_window(spark, spread):
    """All at one moment, all within the window, and wider: few tiles per video, the exact best."""
    rng = random.Random(spread)
    when = lambda: 1_000_000 + rng.randint(0, spread)
    videos = [(i, when(), float(rng.randint(50, 400))) for i in range(250)]
    recs = [(f"/f/{i:04}.wav", when(), rng.randint(30, 500) + rng.choice([0.0, 0.25])) for i in range(700)]
    at = lambda c: F.timestamp_seconds(c)
    v = spark.createDataFrame(videos, "id bigint, s bigint, length double").select("id", F.lit("f").alias("folder"), at("s").alias("at"), "length")
    r = spark.createDataFrame(recs, "path string, s bigint, length double").select(F.lit("f").alias("folder"), "path", at("s").alias("at"), "length")
    got = {x.id: (x.recording, round(x.score, 6)) for x in M.match_recordings(v, r, min_score=0.6).collect()}
    assert got == {video[0]: best_match(video, recs, 300.0, 0.6) for video in videos}
    sound = r.select("folder", "path", "length", M.micros(F.col("at")).alias("us"))
    asked = v.select("id", "folder", "length", M.micros(F.col("at")).alias("us")).withColumn("least", F.lit(0.0))
    best = {x.id: x.score for x in M.match_recordings(v, r, min_score=0.6).select("id", "score").collect()}
    scores = spark.createDataFrame(list(best.items()), "id bigint, s double")
    asked = asked.join(scores, "id").withColumn("least", F.col("s")).drop("s")
    assert M._candidates(asked, M._tiles(sound), 300.0, nearest=False).count() <= 8 * len(videos)


def test_unmatched_videos_carry_a_reason(spark):
    v = spark.sql("SELECT 1L id, 'f' folder, timestamp'2025-01-01 00:00:00' at, 10.0D length UNION ALL SELECT 2, 'f', timestamp'2025-01-01 00:00:00', 0.0D UNION ALL SELECT 3, 'g', timestamp'2025-01-01 00:00:00', 5.0D")
    r = spark.sql("SELECT 'f' folder, '/f/a.wav' path, timestamp'2025-01-02 00:00:00' at, 900.0D length UNION ALL SELECT 'f', '/f/b.txt', timestamp'2025-01-01 00:00:00', 10.0D")
    assert rows(M.match_recordings(v, r), "id", "recording", "reason") == [
        (1, None, "score too low"), (2, None, "video length unknown"), (3, None, "no recordings in folder"),
    ]


def test_keywords(spark):
    df = spark.createDataFrame([("Nikon Z6III",), ("NIKON",), ("Other",), ("",), (None,)], "d string")
    rules = {"nikon": "daylight", "nikon z": "cloudy", "": "shade", "other": "nothing"}
    assert [r[0] for r in df.select(M.white_balance(F.col("d"), rules)).collect()] == [6500, 5500, None, None, None]
    assert [r[0] for r in df.select(M.white_balance(F.col("d"))).collect()][:2] == [5500, 5500]
    tie = {"nik": "a", "kon": "b"}
    assert df.select(M.keyword_value(F.col("d"), tie)).first()[0] == "a"


def test_drift_of_a_session_without_a_reference_peak_is_that_of_its_sql(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    loud = [0.1] * 10 + [5.0] + [0.1] * 30 + [4.0] + [0.1] * 22
    data = [(n, [0.1] * 64 if n == 4 else loud) for n in range(8)]
    spark.createDataFrame(data, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df = queries()["J4_clap_drift"](spark, str(tmp_path))
    want = con.sql(oracle_sql()["J4_clap_drift"])
    got = rows(df.select(*want.columns))
    assert got == sorted(want.fetchall(), key=repr)
    assert [r[0] for r in got].count(None) == 1
