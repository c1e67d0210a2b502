"""What kept results of one step from being computed again, and lists from growing with time."""

from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from cliplake.operators import matching as M
from cliplake.operators import sequences as E
from cliplake.operators import state as K


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_of_a_cell_do_not_grow_with_the_time_covered(spark):  # F5, F13
    def longest(n):
        sound = spark.range(n).selectExpr("'f' AS folder", "concat('p', id) AS path", "cast(id % 97 + 1 AS double) AS length", "id * 10000000 AS us")
        return [t.agg(F.max(F.size("boxes"))).first()[0] for t in M._tiles(sound, 300.0)[1:]]

    assert longest(20_000) == longest(2_000) == [1, 1]


def test_matches_on_the_edge_of_a_cell(spark):  # F5, F13
    at = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {})"
    recordings = spark.range(40).selectExpr("'f' AS folder", "concat('r', id, '.wav') AS path", at.format("id * 100") + " AS at", "100.0D + id % 3 AS length")
    videos = spark.range(120).selectExpr("id", "'f' AS folder", at.format("id * 37 - 250") + " AS at", "100.0D + id % 4 AS length")
    got = {r.id: (r.recording, round(r.score, 9)) for r in M.match_recordings(videos, recordings).collect()}
    for v in range(120):
        length, best = 100.0 + v % 4, []
        for r in range(40):
            gap, far = abs(100.0 + r % 3 - length), abs(r * 100 - (v * 37 - 250))
            best.append((-(max(0.0, 1 - gap / length) * 0.65 + max(0.0, 1 - far / 300.0) * 0.35), f"r{r}.wav"))
        top = min((round(s, 9), p) for s, p in best)
        assert got[v] == (top[1], -top[0]), v


def test_import_reads_the_incoming_rows_once(spark):  # F4
    kind = "id bigint, v string"
    current = spark.createDataFrame([(1, "a"), (2, "b")], kind)
    incoming = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z"), (4, "w"), (None, "n"), (None, "m")], kind)
    out = K.upsert(current, incoming, [("id",)], ["v"])
    assert rows(out) == sorted([(1, "a", False), (2, "b", False), (3, "y", True), (4, "w", True), (None, "m", True), (None, "n", True)], key=repr)
    scanned = spark.range(100).selectExpr("id", "concat('v', id) AS v")
    assert plan(K.upsert(current, scanned, [("id",)], ["v"])).count("Range (0, 100") == 1


def test_deletes_of_many_rows_do_not_sort_them(spark):  # F7, F15
    videos = spark.range(50).selectExpr("id", "id % 3 = 0 AS gone")
    jobs = spark.range(200).selectExpr("id", "id % 50 AS video_id")
    out = K.cascade_delete({"videos": videos, "transcoding_jobs": jobs}, many=True, videos=videos.filter("gone").select("id"))
    assert "Sort" not in plan(out["transcoding_jobs"]) and "ShuffledHashJoin" in plan(out["transcoding_jobs"])
    assert {r.video_id for r in out["transcoding_jobs"].collect()} == {i for i in range(50) if i % 3}


def test_reset_stores_its_ids(spark):  # F7
    merges = spark.range(30).selectExpr("id", "concat('/o/', id % 10) AS output_path", "id AS created_at", "concat('[', id, ']') AS video_ids")
    splits = spark.range(60).selectExpr("id", "id % 30 AS merge_job_id")
    out = K.reset_build({"merge_jobs": merges, "split_jobs": splits, "videos": spark.range(30).toDF("id")}, merges.filter("id < 4"), many=True)
    assert plan(out["split_jobs"]).count("Range (0, 30") == 0
    assert sorted(r.id for r in out["videos"].collect()) == [i for i in range(30) if i not in (20, 21, 22, 23)]
    assert {r.merge_job_id % 10 for r in out["split_jobs"].collect()} == set(range(4, 10))


def test_places_are_computed_once(spark):  # F12, F14
    files = spark.range(40).selectExpr("id AS order_no", "'/v' AS dest", "concat('a', id % 3, '.mp4') AS name")
    named = K.number_destinations(files, files.select("dest", "name").limit(0))
    assert "Range" not in plan(named) and named.select("final_name").distinct().count() == 40
    grouped = spark.range(40).selectExpr("id % 4 AS batch", "id div 4 AS idx", "concat('g', id % 12 div 4) AS group_id", "id div 12 + 1 AS member")
    assert "Range" not in plan(E.reorder(grouped))
    places = {(r.batch, r.new_idx) for r in E.reorder(grouped).collect()}
    assert places == {(b, i) for b in range(4) for i in range(10)}
