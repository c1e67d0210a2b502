from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cliplake.operators import state as K
from cliplake.schemas import IMPORT_ORDER
from cliplake.sources import snapshot as S
from cliplake.sources import inventory as INV


def serve(requests, existing):
    """Names handed out one request after the other."""
    taken, out = set(existing), {}
    for no, dest, name in sorted(requests):
        stem, dot, ext = name.rpartition(".")
        stem, suffix = (stem, dot + ext) if stem else (name, "")
        final, k = name, 0
        while (dest, final) in taken:
            k += 1
            final = f"{stem}_{k}{suffix}"
        taken.add((dest, final))
        out[no] = final
    return out


@pytest.mark.parametrize("seed", [1])
def test_archive_names_match_one_by_one_service(spark, seed):
    rng = random.Random(seed)
    names = ["a.mp4", "a_1.mp4", "a_1_1.mp4", "a_2.mp4", "b", "b_1", "a.b.mp4"]
    requests = [(i, f"/v{rng.randrange(2)}", rng.choice(names)) for i in range(40)]
    existing = list({(f"/v{rng.randrange(2)}", rng.choice([*names, "a_3.mp4", "a_4.mp4"])) for _ in range(6)})
    out = K.number_destinations(
        spark.createDataFrame(requests, "order_no bigint, dest string, name string"),
        spark.createDataFrame(existing, "dest string, name string"),
    )
    assert {r["order_no"]: r["final_name"] for r in out.collect()} == serve(requests, existing)


def insert_all(current, incoming, replace):
    table = {("old", i): r for i, r in enumerate(current)}
    for n, row in enumerate(incoming):
        hits = [k for k, r in table.items() if r[0] == row[0] or (row[1] is not None and r[1] == row[1])]
        if hits and not replace:
            continue
        for k in hits:
            del table[k]
        table[("new", n)] = row
    return sorted((*r, k[0] == "new") for k, r in table.items())


@pytest.mark.parametrize("replace", [False, True])
@pytest.mark.parametrize("seed", [2])
def test_upsert_matches_row_by_row_inserts(spark, seed, replace):
    rng = random.Random(seed)
    current = [(i, f"p{i}") for i in range(5)]
    incoming = [(rng.randrange(0, 14), f"p{rng.randrange(14)}", n) for n in range(14)]
    out = K.upsert(
        spark.createDataFrame(current, "id bigint, path string"),
        spark.createDataFrame(incoming, "id bigint, path string, n bigint"),
        (("id",), ("path",)),
        ["n"],
        replace,
    )
    got = sorted((r["id"], r["path"], r["inserted"]) for r in out.collect())
    assert got == insert_all(current, [r[:2] for r in incoming], replace)


def test_rewrite_replaces_everywhere_unless_prefix_only(spark):
    df = spark.createDataFrame([(1, "/a/x/a/y")], "id bigint, original_path string")
    assert rows(K.rewrite_paths(df, "videos", "/a", "/b"))[0][1] == "/b/x/b/y"
    assert rows(K.rewrite_paths(df, "videos", "/a", "/b", prefix_only=True))[0][1] == "/b/x/a/y"
    lists = spark.createDataFrame([(1, '["/a/1","/c/a"]'), (2, "no list"), (3, None)], "id bigint, output_files string")
    assert rows(K.rewrite_paths(lists, "split_jobs", "/a", "/b")) == [(1, '["/b/1","/c/b"]'), (2, "no list"), (3, None)]


JOB = "id bigint, video_id bigint, temp_file_path string, status string, progress_percent int, started_at timestamp_ntz, completed_at timestamp_ntz, error_message string, created_at timestamp_ntz"


def test_job_events_fold_in_order(spark):
    jobs = spark.sql("SELECT 1L id, 1L video_id, cast(null as string) temp_file_path, 'pending' status, 0 progress_percent, cast(null as timestamp_ntz) started_at, cast(null as timestamp_ntz) completed_at, cast(null as string) error_message, timestamp_ntz'2025-01-01 00:00:00' created_at")
    events = spark.sql("""SELECT 1L job_id, seq, action, timestamp_ntz'2025-01-02 00:00:00' + make_dt_interval(0, 0, seq) at, detail FROM VALUES
      (1, 'processing', null), (2, 'progress', '40'), (3, 'fail', 'boom'), (4, 'reset', null), (5, 'processing', null), (6, 'finish', '/w/1.mp4') AS t(seq, action, detail)""")
    done = K.apply_job_events(jobs, events).first()
    assert (done.status, done.progress_percent, done.temp_file_path, done.error_message) == ("completed", 100, "/w/1.mp4", None)
    assert (done.started_at.minute, done.completed_at.minute) == (5, 6)
    half = K.apply_job_events(jobs, events.filter("seq <= 3")).first()
    assert (half.status, half.progress_percent, half.error_message, half.completed_at.minute) == ("failed", 40, "boom", 3)


def test_snapshot_round_trip(spark, tmp_path):
    videos = spark.sql("SELECT 1L id, '/a/1.mp4' original_path, timestamp_ntz'2025-01-01 10:00:00' creation_time, 2.5D duration_seconds, '카메라' device_model, true is_portrait, cast(null as string) metadata_json, timestamp_ntz'2025-01-01 10:00:00' created_at")
    projects = spark.sql("SELECT 7L id, 'Trip' name, cast(null as string) description, cast(null as string) date_range_start, cast(null as string) date_range_end, cast(null as string) playlist_id, timestamp_ntz'2025-01-01 10:00:00' created_at, timestamp_ntz'2025-01-01 10:00:00' updated_at")
    folder = str(tmp_path / "snap")
    counts = S.export_snapshot(spark, {"videos": videos, "projects": projects}, folder)
    assert counts == {t: int(t in ("videos", "projects")) for t in IMPORT_ORDER}
    back = S.import_snapshot(spark, folder, {}, "/a", "/z")
    assert rows(back["videos"].drop("inserted")) == [tuple(["/z/1.mp4" if v == "/a/1.mp4" else v for v in videos.first()])]
    assert rows(S.inserted_counts(back)) == sorted(((t, counts[t], counts[t]) for t in IMPORT_ORDER), key=repr)
    kept = S.import_snapshot(spark, folder, {"projects": projects.withColumn("description", F.lit("mine"))})
    assert kept["projects"].first()["description"] == "mine"
    over = S.import_snapshot(spark, folder, {"projects": projects.withColumn("description", F.lit("mine"))}, replace=True)
    assert over["projects"].first()["description"] is None
    with pytest.raises(Exception):
        S.export_snapshot(spark, {"videos": videos}, folder)


@pytest.mark.parametrize("text", ["[1]", "{}", '{"format_version": 2, "tables": {}}', '{"format_version": 1}', "nope"])
def test_bad_headers_are_refused(spark, tmp_path, text):
    (tmp_path / "header").mkdir()
    (tmp_path / "header" / "part-0.txt").write_text(text)
    with pytest.raises(ValueError):
        S.read_header(spark, str(tmp_path))


def test_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.mp4", "sub/B.MOV", "sub/notes.txt", "c.mxf"):
        (tmp_path / name).write_bytes(b"x" * 3)
    found = INV.scan_files(spark, [str(tmp_path), str(tmp_path / "sub")])
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["B.MOV", "a.mp4", "c.mxf"]
    with pytest.raises(Exception):
        INV.scan_files(spark, [str(tmp_path / "none")]).collect()


def test_storage_roots(spark):
    df = spark.createDataFrame([("/Volumes/X/a", 1), ("/Volumes", 2), ("/mnt/nas/b/c", 3), ("/mntx/a", 4), ("/home/a", 5)], "path string, size_bytes bigint")
    assert rows(INV.storage_rollup(df)) == sorted([("/Volumes/X", 1, 1), ("/Volumes", 1, 2), ("/mnt/nas", 1, 3), (None, 2, 9)], key=repr)
