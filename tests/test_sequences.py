from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cliplake.operators import ordered as O
from cliplake.operators import sequences as E

GIB = 1024**3
FILE = "batch bigint, idx bigint, name string, creation_time timestamp, size_bytes bigint"


def files(spark, names, sizes=None, start=datetime(2025, 9, 20, 19, 48, 30)):
    data = [
        (1, i, n, start + timedelta(seconds=i), (sizes or [2 * GIB] * len(names))[i]) for i, n in enumerate(names)
    ]
    return spark.createDataFrame(data, FILE)


def test_scan_matches_a_plain_loop(spark):
    rng = random.Random(3)
    data = [(rng.randrange(3), i, rng.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(data, "k int, pos bigint, v bigint")
    block = F.expr("pos div 7")
    out = O.scan(df, ["k"], ["pos"], block, s=("sum", F.col("v")), m=("max", F.col("v")))
    out = O.previous_row(out, ["k"], ["pos"], block, ["v"], "p")
    out = O.number_rows(out, ["k"], ["pos"], block, "n")
    out = O.group_values(out, ["k"], total=F.sum("v"))
    want, seen = [], {}
    for k, pos, v in data:
        before = seen.setdefault(k, [])
        want.append(
            (k, pos, sum(before) if before else None, max(before) if before else None, before[-1] if before else None, len(before) + 1)
        )
        before.append(v)
    got = rows(out, "k", "pos", "s", "m", "p.v", "n")
    assert got == sorted(want, key=repr)
    assert {tuple(r) for r in out.select("k", "total").collect()} == {(k, sum(v)) for k, v in seen.items()}


@pytest.mark.parametrize("block", ["pos div 7", "pos div 1000", None])
def test_chained_values_match_a_plain_loop(spark, block):
    """Values that depend on the row before, over many blocks, one block and range blocks."""
    rng = random.Random(8)
    data = [(rng.choice([1, 2, None]), i, rng.choice(["a", "b", None]), float(rng.randrange(9))) for i in range(500)]
    df = spark.createDataFrame(data, "k int, pos bigint, g string, v double").where("k IS NOT NULL")
    starts = ~F.coalesce(F.col("prev.g") == F.col("g"), F.lit(False))
    out = O.fused(
        df, ["k"], ["pos"], None if block is None else F.expr(block), previous=["g"],
        run=("sum", starts.cast("bigint")), before=("sum_before", F.col("v")), top=("max", F.when(starts, F.col("v"))),
        lead=("last", F.when(starts, F.struct("pos"))), place=("since", starts), behind=("last_before", F.col("g")),
    )
    want, state = [], {}
    for k, pos, g, v in data:
        if k is None:
            continue
        s = state.setdefault(k, dict(prev=None, run=0, sum=None, top=None, lead=None, place=0, behind=None))
        first = s["prev"] is None or g is None or s["prev"][0] != g
        s["run"] += first
        s["place"] = 1 if first else s["place"] + 1
        if first:
            s["lead"], s["top"] = pos, v if s["top"] is None else max(s["top"], v)
        want.append((k, pos, None if s["prev"] is None else s["prev"][0], s["run"], s["sum"], s["top"], s["lead"], s["place"], s["behind"]))
        s["prev"], s["sum"] = (g,), (s["sum"] or 0) + v
        s["behind"] = g if g is not None else s["behind"]
    got = rows(out, "k", "pos", "prev.g", "run", "before", "top", "lead.pos", "place", "behind")
    assert got == sorted(want, key=repr)


def test_numbering_without_keys_and_at_one_moment(spark):
    df = spark.range(3000).selectExpr("id", "cast(0 AS bigint) AS at", "(id * 7919) % 3000 AS idx")
    out = O.number_rows(df, [], ["at", "idx"], None, "n")
    assert {(r.idx, r.n) for r in out.collect()} == {(i, i + 1) for i in range(3000)}
    sizes = [r[0] for r in O._range_blocks(df, ["at", "idx"]).groupBy(O.BLOCK).count().select("count").collect()]
    assert len(sizes) > 3 and max(sizes) < 1500


def test_near_split_size_keeps_one_session(spark):
    names = [f"DJI_20250920194830_000{i}_D.MP4" for i in (1, 2, 3)]
    one = E.sessions(files(spark, names, [int(0.98 * 16 * GIB)] * 2 + [2 * GIB]))
    assert rows(one, "idx", "group_id", "member") == [
        (i, "dji_20250920194830_1", i + 1) for i in range(3)
    ]


def test_small_parts_and_repeated_numbers_split_sessions(spark):
    small = E.sessions(files(spark, ["DJI_20250920194830_0001_D.MP4", "DJI_20250920194831_0002_D.MP4"]))
    assert len({r[0] for r in rows(small, "group_id")}) == 2
    again = E.sessions(files(spark, ["DJI_20250920194830_0001_D.MP4", "DJI_20250920194831_0001_D.MP4"], [16 * GIB] * 2))
    assert len({r[0] for r in rows(again, "group_id")}) == 2


def test_a_gap_of_more_than_three_hours_splits(spark):
    names = ["DJI_20250920100000_0001_D.MP4", "DJI_20250920130000_0002_D.MP4", "DJI_20250920160001_0003_D.MP4"]
    out = E.sessions(files(spark, names, [4 * GIB] * 3))
    assert [r[1] for r in rows(out, "idx", "group_id")] == ["dji_20250920100000_1"] * 2 + ["dji_20250920160001_2"]


def test_unknown_clock_counts_as_contiguous(spark):
    names = ["DJI_99999999999999_0001_D.MP4", "DJI_99999999999999_0002_D.MP4"]
    out = E.sessions(files(spark, names, [4 * GIB] * 2))
    assert rows(out, "idx", "group_id") == [(0, "dji_1"), (1, "dji_1")]


def test_chapters_and_singles(spark):
    names = ["GP020128.mp4", "IMG_0001.MOV", "GOPR0128.MP4", "gh010128.mp4", "x.mp4", "GH010129.MP4"]
    out = E.sessions(files(spark, names))
    assert rows(out, "idx", "group_id", "member") == [
        (0, "gopro_0128", 3),
        (1, "s_1", 1),
        (2, "gopro_0128", 1),
        (3, "gopro_0128", 2),
        (4, "s_2", 1),
        (5, "gopro_0129", 1),
    ]
    listed = E.session_list(out)
    assert rows(listed, "group_no", "group_id") == [(1, "gopro_0128"), (2, "s_1"), (3, "s_2"), (4, "gopro_0129")]
    off = E.sessions(files(spark, names), grouping=False)
    assert [r[1] for r in rows(off, "idx", "group_id")] == [f"s_{i}" for i in range(6)]


GROUPED = "batch bigint, idx bigint, group_id string, member bigint"


def placed(spark, groups):
    seen, data = {}, []
    for i, g in enumerate(groups):
        seen[g] = seen.get(g, 0) + 1
        data.append((1, i, g, seen[g]))
    out = E.reorder(spark.createDataFrame(data, GROUPED))
    return [r[1] for r in rows(out, "new_idx", "idx")]


def test_reorder_moves_singles_behind_the_session(spark):
    assert placed(spark, ["s1", "a", "s2", "a", "s3", "a", "s4"]) == [0, 1, 3, 5, 2, 4, 6]


def test_reorder_never_loses_files_of_overlapping_sessions(spark):
    assert placed(spark, ["a", "b", "a", "b"]) == [0, 2, 1, 3]
    assert placed(spark, ["a", "s1", "b", "b", "a", "s2"]) == [0, 4, 2, 3, 1, 5]
    rng = random.Random(5)
    for _ in range(3):
        groups = [rng.choice("abcdefgh") for _ in range(30)]
        assert sorted(placed(spark, groups)) == list(range(30))


def test_fades(spark):
    data = [(1, 0, "a", 1), (1, 1, "a", 2), (1, 2, "a", 3), (1, 3, "s_1", 1)]
    df = spark.createDataFrame(data, GROUPED)
    assert rows(E.fade_flags(df), "idx", "fade_in", "fade_out") == [(0, 0.5, 0.0), (1, 0.0, 0.0), (2, 0.0, 0.5), (3, 0.5, 0.5)]
    assert all(r[1:] == (0.0, 0.0) for r in rows(E.fade_flags(df, -1.0), "idx", "fade_in", "fade_out"))
    both = rows(E.fade_flags(df, 1.0, intro=True, outro=True), "idx", "role", "fade_in", "fade_out")
    assert both == [
        (-1, "intro", 1.0, 0.0), (0, "clip", 0.0, 0.0), (1, "clip", 0.0, 0.0),
        (2, "clip", 0.0, 1.0), (3, "clip", 1.0, 0.0), (4, "outro", 0.0, 1.0),
    ]


CLIPS = "merge_id bigint, position bigint, name string, duration double, grp string"


def test_runs_and_chapters(spark):
    data = [(1, 1, "a.mp4", 60.5, "g"), (1, 2, "b.mp4", 60.0, "g"), (1, 3, "c.mp4", 10.0, None), (1, 4, "d.mp4", 3600.0, "g"), (1, 5, "e.mp4", 1.0, None)]
    out = E.chapters(spark.createDataFrame(data, CLIPS), ["merge_id"])
    # 120.5 s and 130.5 s round half to even
    assert rows(out, "run", "clock", "title") == [(1, "0:00", "a"), (2, "2:00", "c"), (3, "2:10", "d"), (4, "1:02:10", "e")]


def test_overlap_with_parts_matches_all_pairs(spark):
    rng = random.Random(11)
    for _ in range(2):
        clips = [float(rng.randrange(0, 5)) for _ in range(25)]
        parts = [float(rng.choice([0, 1, 3, 8])) for _ in range(20)]

        def lay(lengths):
            at, out = 0.0, []
            for i, d in enumerate(lengths, 1):
                out.append((1, i, at, at + d))
                at += d
            return out

        c, p = lay(clips), lay(parts)
        c_df = spark.createDataFrame([(m, i, f"c{i}", a, b) for m, i, a, b in c], "merge_id bigint, run bigint, name string, start_s double, end_s double")
        p_df = spark.createDataFrame(p, "merge_id bigint, part_no bigint, start_s double, end_s double")
        want = sorted((i, j, max(0.0, a - s)) for _, i, a, b in c for _, j, s, e in p if a < e and b > s)
        got = E.overlap_parts(c_df, p_df, seconds_per_block=4.0)
        assert sorted(tuple(r) for r in got.select("run", "part_no", "relative_s").collect()) == want


@pytest.mark.parametrize(
    "edits",
    [
        [("swap", 1, 4), ("move", 5, 2)],
        [("move", 1, 5), ("remove", 3), ("order", [4, 3, 2, 1])],
        [("order", [1, 1, 2, 3, 4]), ("swap", 0, 2), ("move", 6, 1), ("remove", 9)],
        [("remove", 1)] * 7,
    ],
)
def test_edit_lists_match_list_operations(spark, edits):
    clips = list(range(1, 6))
    for kind, *args in edits:
        n = len(clips)
        if kind == "order":
            if sorted(args[0]) == list(range(1, n + 1)):
                clips = [clips[i - 1] for i in args[0]]
        elif all(1 <= a <= n for a in args):
            if kind == "swap":
                a, b = args[0] - 1, args[1] - 1
                clips[a], clips[b] = clips[b], clips[a]
            elif kind == "move":
                clips.insert(args[1] - 1, clips.pop(args[0] - 1))
            elif n > 1:
                clips.pop(args[0] - 1)
    df = spark.createDataFrame([(i, 5) for i in range(1, 6)], "position bigint, n bigint")
    got = sorted((r["new_position"], r["position"]) for r in E.apply_edits(df, "n", edits).collect())
    assert got == list(enumerate(clips, 1))


def test_silence_pairs(spark):
    lines = ["silence_end: 1.0", "silence_start: 2.0", "noise", "silence_start: 3.5", "silence_end: 5.0 | x", "silence_end: 6.0", "silence_start: 7"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "media_id bigint, line_no bigint, line string")
    assert rows(E.silence_pairs(df), "start_s", "end_s", "length_s") == [(3.5, 5.0, 1.5)]
