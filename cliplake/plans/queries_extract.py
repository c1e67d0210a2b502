"""Extraction of typed rows from raw text that Spark writes from the driver's tables.

The SQL side never parses that text: it states the expected values from the columns
the text was made of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cliplake.functions.labels import clock_label, file_stem
from cliplake.operators import extract as I
from cliplake.operators import sequences as E
from cliplake.operators import state as K
from cliplake.plans import views as V
from cliplake.plans.queries_sequences import PARTS_SQL, clock_sql, part_chapters, runs_sql
from cliplake.plans.registry import query

c = F.col


def _stream(**fields: str) -> str:
    names = (
        "codec_type codec_name width height pix_fmt r_frame_rate avg_frame_rate duration color_transfer"
        " sample_aspect_ratio sample_rate channels tags"
    ).split()
    typed = {"width": "cast(NULL AS int)", "height": "cast(NULL AS int)", "tags": "cast(NULL AS map<string,string>)"}
    return "named_struct(" + ", ".join(
        f"'{n}', {fields.get(n, typed.get(n, 'cast(NULL AS string)'))}" for n in names
    ) + ")"


_VIDEO = _stream(
    codec_type="'video'",
    codec_name="CASE WHEN z % 3 = 0 THEN 'h264' ELSE 'hevc' END",
    width="CASE WHEN k % 29 = 0 THEN NULL WHEN z % 4 = 0 THEN 1080 ELSE 3840 END",
    height="CASE WHEN z % 4 = 0 THEN 1920 ELSE 2160 END",
    pix_fmt="CASE WHEN z % 5 = 0 THEN NULL ELSE 'yuv420p10le' END",
    r_frame_rate="CASE k % 4 WHEN 0 THEN '30000/1001' WHEN 1 THEN '60/1' WHEN 2 THEN '0/0' END",
    avg_frame_rate="CASE k % 3 WHEN 0 THEN '30000/1001' WHEN 1 THEN '60/1' END",
    duration="CASE WHEN z % 6 = 0 THEN NULL WHEN z % 13 = 0 THEN 'N/A' ELSE cast(k / 8.0D + 1 AS string) END",
    color_transfer="CASE WHEN z % 7 = 0 THEN 'arib-std-b67' WHEN z % 7 = 1 THEN 'bt709' END",
    sample_aspect_ratio="CASE z % 4 WHEN 0 THEN '1:1' WHEN 1 THEN '0:1' WHEN 2 THEN '4:3' END",
    tags="map_filter(map('rotate', CASE k % 9 WHEN 0 THEN '90' WHEN 1 THEN 'x' END,"
    " 'handler_name', CASE WHEN k % 10 = 3 THEN 'GoPro AVC' END), (n, v) -> v IS NOT NULL)",
)
_AUDIO = _stream(
    codec_type="'audio'", codec_name="'aac'", sample_rate="CASE WHEN z % 8 = 0 THEN 'bad' ELSE '48000' END", channels="'2'"
)
_TAGS = """map_filter(map('com.apple.quicktime.model', CASE WHEN k % 7 = 0 THEN concat('Apple iPhone ', k % 20, ' Pro 24mm') END,
    'encoder', CASE WHEN k % 7 = 1 THEN ' DJI Pocket' END, 'firmware', CASE WHEN k % 7 = 2 THEN concat('HD', k % 12, '.01') END,
    'com.apple.quicktime.location.ISO6709', CASE WHEN k % 6 = 0 THEN concat('+', k % 90, '.5665-', k % 180, '.978+030/') END,
    'location', CASE k % 6 WHEN 1 THEN concat('S ', k % 90, '.12, W ', k % 180, '.31') WHEN 3 THEN '+95.0+10.0' END,
    'latitude', CASE WHEN k % 6 = 2 THEN concat('lat: -', k % 90) END, 'longitude', CASE WHEN k % 6 = 2 THEN concat('lon=', k % 180, '.25') END,
    'gps_note', CASE WHEN k % 6 = 4 THEN concat(' Han River ', k, ' ') END), (n, v) -> v IS NOT NULL)"""
_SIDECAR = "CASE k % 5 WHEN 0 THEN concat('1\\n00:00:01,000 --> 00:00:02,000\\nGPS ', k % 90, '.5 , ', k % 180, '.25\\n') WHEN 1 THEN concat('2\\n00:00:01,000 --> 00:00:02,000\\nN', k % 90, ' E', k % 180) WHEN 2 THEN '3\\nnothing here' END"


def _probes(spark, sf):
    return V.load(spark, sf, "part").selectExpr("p_partkey AS k", "p_size AS z").selectExpr(
        "k AS media_id",
        f"CASE WHEN k % 23 = 0 THEN '{{broken' ELSE to_json(named_struct('streams', concat(CASE WHEN k % 11 = 0 THEN array() ELSE array({_VIDEO}) END,"
        f" array_repeat({_AUDIO}, cast(k % 4 AS int))), 'format', named_struct('duration', cast(k / 4.0D + 1 AS string), 'tags', {_TAGS}))) END AS raw",
        "CASE z % 5 WHEN 0 THEN 'NIKON CORPORATION' WHEN 1 THEN 'Sony' WHEN 3 THEN ' acme cam co' WHEN 4 THEN '' END AS make",
        "CASE z % 5 WHEN 0 THEN 'NIKON Z 8' WHEN 1 THEN 'ILCE-7M4' WHEN 2 THEN 'HERO8 Black' WHEN 3 THEN 'ACME X' ELSE CASE WHEN z % 2 = 0 THEN 'Foo' END END AS model",
        f"{_SIDECAR} AS sidecar",
    )


_P = "p AS (SELECT p_partkey AS k, p_size AS z FROM part)"
_REASON = """CASE WHEN k % 23 = 0 THEN 'unreadable json' WHEN k % 11 = 0 THEN 'no video stream' WHEN k % 29 = 0 THEN 'incomplete video stream'
    WHEN (z % 6 <> 0 AND z % 13 = 0) OR k % 9 = 1 THEN 'unreadable number' END"""


@query(
    "I1_probe_metadata",
    f"""WITH {_P}, r AS (SELECT *, {_REASON} AS reason, CASE k % 4 WHEN 0 THEN 30000 / 1001 WHEN 1 THEN 60 ELSE 0 END::DOUBLE AS fps, CASE k % 3 WHEN 0 THEN 30000 / 1001 WHEN 1 THEN 60 ELSE 0 END::DOUBLE AS avg FROM p)
    SELECT k AS media_id, CASE WHEN z % 4 = 0 THEN 1080 ELSE 3840 END AS width, CASE WHEN z % 4 = 0 THEN 1920 ELSE 2160 END AS height, CASE WHEN z % 3 = 0 THEN 'h264' ELSE 'hevc' END AS codec,
      CASE WHEN z % 5 = 0 THEN 'unknown' ELSE 'yuv420p10le' END AS pixel_format, round(fps, 6) AS fps, fps <> avg AS is_vfr, CASE WHEN z % 6 = 0 THEN k / 4.0 + 1 ELSE k / 8.0 + 1 END::DOUBLE AS duration_seconds,
      k % 9 = 0 OR z % 4 = 0 AS is_portrait, CASE WHEN z % 7 = 0 THEN 'arib-std-b67' WHEN z % 7 = 1 THEN 'bt709' END AS color_transfer, CASE z % 4 WHEN 0 THEN '1:1' WHEN 2 THEN '4:3' END AS sar,
      k % 4 > 0 AS has_audio, k % 4 AS audio_stream_count, CASE WHEN k % 4 > 0 THEN 'aac' END AS audio_codec, CASE WHEN k % 4 > 0 AND z % 8 <> 0 THEN 48000 END AS audio_sample_rate, CASE WHEN k % 4 > 0 THEN 2 END AS audio_channels
    FROM r WHERE reason IS NULL""",
)
def i1(spark, sf):
    good, _ = I.quarantine(I.probe_metadata(_probes(spark, sf)))
    return good.drop("reason", "color_space", "color_primaries")


@query(
    "I1_probe_coverage",
    f"WITH {_P} SELECT coalesce({_REASON}, 'ok') AS outcome, count(*) AS rows FROM p GROUP BY 1",
)
def i1c(spark, sf):
    return I.coverage(I.probe_metadata(_probes(spark, sf)))


_DEVICE = """CASE WHEN k % 23 > 0 AND k % 7 = 0 THEN 'iPhone ' || (k % 20) || ' Pro' WHEN k % 23 > 0 AND k % 7 = 2 THEN 'GoPro HERO ' || (k % 12)
    WHEN k % 23 > 0 AND k % 11 > 0 AND k % 10 = 3 THEN 'GoPro' WHEN z % 5 = 0 THEN 'Nikon Z 8' WHEN z % 5 = 1 THEN 'Sony ILCE-7M4' WHEN z % 5 = 2 THEN 'GoPro HERO8 Black' WHEN z % 5 = 3 THEN 'Acme X' WHEN z % 2 = 0 THEN 'Foo' END"""


@query("I2_device_model", f"WITH {_P} SELECT k AS media_id, {_DEVICE} AS device_model FROM p")
def i2(spark, sf):
    return I.device_models(_probes(spark, sf))


@query(
    "I3_location",
    f"""WITH {_P}, s AS (SELECT k, z, k % 23 > 0 AS ok FROM p),
    l AS (SELECT k, CASE WHEN ok AND k % 6 = 0 THEN k % 90 + 0.5665 WHEN ok AND k % 6 = 1 THEN -(k % 90 + 0.12) WHEN ok AND k % 6 = 2 THEN -(k % 90) WHEN ok AND k % 6 IN (3, 4) THEN NULL
        WHEN k % 5 = 0 THEN k % 90 + 0.5 WHEN k % 5 = 1 THEN k % 90 END::DOUBLE AS lat,
      CASE WHEN ok AND k % 6 = 0 THEN -(k % 180 + 0.978) WHEN ok AND k % 6 = 1 THEN -(k % 180 + 0.31) WHEN ok AND k % 6 = 2 THEN k % 180 + 0.25 WHEN ok AND k % 6 IN (3, 4) THEN NULL
        WHEN k % 5 = 0 THEN k % 180 + 0.25 WHEN k % 5 = 1 THEN k % 180 END::DOUBLE AS lon, CASE WHEN ok AND k % 6 = 3 THEN '+95.0+10.0' WHEN ok AND k % 6 = 4 THEN 'Han River ' || k END AS place FROM s)
    SELECT k AS media_id, round(lat, 6) AS latitude, round(lon, 6) AS longitude, CASE WHEN lat IS NOT NULL THEN printf('%.6f, %.6f', lat, lon) ELSE place END AS location FROM l""",
)
def i3(spark, sf):
    return I.locations(_probes(spark, sf))


@query(
    "I4_progress_log",
    """WITH p AS (SELECT user_id, rn, event_id, (event_id % 3) * 3600 + (event_id % 60) * 60 + event_id % 59 + (event_id % 100) / 100.0::DOUBLE AS t FROM ranked_events WHERE event_type <> 'error'),
    m AS (SELECT user_id, count(*) AS points, max_by(event_id, rn) AS e, max_by(t, rn) AS t FROM p GROUP BY 1)
    SELECT user_id AS media_id, points, round(t, 6) AS time_s, CAST(e AS DOUBLE) AS frame, (e % 60 + 0.5)::DOUBLE AS fps, CAST(e % 5000 AS DOUBLE) AS bitrate,
    CASE WHEN coalesce(v.duration_seconds, 0) <= 0 THEN 0 ELSE least(100, CAST(trunc(t / (v.duration_seconds * 5) * 100) AS BIGINT)) END AS percent FROM m LEFT JOIN videos v ON v.id = m.user_id""",
)
def i4(spark, sf):
    totals = V.videos(spark, sf).select(c("id").alias("media_id"), (c("duration_seconds") * 5).alias("total_s"))
    return I.latest_progress(V.progress_log(spark, sf), totals)


@query(
    "I5_silence_summary",
    """WITH m AS (SELECT user_id, rn, event_type = 'click' AS s, CASE WHEN event_type = 'click' THEN rn * 2 + 0.5 ELSE rn * 2 + 1.25 END AS t FROM ranked_events WHERE event_type IN ('click', 'view')),
    p AS (SELECT *, lag(s) OVER w AS ps, lag(t) OVER w AS pt FROM m WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
    g AS (SELECT user_id, count(*) AS n, sum(t - pt)::DOUBLE AS total FROM p WHERE NOT s AND ps GROUP BY 1)
    SELECT e.user_id AS media_id, e.lines, coalesce(g.n, 0) AS segments, round(coalesce(g.total, 0), 6) AS silence_s FROM (SELECT user_id, count(*) AS lines FROM events GROUP BY 1) e LEFT JOIN g ON g.user_id = e.user_id""",
)
def i5(spark, sf):
    return I.silence_summary(V.silence_log(spark, sf))


@query(
    "I5_silence_of_text",
    """SELECT event_id AS media_id, 1 AS segments, 2.5::DOUBLE AS silence_s FROM events WHERE event_id % 3 = 0""",
)
def i5t(spark, sf):
    raw = V.load(spark, sf, "events").selectExpr(
        "event_id AS media_id",
        "concat('frame=1\\n[x] silence_end: 1.0 | d\\n[x] silence_start: ', event_id, '.0\\n[x] silence_start: ', event_id + 1, '.5\\nframe=2\\n',"
        " CASE WHEN event_id % 3 = 0 THEN concat('[x] silence_end: ', event_id + 4, '.0 | silence_duration: 2.5') ELSE '' END) AS raw",
    )
    spans = E.silence_pairs(I.split_lines(raw))
    return spans.groupBy("media_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("length_s").alias("silence_s"))


@query(
    "I6_loudness",
    """WITH x AS (SELECT event_id, value, CASE event_id % 7 WHEN 0 THEN 'no loudness block' WHEN 1 THEN 'unreadable json' WHEN 2 THEN 'missing number' WHEN 3 THEN 'silent' END AS reason FROM events)
    SELECT event_id AS media_id, round(CASE WHEN reason IS NULL THEN -value END, 6) AS input_i, CASE WHEN reason IS NULL THEN -1.5::DOUBLE END AS input_tp, CASE WHEN reason IS NULL THEN (event_id % 10)::DOUBLE END AS input_lra,
    CASE WHEN reason IS NULL THEN -30.25::DOUBLE END AS input_thresh, CASE WHEN reason IS NULL THEN 0.5::DOUBLE END AS target_offset, reason FROM x""",
)
def i6(spark, sf):
    raw = V.load(spark, sf, "events").selectExpr(
        "event_id AS media_id",
        "CASE event_id % 7 WHEN 0 THEN 'frame=1\\n{\"input_i\": 1}' ELSE concat('size=N/A\\n[Parsed_loudnorm_0 @ 0x55]\\n{\\n\"input_i\" : \"', CASE WHEN event_id % 7 = 3 THEN '-inf' ELSE cast(-value AS string) END,"
        " CASE WHEN event_id % 7 = 1 THEN '\" oops }' ELSE concat('\",\\n\"input_tp\" : \"-1.50\",\\n\"input_lra\" : \"', event_id % 10, '.00\",\\n\"input_thresh\" : \"-30.25\"',"
        " CASE WHEN event_id % 7 = 2 THEN '' ELSE ',\\n\"target_offset\" : \"0.50\"' END, '\\n}\\n') END) END AS raw",
    )
    return I.loudness_stats(raw)


def _quality_raw(spark, sf):
    return V.load(spark, sf, "events").selectExpr(
        "event_id AS media_id",
        "concat('[ssim] All:0.5 (3.0)\\n[ssim] All:', CASE WHEN event_id % 9 = 0 THEN 'nan' ELSE concat('0.9', event_id % 100) END, ' (inf)\\n[psnr] y:1 average:', CASE event_id % 4 WHEN 0 THEN 'inf' WHEN 1 THEN concat(event_id % 50, '.25 min:1') ELSE '' END, '\\n',"
        " CASE event_id % 6 WHEN 0 THEN concat('[libvmaf] VMAF score: ', event_id % 100, '.5') WHEN 1 THEN concat('log {\"pooled_metrics\": {\"psnr\": {\"mean\": 4}, \"vmaf\": {\"min\": ', event_id % 100, '.75, \"mean\": 99}}}')"
        " WHEN 2 THEN concat('{\"metrics\": {\"vmaf\": ', event_id % 90, '.5}}\\n{\"version\": 3}\\n{broken') WHEN 3 THEN concat('{\"frames\": [{\"frameNum\": 0, \"metrics\": {\"vmaf\": ', event_id % 80, '.25}}]}') WHEN 4 THEN concat('{\"VMAF score\": \"', event_id % 70, '.5\"}') ELSE '' END) AS raw",
    )


_QUALITY = """q AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0.5 ELSE CAST('0.9' || (event_id % 100) AS DOUBLE) END::DOUBLE AS ssim, CASE event_id % 4 WHEN 1 THEN event_id % 50 + 0.25 END::DOUBLE AS psnr,
    CASE event_id % 6 WHEN 0 THEN event_id % 100 + 0.5 WHEN 1 THEN event_id % 100 + 0.75 WHEN 2 THEN event_id % 90 + 0.5 WHEN 3 THEN event_id % 80 + 0.25 WHEN 4 THEN event_id % 70 + 0.5 END::DOUBLE AS vmaf FROM events)"""


@query("I7_quality_scores", f"WITH {_QUALITY} SELECT event_id AS media_id, round(ssim, 6) AS ssim, round(psnr, 6) AS psnr, round(vmaf, 6) AS vmaf FROM q")
def i7(spark, sf):
    return I.quality_scores(_quality_raw(spark, sf))


@query(
    "I8_quality_report",
    f"""WITH {_QUALITY}, x AS (SELECT *, event_id % 10 > 0 AS present, event_id % 3 > 0 AS v FROM q)
    SELECT event_id AS pair_id, round(CASE WHEN present THEN ssim END, 6) AS ssim, round(CASE WHEN present THEN psnr END, 6) AS psnr, round(CASE WHEN present AND v THEN vmaf END, 6) AS vmaf,
    concat_ws(',', CASE WHEN NOT present THEN 'ssim' END, CASE WHEN NOT present OR psnr IS NULL THEN 'psnr' END, CASE WHEN NOT present OR NOT v OR vmaf IS NULL THEN 'vmaf' END) AS unavailable,
    concat_ws(',', CASE WHEN NOT present THEN 'files missing' END, CASE WHEN present AND psnr IS NULL THEN 'psnr: no score' END, CASE WHEN present AND v AND vmaf IS NULL THEN 'vmaf: no score' END) AS errors FROM x""",
)
def i8(spark, sf):
    pairs = V.load(spark, sf, "events").selectExpr(
        "event_id AS pair_id",
        "event_id % 10 > 0 AS present",
        "CASE WHEN event_id % 3 > 0 THEN array('ssim', 'psnr', 'vmaf') ELSE array('ssim', 'psnr') END AS supported",
    )
    out = I.quality_report(pairs, I.quality_scores(_quality_raw(spark, sf)))
    return out.withColumn("unavailable", F.concat_ws(",", "unavailable")).withColumn("errors", F.concat_ws(",", "errors"))


@query(
    "I9_flatten_clips",
    "SELECT merge_id, position, name, duration, coalesce(device, '-') AS device, shot_time FROM clips WHERE merge_id % 10 < 9",
)
def i9(spark, sf):
    records = K.merge_records(V.clips(spark, sf), short=True)
    merges = records.select(
        c("merge_id").alias("id"),
        "part",
        F.when(c("merge_id") % 10 == 9, "{not a list").otherwise(c("clips_info_json")).alias("clips_info_json"),
    )
    return I.flatten_clips(merges)


_CUE = "printf('%02d:%02d:%02d{m}%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000)"


def _cue(expr: str, mark: str) -> str:
    return _CUE.format(m=mark).replace("ms", f"CAST(trunc({expr} * 1000) AS BIGINT)")


@query(
    "I10_subtitles_srt",
    f"""SELECT media_id, 0 AS part, string_agg(n || chr(10) || {_cue('start_s::DOUBLE', ',')} || ' --> ' || {_cue('end_s::DOUBLE', ',')} || chr(10) || trim(text, ' ') || chr(10), chr(10) ORDER BY n) AS body
    FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS n FROM segments) GROUP BY 1""",
)
def i10(spark, sf):
    return I.subtitle_documents(V.segments(spark, sf), "srt")


@query(
    "I10_subtitles_vtt",
    f"""SELECT media_id, 0 AS part, 'WEBVTT' || chr(10) || chr(10) || string_agg({_cue('start_s::DOUBLE', '.')} || ' --> ' || {_cue('end_s::DOUBLE', '.')} || chr(10) || trim(text, ' ') || chr(10), chr(10) ORDER BY n) AS body
    FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS n FROM segments) GROUP BY 1""",
)
def i10v(spark, sf):
    return I.subtitle_documents(V.segments(spark, sf), "vtt")


_NL = "chr(10)"
_CH = f"chs AS (SELECT merge_id, run, {clock_sql('start_s')} || ' ' || replace(name, '.mp4', '') AS line FROM laid)"
_DEV = """dev AS (SELECT merge_id, string_agg(device, ', ' ORDER BY pos) AS devices FROM (SELECT merge_id, device, min(position) AS pos FROM clips WHERE coalesce(device, '') <> '' GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "I11_clip_summary",
    f"""WITH {runs_sql()}, {_CH}, t AS (SELECT merge_id, string_agg('| ' || position || ' | ' || name || ' | ' || coalesce(device, '-') || ' | ' || shot_time || ' | ' || {clock_sql('duration')} || ' |', {_NL} ORDER BY position) AS body FROM clips GROUP BY 1),
    k AS (SELECT merge_id, string_agg(line, {_NL} ORDER BY run) AS body FROM chs GROUP BY 1)
    SELECT merge_id, 0 AS part, '## 클립 정보' || {_NL} || {_NL} || '| # | 파일명 | 기종 | 촬영시간 | 길이 |' || {_NL} || '|---|--------|------|----------|------|' || {_NL} || t.body || {_NL} || {_NL} || '## YouTube 챕터' || {_NL} || {_NL} || '```' || {_NL} || k.body || {_NL} || '```' AS body
    FROM t JOIN k USING (merge_id)""",
)
def i11(spark, sf):
    return I.clip_summaries(V.clips(spark, sf), short=True)


@query(
    "I11_description",
    f"""WITH {runs_sql()}, {_CH}, {_DEV}, k AS (SELECT merge_id, string_agg(line, {_NL} ORDER BY run) AS body FROM chs GROUP BY 1)
    SELECT k.merge_id, 0 AS part, k.body || CASE WHEN devices IS NULL THEN '' ELSE {_NL} || {_NL} || '이 영상은 ' || devices || '로 촬영됨' END AS body FROM k LEFT JOIN dev ON dev.merge_id = k.merge_id""",
)
def i11d(spark, sf):
    return I.descriptions(V.clips(spark, sf), short=True)


_SUMMARY_SIZE = """CASE WHEN total_size_bytes < 1024 THEN total_size_bytes || ' B' WHEN total_size_bytes < 1024^2 THEN printf('%.1f', total_size_bytes / 1024) || ' KB' WHEN total_size_bytes < 1024^3 THEN printf('%.1f', total_size_bytes / 1024^2) || ' MB' ELSE printf('%.1f', total_size_bytes / 1024^3) || ' GB' END"""


@query(
    "I11_summary_document",
    f"""WITH t AS (SELECT merge_id, position, replace(name, '.mp4', '') AS stem, duration, coalesce(sum(duration) OVER (PARTITION BY merge_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM clips),
    g AS (SELECT merge_id, string_agg({clock_sql('s')} || ' ' || stem || {_NL}, '' ORDER BY position) AS ch,
      string_agg('| ' || position || ' | ' || stem || ' | ' || {clock_sql('duration')} || ' | ' || {clock_sql('s')} || ' |' || {_NL}, '' ORDER BY position) AS tab, sum(duration) AS total FROM t GROUP BY 1)
    SELECT id AS merge_id, 0 AS part, concat('# ', title, {_NL}, {_NL}, CASE WHEN date IS NOT NULL THEN '**촬영일**: ' || date || {_NL} END, '**총 길이**: ', {clock_sql('coalesce(total, 0)')}, {_NL},
      '**파일 크기**: ', {_SUMMARY_SIZE}, {_NL}, '**파일명**: ', regexp_extract(output_path, '[^/]*$'), {_NL}, {_NL}, '## YouTube 챕터', {_NL}, {_NL}, '```', {_NL}, ch, '```', {_NL}, {_NL},
      '## 클립 목록', {_NL}, {_NL}, '| # | 클립명 | 길이 | 시작 시간 |', {_NL}, '|---|--------|------|-----------|', {_NL}, tab, {_NL}, '## YouTube 설명 템플릿', {_NL}, {_NL}, '```', {_NL},
      CASE WHEN date IS NOT NULL THEN date || '에 촬영한 ' END, title, ' 영상입니다.', {_NL}, {_NL}, '📍 장소: ', {_NL}, '📷 장비: ', {_NL}, {_NL}, '⏱️ 타임라인', {_NL}, ch, {_NL}, '#vlog #여행 #일상', {_NL}, '```') AS body
    FROM merges LEFT JOIN g ON g.merge_id = id""",
)
def i11doc(spark, sf):
    outputs = V.merges(spark, sf).select(c("id").alias("merge_id"), "title", "date", c("total_size_bytes").alias("size_bytes"), "output_path")
    return I.summary_documents(outputs, V.clips(spark, sf), short=True)


@query(
    "I11_part_description",
    f"""WITH {runs_sql()}, {PARTS_SQL}, {_DEV}, o AS (SELECT l.merge_id, l.run, p.part_no, {clock_sql('greatest(0, l.start_s - p.ps)')} || ' ' || replace(l.name, '.mp4', '') AS line
      FROM laid l JOIN part_spans p ON p.merge_id = l.merge_id AND l.start_s < p.pe AND l.start_s + l.duration > p.ps), k AS (SELECT merge_id, part_no, string_agg(line, {_NL} ORDER BY run) AS body FROM o GROUP BY 1, 2)
    SELECT k.merge_id || '/' || k.part_no AS doc, 0 AS part, k.body || CASE WHEN devices IS NULL THEN '' ELSE {_NL} || {_NL} || '이 영상은 ' || devices || '로 촬영됨' END AS body FROM k LEFT JOIN dev ON dev.merge_id = k.merge_id""",
)
def i11p(spark, sf):
    chapters = part_chapters(spark, sf).select(
        "merge_id", "part_no", "run", clock_label(c("relative_s"), True).alias("clock"), file_stem(c("name")).alias("title")
    )
    out = I.part_descriptions(chapters, V.clips(spark, sf), short=True)
    return out.select(F.concat_ws("/", "merge_id", "part_no").alias("doc"), "part", "body")


@query(
    "I11_single_description",
    """SELECT id, concat_ws(chr(10), CASE WHEN coalesce(device_model, '') <> '' THEN 'Filmed with ' || device_model END, CASE WHEN id % 2 = 0 THEN 'Shot at ' || strftime(creation_time, '%H:%M:%S') END) AS body FROM videos""",
)
def i11s(spark, sf):
    shot = F.when(c("id") % 2 == 0, F.date_format("creation_time", "HH:mm:ss")).otherwise("")
    return V.videos(spark, sf).select("id", I.single_description(c("device_model"), shot).alias("body"))


@query(
    "I12_device_backfill",
    f"""WITH {_P}, d AS (SELECT k, {_DEVICE} AS nd FROM p WHERE k % 13 > 0), v AS (SELECT id, device_model, device_model IS NULL OR device_model = '' AS need FROM videos)
    SELECT v.id, CASE WHEN need AND nd IS NOT NULL THEN nd ELSE device_model END AS device_model, CASE WHEN NOT need THEN 'not needed' WHEN d.k IS NULL THEN 'missing' WHEN nd IS NULL THEN 'undetected' ELSE 'updated' END AS outcome
    FROM v LEFT JOIN d ON d.k = v.id""",
)
def i12(spark, sf):
    detected = I.device_models(_probes(spark, sf).filter("media_id % 13 > 0"))
    return I.backfill_devices(V.videos(spark, sf), detected).select("id", "device_model", "outcome")
