"""Column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliplake.functions import labels as L
from cliplake.functions import media as M
from cliplake.functions import specs as S
from cliplake.plans import views as V
from cliplake.plans.registry import query, ts

c = F.col


@query(
    "H1_duration_label",
    """WITH x AS (SELECT id, CAST(trunc(total_duration_seconds / 8) AS BIGINT) AS t FROM merges)
    SELECT id, CASE WHEN t >= 3600 THEN (t // 3600) || 'h ' || ((t % 3600) // 60) || 'm' WHEN t >= 60 THEN (t // 60) || 'm ' || (t % 60) || 's' ELSE t || 's' END AS label FROM x""",
)
def h1(spark, sf):
    return V.merges(spark, sf).select("id", L.duration_label(c("total_duration_seconds") / 8).alias("label"))


_CLOCK = "CASE WHEN {t} >= 3600 THEN ({t} // 3600) || ':' || lpad(CAST(({t} % 3600) // 60 AS VARCHAR), 2, '0') ELSE CAST(({t} % 3600) // 60 AS VARCHAR) END || ':' || lpad(CAST({t} % 60 AS VARCHAR), 2, '0')"


@query(
    "H2_clock_label",
    f"""WITH x AS (SELECT id, CAST(trunc((id % 9000) / 2.0) AS BIGINT) AS t, CAST(round_even((id % 9000) / 2.0, 0) AS BIGINT) AS r FROM merges)
    SELECT id, {_CLOCK.format(t='t')} AS progress_clock, {_CLOCK.format(t='r')} AS chapter_clock FROM x""",
)
def h2(spark, sf):
    s = (c("id") % 9000) / F.lit(2.0)
    return V.merges(spark, sf).select(
        "id", L.clock_label(s).alias("progress_clock"), L.clock_label(s, True).alias("chapter_clock")
    )


@query(
    "H3_size_label",
    """WITH x AS (SELECT id, CAST(total_size_bytes // 2 AS DOUBLE) * power(2, (id % 6) * 8 - 10) AS b FROM merges), y AS (SELECT id, floor(b) AS s FROM x)
    SELECT id, CASE WHEN s < 1024 THEN CAST(s AS BIGINT) || ' B' WHEN s / 1024 < 1024 THEN printf('%.1f', s / 1024) || ' KB'
      WHEN s / 1024^2 < 1024 THEN printf('%.1f', s / 1024^2) || ' MB' WHEN s / 1024^3 < 1024 THEN printf('%.1f', s / 1024^3) || ' GB'
      WHEN s / 1024^4 < 1024 THEN printf('%.1f', s / 1024^4) || ' TB' ELSE printf('%.1f', s / 1024^5) || ' PB' END AS label FROM y""",
)
def h3(spark, sf):
    size = F.floor(F.expr("cast(total_size_bytes div 2 AS double) * pow(2, (id % 6) * 8 - 10)"))
    return V.merges(spark, sf).select("id", L.size_label(size).alias("label"))


@query(
    "H4_path_tail",
    "SELECT page_id, CASE WHEN length(url) <= 30 THEN url ELSE '...' || right(url, 27) END AS tail FROM pages",
)
def h4(spark, sf):
    return V.load(spark, sf, "pages").select("page_id", L.path_tail(c("url"), 30).alias("tail"))


_DATE_TEXT = """CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN {iso} WHEN 2 THEN {compact} WHEN 3 THEN concat('unknown-', event_id) ELSE NULL END"""


@query(
    "H5_capture_date",
    """SELECT event_id, CASE event_id % 5 WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y-%m-%d')
    WHEN 3 THEN substr('unknown-' || event_id, 1, 10) ELSE '-' END AS day FROM events""",
)
def h5(spark, sf):
    text = _DATE_TEXT.format(
        iso="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", compact="date_format(ts, \"yyyyMMdd'T'HHmmss\")"
    )
    return V.load(spark, sf, "events").select("event_id", L.capture_date(F.expr(text)).alias("day"))


@query(
    "H6_device_label",
    "SELECT id, CASE WHEN trim(coalesce(device_model, '')) = '' THEN '미상' ELSE trim(device_model) END AS device FROM videos",
)
def h6(spark, sf):
    return V.videos(spark, sf).select(
        "id", L.device_label(F.when(c("id") % 3 == 0, F.concat(F.lit(" "), "device_model", F.lit("  "))).otherwise(c("device_model"))).alias("device")
    )


@query(
    "H7_folder_topic",
    """SELECT id, CASE WHEN id % 3 = 2 THEN NULL ELSE strftime(created_at, '%Y-%m-%d') END AS topic_date,
    CASE WHEN id % 3 = 2 THEN 'Trip ' || (id % 50) ELSE 'Trip ' || (id % 50) END AS topic FROM merges""",
)
def h7(spark, sf):
    path = F.expr(
        "CASE id % 3 WHEN 0 THEN concat('/m/', date_format(created_at, 'yyyy-MM-dd'), '  Trip ', id % 50, '/clip.mp4')"
        " WHEN 1 THEN concat('/m/', date_format(created_at, 'yyyy_MM_dd'), ' Trip ', id % 50)"
        " ELSE concat('/m/Trip ', id % 50, '/a.b.mov') END"
    )
    return V.merges(spark, sf).select("id", L.folder_topic(path).alias("t")).select(
        "id", c("t.date").alias("topic_date"), c("t.topic").alias("topic")
    )


@query(
    "H8_dated_title",
    """SELECT id, CASE WHEN id % 4 = 0 THEN title ELSE strftime(created_at, '%Y') || '년 ' || month(created_at) || '월 ' || day(created_at) || '일'
    || CASE WHEN id % 4 = 1 THEN '' ELSE ' ' || title END END AS title FROM merges""",
)
def h8(spark, sf):
    text = F.expr(
        "CASE id % 4 WHEN 0 THEN title WHEN 1 THEN date_format(created_at, 'yyyyMMdd')"
        " ELSE concat(date_format(created_at, 'yyyyMMdd'), repeat(' ', cast(id % 4 - 1 AS int)), title) END"
    )
    return V.merges(spark, sf).select("id", L.dated_title(text).alias("title"))


@query(
    "H9_clean_description",
    """WITH x AS (SELECT doc_id, replace(replace(text || '<b>', '<', ''), '>', '') AS t FROM documents),
    y AS (SELECT doc_id, t, substr(t, 1, 4995) AS head FROM x), z AS (SELECT *, length(head) - position(chr(10) IN reverse(head)) AS br, position(chr(10) IN reverse(head)) > 0 AS has FROM y)
    SELECT doc_id, CASE WHEN length(t) <= 5000 THEN t WHEN has AND br > 0 THEN left(head, br) || chr(10) || chr(10) || '...' ELSE head || chr(10) || chr(10) || '...' END AS description FROM z""",
)
def h9(spark, sf):
    docs = V.load(spark, sf, "documents")
    return docs.select("doc_id", L.clean_description(F.concat("text", F.lit("<b>"))).alias("description"))


@query(
    "H10_status_label",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '-' WHEN event_id % 10 = 1 THEN 'paused' ELSE CASE event_type WHEN 'click' THEN '⏳ 대기'
    WHEN 'view' THEN '🔄 진행' WHEN 'purchase' THEN '✅ 완료' WHEN 'error' THEN '❌ 실패' ELSE '📦 병합됨' END END AS label FROM events""",
)
def h10(spark, sf):
    status = F.when(c("id") % 9 == 0, "untracked").when(c("id") % 10 == 1, "paused").otherwise(c("status"))
    return V.jobs(spark, sf).select(c("id").alias("event_id"), L.status_label(status).alias("label"))


@query(
    "H11_project_labels",
    """WITH x AS (SELECT o_custkey AS id, strftime(min(o_orderdate), '%Y-%m-%d') AS s, strftime(max(o_orderdate), '%Y-%m-%d') AS e, count(*) AS n,
        count(*) FILTER (o_orderpriority LIKE '1-%') AS u FROM orders GROUP BY 1)
    SELECT id, CASE WHEN s = e THEN s ELSE s || ' ~ ' || e END AS date_range, CASE WHEN u = n THEN '전체 업로드 (' || n || '개)'
        WHEN u > 0 THEN '부분 업로드 (' || u || '/' || n || ')' ELSE '영상 ' || n || '개' END AS state FROM x""",
)
def h11(spark, sf):
    per = V.load(spark, sf, "orders").groupBy(c("o_custkey").alias("id")).agg(
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("s"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("e"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(c("o_orderpriority").startswith("1-")).alias("u"),
    )
    return per.select(
        "id",
        L.date_range_label(c("s"), c("e")).alias("date_range"),
        L.project_status_label(c("n"), c("u")).alias("state"),
    )


@query(
    "H12_path_parts",
    """SELECT id, regexp_extract(original_path, '([^/]*)$', 1) AS name, regexp_extract(original_path, '([^/]*)\\.mp4$', 1) AS stem,
    '.mp4' AS suffix, folder AS parent FROM videos""",
)
def h12(spark, sf):
    p = c("original_path")
    return V.videos(spark, sf).select(
        "id",
        L.file_name(p).alias("name"),
        L.file_stem(p).alias("stem"),
        L.file_suffix(p).alias("suffix"),
        L.parent_folder(p).alias("parent"),
    )


@query(
    "H13_duration_spec",
    """SELECT event_id, nullif(CASE event_id % 6 WHEN 0 THEN event_id % 100 WHEN 1 THEN (event_id % 30) * 3600 + (event_id % 60) * 60 WHEN 2 THEN (event_id % 77) * 60 + event_id % 55
    WHEN 3 THEN (event_id % 9) * 3600 + (event_id % 8) * 60 + event_id % 7 END, 0) AS seconds FROM events""",
)
def h13(spark, sf):
    text = F.expr(
        "CASE event_id % 6 WHEN 0 THEN cast(event_id % 100 AS string) WHEN 1 THEN concat(event_id % 30, 'h', event_id % 60, 'm')"
        " WHEN 2 THEN concat(event_id % 77, 'M', event_id % 55, 'S') WHEN 3 THEN concat(event_id % 9, 'h', event_id % 8, 'm', event_id % 7, 's')"
        " WHEN 4 THEN concat('-', event_id, 's') ELSE concat(event_id, 'x') END"
    )
    return V.load(spark, sf, "events").select("event_id", S.duration_spec(text).alias("seconds"))


@query(
    "H14_size_spec",
    """SELECT event_id, nullif(CASE event_id % 6 WHEN 0 THEN event_id WHEN 1 THEN CAST(trunc((event_id % 40 + 0.5) * 1024 * 1024 * 1024) AS BIGINT) WHEN 2 THEN (event_id % 300) * 1048576
    WHEN 3 THEN CAST(trunc((event_id % 9 + 0.25) * 1024) AS BIGINT) END, 0) AS bytes FROM events""",
)
def h14(spark, sf):
    text = F.expr(
        "CASE event_id % 6 WHEN 0 THEN cast(event_id AS string) WHEN 1 THEN concat(event_id % 40, '.5G') WHEN 2 THEN concat(event_id % 300, 'm')"
        " WHEN 3 THEN concat(event_id % 9, '.25K') WHEN 4 THEN concat('-', event_id, 'K') ELSE concat(event_id, 'T') END"
    )
    return V.load(spark, sf, "events").select("event_id", S.size_spec(text).alias("bytes"))


@query(
    "H15_clock_spec",
    """SELECT event_id, round(CASE event_id % 5 WHEN 0 THEN (event_id % 24) * 3600 + (event_id % 60) * 60 + event_id % 59 + 0.25 WHEN 1 THEN (event_id % 99) * 60 + event_id % 60
    WHEN 2 THEN event_id + 0.5 END::DOUBLE, 6) AS seconds FROM events""",
)
def h15(spark, sf):
    text = F.expr(
        "CASE event_id % 5 WHEN 0 THEN concat(' ', event_id % 24, ':', event_id % 60, ':', event_id % 59, '.25') WHEN 1 THEN concat(event_id % 99, ':', event_id % 60)"
        " WHEN 2 THEN concat(event_id, '.5') WHEN 3 THEN concat('-', event_id + 1) ELSE concat(event_id, ':x:1') END"
    )
    return V.load(spark, sf, "events").select("event_id", S.clock_spec(text).alias("seconds"))


@query(
    "H16_frame_rate",
    """SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN coalesce(CAST(event_id AS DOUBLE) / nullif(event_id % 1001, 0), 0) WHEN 1 THEN 29.97 WHEN 2 THEN 30.0 ELSE 0 END, 6) AS fps,
    CASE event_id % 4 WHEN 0 THEN coalesce(CAST(event_id AS DOUBLE) / nullif(event_id % 1001, 0), 0) WHEN 1 THEN 29.97 WHEN 2 THEN 30.0 ELSE 0 END <> 30.0 AS vfr FROM events""",
)
def h16(spark, sf):
    text = F.expr(
        "CASE event_id % 4 WHEN 0 THEN concat(event_id, '/', event_id % 1001) WHEN 1 THEN '29.97' WHEN 2 THEN '30/1' ELSE 'n/a' END"
    )
    fps = S.frame_rate(text)
    return V.load(spark, sf, "events").select(
        "event_id", fps.alias("fps"), (fps != S.frame_rate(F.lit("30"))).alias("vfr")
    )


@query(
    "H17_progress_percent",
    """SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 0 ELSE least(CAST(trunc(value / ((user_id % 10) * 20) * 100) AS BIGINT), 100) END AS percent,
    round(CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0 * value, 6) AS resume_at FROM events""",
)
def h17(spark, sf):
    e = V.load(spark, sf, "events")
    total = ((c("user_id") % 10) * 20).cast("double")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id",
        M.progress_percent(c("value"), total).alias("percent"),
        M.resume_position(k, c("value")).alias("resume_at"),
    )


@query(
    "H18_eta",
    """WITH x AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS p, value AS pos, value + user_id * 1.7182818 AS tot, CAST(event_id % 60 AS DOUBLE) AS fps FROM events)
    SELECT event_id, round(CASE WHEN p <= 0 THEN NULL WHEN p >= 100 THEN 0 WHEN pos <= 0 THEN NULL WHEN fps > 0 THEN greatest(0, (tot - pos) * 29.97 / fps)
      ELSE (tot - pos) * (1 / (pos / tot) - 1) END, 6) AS eta, round(CASE WHEN p <= 0 THEN NULL WHEN p >= 100 THEN 0 WHEN pos > 0 THEN greatest(0, pos * 100 / p - pos) END, 6) AS wall_eta FROM x""",
)
def h18(spark, sf):
    e = V.load(spark, sf, "events")
    p = F.get_json_object("props", "$.k").cast("int")
    fps = (c("event_id") % 60).cast("double")
    return e.select(
        "event_id",
        M.eta_seconds(p, c("value"), c("value") + c("user_id") * F.lit(1.7182818), fps).alias("eta"),
        M.wall_clock_eta(p, c("value")).alias("wall_eta"),
    )


@query(
    "H19_fade_plan",
    """WITH x AS (SELECT event_id, value / 50 AS t, greatest((event_id % 5 - 1) * 0.5, 0) AS fi, greatest((event_id % 3 - 1) * 1.0, 0) AS fo FROM events),
    y AS (SELECT *, CASE WHEN t >= fi + fo THEN 1 ELSE t / (fi + fo) END AS k, t <= 0.1 OR fi + fo <= 0 AS none FROM x)
    SELECT event_id, round(CASE WHEN none THEN 0 ELSE fi * k END, 6) AS fade_in, round(CASE WHEN none THEN 0 ELSE fo * k END, 6) AS fade_out,
    round(CASE WHEN none THEN 0 ELSE greatest(t - fo * k, 0) END, 6) AS fade_out_start FROM y""",
)
def h19(spark, sf):
    e = V.load(spark, sf, "events")
    plan = M.fade_plan(
        c("value") / 50, (c("event_id") % 5 - 1) * F.lit(0.5), (c("event_id") % 3 - 1) * F.lit(1.0)
    )
    return e.select("event_id", plan.alias("f")).select("event_id", "f.*")


@query(
    "H20_profile_class",
    """WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'arib-std-b67' WHEN 1 THEN 'smpte2084' WHEN 2 THEN 'bt709' END AS tr,
      CASE event_id % 3 WHEN 0 THEN 'bt2020nc' WHEN 1 THEN 'bt709' END AS sp FROM events)
    SELECT event_id, CASE WHEN tr = 'arib-std-b67' THEN 'hdr_hlg' WHEN tr = 'smpte2084' THEN 'hdr_pq' WHEN sp = 'bt2020nc' THEN 'hdr_hlg' ELSE 'sdr' END AS profile,
    coalesce(tr IN ('arib-std-b67', 'smpte2084'), FALSE) AS convert FROM x""",
)
def h20(spark, sf):
    e = V.load(spark, sf, "events").selectExpr(
        "event_id",
        "CASE event_id % 4 WHEN 0 THEN 'arib-std-b67' WHEN 1 THEN 'smpte2084' WHEN 2 THEN 'bt709' END AS tr",
        "CASE event_id % 3 WHEN 0 THEN 'bt2020nc' WHEN 1 THEN 'bt709' END AS sp",
    )
    return e.select(
        "event_id", M.profile_class(c("tr"), c("sp")).alias("profile"), M.needs_hdr_conversion(c("tr")).alias("convert")
    )


@query(
    "H21_thumbnail_plan",
    """SELECT id, n AS number, round(duration_seconds * CASE n WHEN 1 THEN 0.1 WHEN 2 THEN 0.33 ELSE 0.5 END, 6) AS at_seconds,
    regexp_extract(original_path, '([^/]*)\\.mp4$', 1) || '_thumb_0' || n || '.jpg' AS name
    FROM videos, (SELECT unnest([1, 2, 3]) AS n) WHERE duration_seconds > 0""",
)
def h21(spark, sf):
    v = V.videos(spark, sf)
    points = M.thumbnail_points(c("original_path"), c("duration_seconds"))
    return v.select("id", F.inline(points))


@query(
    "H22_resolution_spec",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 3840 WHEN 1 THEN 1920 WHEN 2 THEN 1280 WHEN 3 THEN 1 + event_id END AS width,
    CASE event_id % 6 WHEN 0 THEN 2160 WHEN 1 THEN 1080 WHEN 2 THEN 720 WHEN 3 THEN 2 + event_id END AS height FROM events""",
)
def h22(spark, sf):
    text = F.expr(
        "CASE event_id % 6 WHEN 0 THEN '4K' WHEN 1 THEN '1080p' WHEN 2 THEN '720P' WHEN 3 THEN concat(1 + event_id, 'X', 2 + event_id)"
        " WHEN 4 THEN concat('0x', event_id) ELSE 'wide' END"
    )
    e = V.load(spark, sf, "events").select("event_id", S.resolution_spec(text).alias("r"))
    return e.select("event_id", "r.width", "r.height")


@query(
    "H23_caption_text",
    """SELECT event_id, strftime(ts, '%Y.%m.%d') || CASE event_id % 3 WHEN 0 THEN ' | Place ' || user_id
    WHEN 1 THEN ' | ' || printf('%.6f', value / 10) || ', ' || printf('%.6f', -value / 5) ELSE '' END AS caption FROM events""",
)
def h23(spark, sf):
    e = V.load(spark, sf, "events")
    kind = c("event_id") % 3
    return e.select(
        "event_id",
        L.caption_text(
            c("ts"),
            F.when(kind == 0, F.concat(F.lit("Place "), "user_id")),
            F.when(kind == 1, c("value") / 10),
            F.when(kind == 1, -c("value") / 5),
        ).alias("caption"),
    )


@query(
    "H24_schedule_check",
    f"""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN date_trunc('second', ts) - INTERVAL 9 HOUR ELSE date_trunc('second', ts) END AS t FROM events),
    y AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(t)) / 1e6 AS late FROM x)
    SELECT event_id, t IS NOT NULL AND late <= 0 AS ok, {ts('t')} AS publish_at, CASE WHEN t IS NULL THEN 'invalid format' WHEN late > 0 THEN 'in the past: ' ||
      CASE WHEN late < 3600 THEN CAST(trunc(late / 60) AS BIGINT) || '분 전' WHEN late < 86400 THEN CAST(trunc(late / 3600) AS BIGINT) || '시간 전' ELSE CAST(trunc(late / 86400) AS BIGINT) || '일 전' END END AS reason FROM y""",
)
def h24(spark, sf):
    text = F.expr(
        "CASE event_id % 4 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 1 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
        " WHEN 2 THEN concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+09:00') ELSE concat('soon ', event_id) END"
    )
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return V.load(spark, sf, "events").select("event_id", S.schedule_check(text, now).alias("s")).select("event_id", "s.*")


@query(
    "H25_orientation",
    "SELECT p_partkey AS id, (p_size % 4) IN (1, 3) OR 1000 + p_size * 10 < 1000 + p_partkey % 400 AS portrait FROM part",
)
def h25(spark, sf):
    p = V.load(spark, sf, "part")
    return p.select(
        c("p_partkey").alias("id"),
        M.is_portrait((c("p_size") % 4) * 90, 1000 + c("p_size") * 10, 1000 + c("p_partkey") % 400).alias("portrait"),
    )


@query(
    "H26_music_bed",
    """WITH x AS (SELECT event_id, value - 5 AS m, CAST(user_id % 40 AS DOUBLE) AS v, event_id % 2 = 0 AS lp FROM events),
    y AS (SELECT *, CASE WHEN m <= 0 OR v <= 0 THEN 'invalid' WHEN m < v AND lp THEN 'loop_trim' WHEN m > v THEN 'trim_fade' ELSE 'as_is' END AS action FROM x)
    SELECT event_id, action, CASE WHEN action IN ('loop_trim', 'trim_fade') THEN v END AS trim_end, CASE WHEN action = 'trim_fade' THEN v - least(3, v) END AS fade_start,
    CASE WHEN action = 'trim_fade' THEN least(3, v) END AS fade_length FROM y""",
)
def h26(spark, sf):
    e = V.load(spark, sf, "events")
    plan = M.music_bed_plan(c("value") - 5, (c("user_id") % 40).cast("double"), c("event_id") % 2 == 0)
    return e.select("event_id", plan.alias("m")).select("event_id", "m.*")


@query(
    "H27_speed_chain",
    """WITH x AS (SELECT event_id, event_id % 64 AS s FROM events), y AS (SELECT *, (s > 2)::INT + (s > 4)::INT + (s > 8)::INT + (s > 16)::INT + (s > 32)::INT AS d FROM x)
    SELECT event_id, s AS speed, CASE WHEN s BETWEEN 2 AND 60 THEN repeat('2.0,', d) || printf('%.1f', s / power(2, d)) END AS chain FROM y""",
)
def h27(spark, sf):
    speed = (c("event_id") % 64).cast("bigint")
    return V.load(spark, sf, "events").select(
        "event_id", speed.alias("speed"), F.array_join(M.speed_chain(speed), ",").alias("chain")
    )
