"""One query per operator over whole tables, and DuckDB SQL where it can state the result."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplake.llm import conversations, embeddings, fingerprints, interactions, jaccard, licenses, lines, mixing, pieces, repetition, toxicity, urls, warc
from cliplake.llm.tables import stash, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send this library to the executors' Python, once per context."""
    context = spark.sparkContext
    if getattr(context, "_cliplake_shipped", False):
        return
    archive = f"{tempfile.mkdtemp()}/cliplake.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted(ROOT.rglob("*.py")):
            out.write(p, p.relative_to(ROOT.parent))
    context.addPyFile(archive)
    context._cliplake_shipped = True


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return build(spark, sf_dir)

        run.__name__, run.__doc__ = build.__name__, build.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run

    return register


def tokenizer(name: str = pieces.MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_ngram_jaccard_join",
    f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, {_WORDS.format(_ASCII_LOWER.format("coalesce(text, '')"))} AS w FROM documents
    ), s AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
        FROM d
    ), u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
    p AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
    ), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached)
    SELECT s.doc_id, len(s.g) AS n_shingles, c.component_id
    FROM s JOIN (SELECT id, min(reached) AS component_id FROM r GROUP BY id) c ON c.id = s.doc_id
    """,
)
def ngram_jaccard_join(spark, sf_dir):
    """Documents that link at 90 percent of their 3-word shingles."""
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=9, den=10)
    return found.withColumnRenamed("id", "doc_id")


@query(
    "op2_embedding_near_dedup",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), p AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.e, b.e) >= 0.95
    ), r AS (SELECT vec_id AS id, vec_id AS reached FROM embeddings UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.reached)
    SELECT e.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
    FROM embeddings e JOIN (SELECT id, min(reached) AS component_id FROM r GROUP BY id) c ON c.id = e.vec_id
    LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) l ON l.a = e.vec_id
    """,
)
def embedding_near_dedup(spark, sf_dir):
    """Links at cosine 0.95 and the vectors that stay."""
    found = embeddings.embedding_links(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )


@query(
    "op3_line_dedup",
    f"""
    WITH l AS (
        SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
        FROM documents WHERE text IS NOT NULL
    ), s AS (
        SELECT doc_id, i, list_sort(list_distinct({_WORDS.format(_ASCII_LOWER.format("line"))})) AS w FROM l
    ), d AS (  -- different sets, each with its first line
        SELECT w, len(w) AS n, min(doc_id * 1000000 + i) AS k FROM s WHERE len(w) > 0 GROUP BY w
    ), f AS (SELECT x, count(*) AS c FROM (SELECT unnest(w) AS x FROM d) GROUP BY x),
    o AS (
        SELECT k, n, x, row_number() OVER (PARTITION BY k ORDER BY c, x) AS p FROM (SELECT k, n, unnest(w) AS x FROM d) JOIN f USING (x)
    ), h AS (SELECT * FROM o WHERE p <= n - (n * 4 + 4) // 5 + 1),
    c AS (SELECT DISTINCT a.k AS a, b.k AS b FROM h a JOIN h b ON a.x = b.x AND a.k < b.k AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
    m AS (
        SELECT DISTINCT c.b AS k FROM c JOIN d a ON a.k = c.a JOIN d b ON b.k = c.b
        WHERE 5 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n - len(list_intersect(a.w, b.w)))
    ), g AS (
        SELECT s.doc_id, s.i FROM s JOIN d ON d.w = s.w WHERE s.doc_id * 1000000 + s.i > d.k OR d.k IN (SELECT k FROM m)
    ), t AS (SELECT doc_id, count(*) AS n_removed, string_agg(i, ',' ORDER BY i) AS removed FROM g GROUP BY doc_id)
    SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
        coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
    FROM documents LEFT JOIN t USING (doc_id)
    """,
)
def line_dedup(spark, sf_dir):
    """Lines that go from each document because an earlier line is nearly the same."""
    found = lines.line_report(table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


@query("op4_toxicity")
def toxicity_scores(spark, sf_dir):
    """Scores of all documents, learnt from the labels of the other folds."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_source_mixing")
def source_mixing(spark, sf_dir):
    """The words that the mix takes of every document."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def captures(pages: DataFrame) -> DataFrame:
    """Two captures of every page: a response at second ``page_id``, and a later revisit by
    another spelling of the url, with validators that mostly agree."""
    i, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    size = F.length("html").cast("string")
    second = i.cast("string")
    response = pages.select(
        (i * 2).alias("record_id"), "url", i.alias("at"), F.lit("response").alias("kind"),
        F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), second, F.lit("Content-Length"), size, F.lit("Vary"), F.lit("Accept")).alias("headers"),
    )
    etag = F.when(i % 5 == 0, '"changed"').when(i % 5 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("W/"), tag))
    when = F.when(i % 7 == 0, (i + 1).cast("string")).otherwise(second)
    headers = F.map_filter(
        F.create_map(F.lit("etag"), etag, F.lit("LAST-MODIFIED"), when, F.lit("Expires"), second, F.lit("content-length"), F.lit("0")),
        lambda _, v: v.isNotNull(),
    )
    revisit = pages.select(
        (i * 2 + 1).alias("record_id"),
        F.concat(F.regexp_replace(F.regexp_replace("url", "^http://", "https://WWW."), "#.*$", ""), F.lit("#again")).alias("url"),
        (i + 1 + i % 1000).alias("at"), F.lit("revisit").alias("kind"), headers.alias("headers"),
    )
    return response.union(revisit)


_HOSTED = "regexp_replace(regexp_replace({0}, '#[\\s\\S]*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"


@query(
    "op6_warc_revisits",
    rf"""
    WITH c AS (
        SELECT page_id * 2 AS record_id, url, page_id AS t, true AS full_response, '"' || md5(html) || '"' AS etag,
            page_id::VARCHAR AS modified, length(html)::VARCHAR AS content_length, NULL AS expires FROM pages
        UNION ALL
        SELECT page_id * 2 + 1, regexp_replace(regexp_replace(url, '^http://', 'https://WWW.'), '#.*$', '') || '#again',
            page_id + 1 + page_id % 1000, false,
            CASE page_id % 5 WHEN 0 THEN '"changed"' WHEN 1 THEN NULL ELSE 'W/"' || md5(html) || '"' END,
            CASE WHEN page_id % 7 = 0 THEN page_id + 1 ELSE page_id END::VARCHAR, '0', page_id::VARCHAR FROM pages
    ), r AS (SELECT *, {_HOSTED.format("url")} AS rest FROM c),
    n AS (
        SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '')
            || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS page,
            list_sort(list_filter(string_split(regexp_extract(rest, '\?([\s\S]*)$', 1), '&'),
                lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|fbclid|gclid)(=.*)?$'))) AS q FROM r
    ), k AS (SELECT *, page || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM n),
    w AS (
        SELECT *, max(CASE WHEN full_response THEN {{'t': t, 'record_id': record_id, 'etag': etag, 'modified': modified, 'content_length': content_length}} END)
            OVER (PARTITION BY canonical ORDER BY t, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM k
    ), s AS (
        SELECT *, CASE WHEN f IS NULL THEN 'missing'
            WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = f.etag THEN 'resolved' ELSE 'changed' END
            WHEN modified = f.modified THEN 'resolved' ELSE 'changed' END AS status
        FROM w WHERE NOT full_response
    )
    SELECT record_id, canonical, t AS "at", status,
        CASE WHEN status = 'resolved' THEN f.record_id END AS response_id,
        CASE WHEN status = 'resolved' THEN coalesce(etag, f.etag) END AS etag,
        CASE WHEN status = 'resolved' THEN f.modified END AS last_modified,
        CASE WHEN status = 'resolved' THEN f.content_length END AS content_length,
        CASE WHEN status = 'resolved' THEN expires END AS expires
    FROM s
    """,
)
def warc_revisits(spark, sf_dir):
    """Revisits derived from all pages, resolved against their responses."""
    found = warc.resolve_revisits(captures(table(spark, sf_dir, "pages")), block_seconds=3_600)
    names = ("etag", "last-modified", "content-length", "expires")
    return found.select(
        "record_id", "canonical", "at", "status", "response_id",
        *[F.element_at("headers", F.lit(n)).alias(n.replace("-", "_")) for n in names],
    )


def _window_sql(n: int) -> str:
    """Words of each text inside windows of ``n`` words that it has twice or more."""
    ahead = ", ".join(["x", *[f"lead(x, {k}) OVER o" for k in range(1, n)]])
    return f"""g{n} AS (SELECT doc_id, i, concat_ws(' ', {ahead}) AS s, m FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    r{n} AS (SELECT doc_id, i FROM g{n} WHERE i + {n - 1} <= m QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
    p{n} AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM r{n}),
    c{n} AS (SELECT doc_id, count(*) AS words, sum(length(x)) AS chars FROM p{n} JOIN t USING (doc_id, i) GROUP BY doc_id)"""


_LIMITS = repetition.GRAM_LIMITS


@query(
    "op7_quality_rules",
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS m FROM d),
    {", ".join(_window_sql(n) for n in _LIMITS)},
    l AS (
        SELECT doc_id, line, count(*) AS n, any_value(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line
    ), ll AS (SELECT doc_id, sum(n) AS lines, sum(n - 1) AS again, sum((n - 1) * chars) AS again_chars FROM l GROUP BY doc_id),
    b AS (
        SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
            length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(again, 0)::BIGINT AS n_dup_lines,
            coalesce(c5.words, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(c5.words, 0) > 20 * len(w) AS base_failed,
            coalesce(lines, 0) AS lines, coalesce(again_chars, 0) AS again_chars, {", ".join(f"coalesce(c{n}.chars, 0) AS g{n}" for n in _LIMITS)}
        FROM d LEFT JOIN ll USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in _LIMITS)}
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT (base_failed OR n_dup_lines > {repetition.LINE_LIMIT}::DOUBLE * lines OR again_chars > {repetition.LINE_CHARS_LIMIT}::DOUBLE * word_chars
            OR {" OR ".join(f"g{n} > {limit}::DOUBLE * word_chars" for n, limit in _LIMITS.items())}) AS kept
    FROM b
    """,
)
def quality_rules(spark, sf_dir):
    """Repetition measures and verdicts of all documents."""
    return repetition.repetition(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op8_url_filters")
def url_filters(spark, sf_dir):
    """Verdicts on all page urls; a page's label is the quality of the document of its id."""
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op9_sentencepiece")
def sentencepiece(spark, sf_dir):
    """Ids of all texts and the texts decoded from them, as digests."""
    both = pieces.encode(table(spark, sf_dir, "documents"), tokenizer(), round_trip=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_license_scan")
def license_scan(spark, sf_dir):
    """License notices in all documents with their spans."""
    return licenses.license_spans(table(spark, sf_dir, "documents"))


@query(
    "op12_filter_interactions",
    f"""
    WITH w AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
    ), k AS (SELECT doc_id, max(quality) AS good, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    f AS (
        SELECT part, coalesce(good, 0) = 1 AS good, coalesce(k.toxic, 0) = 1 AS toxic, {{
            'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
            'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
            'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)}} AS f
        FROM w LEFT JOIN k USING (doc_id)
    ), c AS (
        SELECT part, good, toxic, list_concat(CASE WHEN f.A THEN ['A'] ELSE [] END, CASE WHEN f.B THEN ['B'] ELSE [] END,
            CASE WHEN f.C THEN ['C'] ELSE [] END, CASE WHEN f.D THEN ['D'] ELSE [] END, CASE WHEN f.E THEN ['E'] ELSE [] END) AS fails, count(*) AS n
        FROM f GROUP BY ALL
    ), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
    ), r AS (  -- the step that removes, 6 for none
        SELECT part, good, toxic, fails, n, filter_order,
            coalesce(list_min(list_transform(fails, lambda x: instr(filter_order, x))), 6) AS gone FROM c, o
    ), s AS (
        SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, good, toxic, fails, n, gone,
            list_contains(fails, substr(filter_order, step, 1)) AS failing
        FROM r, (SELECT unnest(range(1, 6)) AS step)
    ), g AS (
        SELECT part, filter_order, step, letter,
            sum(n * (gone > step)::INT)::BIGINT AS kept, sum(n * (gone = step)::INT)::BIGINT AS removed,
            sum(n * (failing AND gone < step)::INT)::BIGINT AS redundant, sum(n * (failing AND len(fails) = 1)::INT)::BIGINT AS unique_fails,
            sum(n * (gone = step AND good)::INT)::BIGINT AS good_lost, sum(n * (gone = step AND toxic)::INT)::BIGINT AS toxic_lost
        FROM s GROUP BY ALL
    )
    SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
    FROM g
    """,
)
def filter_interactions(spark, sf_dir):
    """Outcomes of five filters in all their orders, per language."""
    return interactions.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_document_fingerprints")
def document_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts; for every twentieth document
    also how many others lie within three bits."""
    found = stash(fingerprints.fingerprints(table(spark, sf_dir, "documents")))
    found = fingerprints.near_counts(found, F.coalesce(F.col("id") % 20 == 0, F.lit(False)))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        fingerprints.as_hex(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.as_hex(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "n_near",
    )


def _states(initial: str, extra: str) -> str:
    """The four best (cost, audit) labels after one live row: Delete, Rerole, Keep.

    ``w`` holds them before it, insertions included."""
    label = lambda q, cost, letter: f"{{'c': w[{q}].c + {cost}, 'a': w[{q}].a || '{letter}'}}"
    kept = lambda q, to: f"CASE WHEN {initial} = '{to}' THEN {label(q, extra, 'K')} ELSE {label(q, 1000000000, 'K')} END"
    rerole = lambda q: label(q, f"1 + {extra}", "R")
    user = ", ".join([label(3, 2, "D"), *[f(q) for q in (1, 2, 4) for f in (rerole, lambda q: kept(q, "u"))]])
    return f"""[{label(1, 2, "D")}, list_min([{label(2, 2, "D")}, {kept(1, "s")}]), list_min([{user}]),
        list_min([{label(4, 2, "D")}, {rerole(3)}, {kept(3, "a")}])]"""


def _inserted(v: str) -> str:
    """Labels with insertions before the next row: at most one user, then one assistant."""
    more = lambda x: f"{{'c': {x}.c + 5, 'a': {x}.a || 'I'}}"
    user = f"list_min([{v}[3], {more(f'{v}[1]')}, {more(f'{v}[2]')}, {more(f'{v}[4]')}])"
    return f"[{v}[1], {v}[2], {user}, list_min([{v}[4], {more(f'{v}[3]')}, {more(f'{user}')}])]"


@query(
    "op11_conversation_repair",
    rf"""
    WITH RECURSIVE crc AS (  -- table of the checksum, one entry per byte
        SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
            lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    ), k AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
    ), x AS (
        SELECT k.*, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(key) + 1), lambda i: ord(substr(key, i, 1))::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS code FROM k, crc
    ), d AS (
        SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
            CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
        FROM x WHERE code <> 0
    ), o AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d
    ), f AS (
        SELECT conv_id, turn, role, text, i, role[:1] AS x, lag(role[:1]) OVER (PARTITION BY conv_id ORDER BY i) AS px,
            CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
        FROM o
    ), s AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
            count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
        FROM f GROUP BY conv_id
    ), r AS (  -- best labels per state: nothing yet, after s, after u, after a
        SELECT conv_id, 0 AS i, [{{'c': 0, 'a': ''}}, {{'c': 1000000000, 'a': ''}}, {{'c': 1000000000, 'a': ''}}, {{'c': 1000000000, 'a': ''}}] AS v FROM s
        UNION ALL
        SELECT conv_id, i, CASE WHEN fault IN ('blank', 'duplicate') THEN list_transform(w, lambda q: {{'c': q.c + 2, 'a': q.a || 'D'}})
            ELSE {_states("x", "(CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END)")} END
        FROM (SELECT f.conv_id, f.i, f.fault, f.x, {_inserted("r.v")} AS w FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1)
    ), e AS (
        SELECT s.*, list_min([w[1], w[4]]) AS best FROM (SELECT r.conv_id, r.i, {_inserted("r.v")} AS w FROM r) r
        JOIN s ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.n = r.i
    ), l AS (  -- letters with the row they consume
        SELECT conv_id, j, substr(best.a, j, 1) AS x, length(replace(substr(best.a, 1, j), 'I', '')) AS i
        FROM (SELECT conv_id, best, unnest(range(1, length(best.a) + 1)) AS j FROM e)
    ), m AS (
        SELECT l.*, f.role, f.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY j) AS k,
            first_value(CASE WHEN l.x = 'K' THEN f.x END) OVER (PARTITION BY l.conv_id ORDER BY j) = 's' AS led
        FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND l.x <> 'I' WHERE l.x <> 'D'
    ), t AS (
        SELECT conv_id, sha256(string_agg(CASE WHEN x = 'K' THEN role WHEN (k % 2 = 1) <> coalesce(led, false) THEN 'user' ELSE 'assistant' END
            || ':' || coalesce(text, ''), chr(10) ORDER BY j)) AS repaired FROM m GROUP BY conv_id
    )
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, coalesce(e.best.c, 0)::BIGINT AS cost, coalesce(e.best.a, '') AS audit, coalesce(repaired, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
)
def conversation_repair(spark, sf_dir):
    """Faults of all damaged conversations and their cheapest repair."""
    given = table(spark, sf_dir, "conversations")
    return conversations.with_lost(conversations.reports(conversations.repair(conversations.damage(given))), given)
