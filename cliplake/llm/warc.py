"""WARC revisits: a "not modified" capture takes its body from the latest earlier response.

An as-of join by canonical URL. A URL may hold a large share of all captures, so its
time line is cut into blocks: each block is scanned on its own, and only the last full
response of every block is carried to the later blocks. Bodies never move; records carry
ids, validators and headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplake.llm.urls import _LOWER, _UPPER

# RFC 9110 15.4.5: what a 304 response may update. Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
_TRACKING = "^(utm_[^=]*|fbclid|gclid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a last slash,
    query without tracking parameters and sorted, no scheme, no fragment; null stays null."""
    bare = F.regexp_replace(url, "#[\\s\\S]*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.translate(F.regexp_extract(rest, "^[^/?]*", 0), _UPPER, _LOWER)
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www\\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "\\?([\\s\\S]*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    """Names in lower case; of names that clash then, the last in the map's order counts."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    value = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, value))


def _validator(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(captures: DataFrame, block_seconds: int = 86_400) -> DataFrame:
    """Every revisit with its response: ``(record_id, canonical, at, status, response_id, headers)``.

    ``captures``: ``record_id`` bigint, ``url``, ``at`` bigint (seconds), ``kind``
    (``response`` or ``revisit``, others are ignored), ``headers`` map. The response is the
    latest one of the same canonical URL with smaller ``(at, record_id)``. ``status``:
    ``resolved`` if the strong forms of both ETags agree, or, where one has none, both
    Last-Modified do; ``changed`` if they differ; ``unverified`` if they share no
    validator; ``missing`` without an earlier response. Only ``resolved`` revisits have
    merged ``headers``: those of the response, updated by the revisit's permitted ones.
    Null headers count as none. Rows with null url or time are ``missing`` (revisits) or
    ignored (responses); repeated rows stay, each with the same answer.
    """
    lowered = _lowered(F.col("headers"))
    rows = captures.where("kind in ('response', 'revisit')").select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "at", "kind", lowered.alias("headers")
    )
    rows = rows.withColumn("block", F.floor(F.col("at") / block_seconds))
    usable = F.col("canonical").isNotNull() & F.col("at").isNotNull()
    # rows that cannot match anything are spread by their id
    spread = F.when(usable, F.lit(0)).otherwise(F.xxhash64("record_id"))
    is_response = (F.col("kind") == "response") & usable
    response = F.when(is_response, F.struct("record_id", "headers"))
    inside = Window.partitionBy("canonical", "block", spread).orderBy("at", "record_id", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    scanned = rows.withColumn("near", F.last(response, ignorenulls=True).over(inside)).where("kind = 'revisit'").drop("kind")
    carried = (
        rows.where(is_response)
        .groupBy("canonical", "block")
        .agg(F.max_by(F.struct("record_id", "headers"), F.struct("at", "record_id")).alias("last"))
    )
    # the last response of all earlier blocks that have one, for every block with revisits
    wanted = rows.where(usable & (F.col("kind") == "revisit")).select("canonical", "block").distinct()
    line = Window.partitionBy("canonical").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = (
        wanted.join(carried, ["canonical", "block"], "full")
        .select("canonical", "block", F.last("last", ignorenulls=True).over(line).alias("far"))
        .where("far is not null")
    )
    own, other = F.col("headers"), F.col("found.headers")
    etag, etag0, when, when0 = (F.element_at(h, F.lit(k)) for k in ("etag", "last-modified") for h in (own, other))
    status = (
        F.when(F.col("found").isNull(), "missing")
        .when(etag.isNotNull() & etag0.isNotNull(), F.when(_validator(etag) == _validator(etag0), "resolved").otherwise("changed"))
        .when(when.isNotNull() & when0.isNotNull(), F.when(when == when0, "resolved").otherwise("changed"))
        .otherwise("unverified")
    )
    allowed = F.map_filter(own, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(other, lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    return (
        scanned.join(far, ["canonical", "block"], "left")
        .withColumn("found", F.coalesce("near", "far"))
        .withColumn("status", status)
        .select(
            "record_id", "canonical", "at", "status",
            F.when(F.col("status") == "resolved", F.col("found.record_id")).alias("response_id"),
            F.when(F.col("status") == "resolved", merged).alias("headers"),
        )
    )
