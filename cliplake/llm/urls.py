"""URL filters by rules and a path-template tree (DataFrame functions only).

Per host the path segments form a tree over the different paths. From the root down a
segment becomes a wildcard where its position varies: segments with digits always by their
shape (``12.html`` and ``7.html`` are ``#.html``), plain ones if at least ``variety``
different ones stand at a position, of which none has more than ``2 / variety`` of the
paths there. Those that have more stay literal, and so does every name with ``ENOUGH``
labels or more whose purity differs significantly from that of the other names there, so
one bad section among many is not lost in a wildcard. Neither repeated rows nor more pages
of the same kind turn a wildcard back into literals.

Subtrees below the same parent whose labelled purity does not differ significantly from
that of all their siblings are merged, level by level, so a leaf is compared with the
leaves of all merged subtrees; a leaf that differs from those stands alone. A branch is
rejected if its share of good labels, smoothed towards its host and the host towards all
pages, is below ``purity``. The tree has as many rounds as the deepest segment up to which
two paths of a merged branch go together; there is no limit of depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplake.llm.tables import stash

ENOUGH = 5  # labels of a name below which it is not told apart from its wildcard
CHANCE = 0.05  # that any name of a position is told apart without reason, about
RULES = (  # the contract's rules, fixed values
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        at, _, tail = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + tail)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _apart(n: Column, good: Column, all_n: Column, all_good: Column, z: Column) -> Column:
    """Whether ``good`` of ``n`` differs from the rest of ``all_good`` of ``all_n``; false
    without labels on either side."""
    rest, pooled = all_n - n, F.try_divide(all_good, all_n)
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), rest)))
    return F.coalesce(F.abs(F.try_divide(good, n) - F.try_divide(all_good - good, rest)) > z * spread, F.lit(False))


def _label(segment: Column) -> Column:
    """The shape of a segment with digits; others as they are, apart from wildcards."""
    return F.when(segment.rlike("[0-9]"), F.regexp_replace(segment, "[0-9]+", "#")).otherwise(
        F.regexp_replace(segment, r"([*#~\\])", r"\\$1")
    )


def _wildcards(rows: DataFrame, variety: int) -> DataFrame:
    """``(host, template, segment)`` of the plain names that a wildcard replaces."""
    keys = ["host", "template"]
    names = stash(
        rows.where("segment <> '' and not segment rlike '[0-9]'")
        .groupBy(*keys, "segment")
        .agg(F.count("*").alias("paths"), F.sum("n").alias("n"), F.sum("good").alias("good"))
    )
    places = names.groupBy(*keys).agg(
        F.sum("paths").alias("all_paths"), F.sum("n").alias("all_n"), F.sum("good").alias("all_good"),
        F.count_if(F.col("n") >= ENOUGH).alias("told"),
    )
    z = F.sqrt(2 * F.log(F.greatest("told", F.lit(1)) / CHANCE))
    rare = names.join(places, keys).where(f"paths * {variety} <= 2 * all_paths")
    literal = (F.col("n") >= ENOUGH) & _apart(F.col("n"), F.col("good"), F.col("all_n"), F.col("all_good"), z)
    varied = rare.groupBy(*keys).agg(F.count("*").alias("different")).where(f"different >= {variety}")
    return rare.where(~literal).select(*keys, "segment").join(varied.select(*keys), keys, "left_semi")


def templates(paths: DataFrame, variety: int = 10, z_limit: float = 1.96) -> DataFrame:
    """``(host, path, n, good, parent, template)`` of different ``(host, path, segments)`` with
    ``n`` labelled pages, ``good`` of them good. ``parent`` is the merged branch of the leaf's parent."""
    out = ["host", "path", "n", "good", "parent", "template"]
    rows = paths.select(*out[:4], F.lit("").alias("parent"), F.lit("").alias("template"), "segments", F.lit("").alias("branch"))
    done, at = [], 0
    while True:
        ended = F.size("segments") <= at
        # without siblings in its branch a path has no wildcards but shapes, and merges all the way
        alone = rows.where(~ended).groupBy("host", "branch").agg(F.count("*").alias("paths")).where("paths = 1").drop("paths")
        single = rows.where(~ended).join(alone, ["host", "branch"], "left_semi")
        left = F.slice("segments", at + 1, F.greatest(F.size("segments") - at, F.lit(1)))
        done.append(rows.where(ended).select(*out))
        done.append(
            single.withColumn("parent", F.concat("branch", F.repeat(F.lit("/~"), F.size("segments") - at - 1)))
            .withColumn("template", F.concat("template", F.lit("/"), F.array_join(F.transform(left, _label), "/")))
            .select(*out)
        )
        rows = rows.where(~ended).join(alone, ["host", "branch"], "left_anti")
        rows = stash(rows.withColumn("segment", F.get("segments", F.lit(at))))
        if rows.isEmpty():
            break
        wild = _wildcards(rows, variety).withColumn("wild", F.lit(True))
        rows = stash(
            rows.join(wild, ["host", "template", "segment"], "left").withColumn("label", F.when(F.col("wild"), "*").otherwise(_label(F.col("segment"))))
        )
        below = rows.groupBy("host", "branch", "label").agg(F.sum("n").alias("kn"), F.sum("good").alias("kgood"))
        family = below.groupBy("host", "branch").agg(F.sum("kn").alias("fn"), F.sum("kgood").alias("fgood"))
        differs = _apart(F.col("kn"), F.col("kgood"), F.col("fn"), F.col("fgood"), F.lit(z_limit))
        own = below.join(family, ["host", "branch"]).where(differs).select("host", "branch", "label", F.lit(True).alias("own"))
        rows = stash(
            rows.join(own, ["host", "branch", "label"], "left").select(
                *out[:4],
                F.col("branch").alias("parent"),
                F.concat("template", F.lit("/"), "label").alias("template"),
                "segments",
                F.concat("branch", F.lit("/"), F.when(F.col("own"), F.col("label")).otherwise("~")).alias("branch"),
            )
        )
        at += 1
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found


def judged_templates(
    labelled: DataFrame, strength: float = 5.0, purity: float = 0.5, z_limit: float = 1.96
) -> DataFrame:
    """``(host, template, branch, smoothed, rejected)`` from rows with ``parent``, ``template``
    and ``good`` (1, 0 or null for unlabelled)."""
    leaves = labelled.groupBy("host", "parent", "template").agg(
        F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")
    )
    return judged_leaves(leaves, strength, purity, z_limit)


def judged_leaves(leaves: DataFrame, strength: float = 5.0, purity: float = 0.5, z_limit: float = 1.96) -> DataFrame:
    """As :func:`judged_templates`, from one row ``(host, parent, template, n, good)`` a template."""
    families = leaves.groupBy("host", "parent").agg(F.sum("n").alias("fn"), F.sum("good").alias("fgood"))
    apart = _apart(F.col("n"), F.col("good"), F.col("fn"), F.col("fgood"), F.lit(z_limit))
    # a branch that stands apart keeps its name, all others below a parent share one
    placed = leaves.join(families, ["host", "parent"]).withColumn(
        "branch", F.when(apart, F.col("template")).otherwise(F.concat("parent", F.lit("/~")))
    )
    branches = placed.groupBy("host", "branch").agg(F.sum("n").alias("bn"), F.sum("good").alias("bgood"))
    hosts = leaves.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    overall = leaves.agg(F.sum("n").alias("an"), F.sum("good").alias("agood"))
    prior = (F.coalesce("agood", F.lit(0)) + 1) / (F.coalesce("an", F.lit(0)) + 2)
    smooth = (F.col("bgood") + strength * (F.col("hgood") + strength * prior) / (F.col("hn") + strength)) / (F.col("bn") + strength)
    return (
        placed.join(branches, ["host", "branch"])
        .join(hosts, "host")
        .crossJoin(F.broadcast(overall))  # one row
        .select("host", "template", "branch", smooth.alias("smoothed"), (smooth < purity).alias("rejected"))
    )


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
    variety: int = 10, strength: float = 5.0, purity: float = 0.5,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, smoothed)``, a row for each page row.

    ``labels`` has ``doc_id`` (the page) and ``quality`` (1 good, 0 bad); several labels of
    a page count as their minimum, null ones not at all. Null, empty and malformed urls
    have empty host and path and form a branch of their own. A null page id has no label.
    Repeated rows all stay and get equal verdicts, as evidence they count once; templates are
    learnt from all pages, also those that a rule decides. Without any label nothing is rejected by the tree.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    marked = parsed.join(marks.withColumnRenamed("doc_id", "page_id"), "page_id", "left")
    # a page is evidence once per path; unlabelled rows only name their paths
    evidence = marked.select("host", "path", F.when(F.col("good").isNotNull(), F.col("page_id")).alias("page"), "good").distinct()
    paths = stash(
        evidence.groupBy("host", "path").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    )
    parts = F.split("path", "/")
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))))
    tree = stash(templates(paths.withColumn("segments", segments), variety))
    leaves = tree.groupBy("host", "parent", "template").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    judged = judged_leaves(leaves, strength, purity)
    found = stash(tree.join(judged, ["host", "template"]).select("host", "path", "template", "smoothed", "rejected"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return parsed.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"),
        "template", "smoothed",
    )
