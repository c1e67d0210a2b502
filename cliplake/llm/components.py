"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplake.llm.tables import stash


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with the smallest neighbour of u, itself included, as ``m``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def components(links: DataFrame) -> DataFrame:
    """``(id, component_id)`` for all ids of the links ``(a, b)``.

    ``component_id`` is the smallest id reachable. Links are undirected, may repeat and
    may join an id with itself; links with a null end are left out. Each round hangs every
    neighbour on the smallest id around (large star, small star), which needs a number of
    rounds that grows with the logarithm of the longest chain. Every round is written to
    the shared folder. The loop ends when a round changes no pair.
    """
    pairs = stash(
        links.where("a < b or b < a")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large)
        pairs = stash(
            small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = pairs.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("bigint"))
        ).first()
        if now == state:
            break
        state = now
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)
