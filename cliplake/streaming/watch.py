"""Watch folders: which files to take, and when their size has settled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cliplake.functions.labels import file_name, file_suffix
from cliplake.functions.predicates import VIDEO_EXTENSIONS
from cliplake.operators.ordered import fused, hour_of


def wanted_files(events: DataFrame) -> DataFrame:
    """File events (kind, path, dest_path, is_directory, size, at) worth taking.

    A move counts for its target; folders, dot-files and other extensions are ignored.
    """
    path = F.when(F.col("kind") == "moved", F.col("dest_path")).otherwise(F.col("path"))
    name = file_name(path)
    keep = (
        ~F.coalesce("is_directory", F.lit(False))
        & ~name.startswith(".")
        & F.lower(file_suffix(path)).isin(*VIDEO_EXTENSIONS)
    )
    return events.filter(keep).select(path.alias("path"), "size", "at")


def watch_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream of files to take; the same file and size counts once within the delay."""
    return (
        wanted_files(events)
        .withWatermark("at", delay)
        .dropDuplicatesWithinWatermark(["path", "size"])
    )


def watch_batch(events: DataFrame) -> DataFrame:
    """The same over a finished event table: each file and size once, at its first event."""
    return wanted_files(events).groupBy("path", "size").agg(F.min("at").alias("at"))


def stable_batch(observations: DataFrame, checks: int) -> DataFrame:
    """Moments at which a path (path, seq, size, at) had one size ``checks`` times in a row.

    A missing size (the file is gone) or another size starts over, and so does a hit.
    """
    if checks <= 0:
        return observations.filter("size IS NOT NULL").select("path", "seq", "size", "at")
    starts = ~F.coalesce(F.col("size") == F.col("prev.size"), F.lit(False))
    rows = fused(observations, ["path"], ["at", "seq"], hour_of(F.col("at")), previous=["size"], uses=["size"], count=("since", starts))
    return rows.filter(F.col("size").isNotNull() & (F.col("count") % checks == 0)).select("path", "seq", "size", "at")


def stable_stream(
    observations: DataFrame, checks: int, delay: str = "1 hour", forget_after_ms: int = 3_600_000
) -> DataFrame:
    """Streaming form of :func:`stable_batch`.

    The state of a path is its last size and how often it was seen, never its history.
    A path without news for ``forget_after_ms`` of event time is forgotten;
    observations later than ``delay`` are dropped.
    """
    if checks <= 0:
        return observations.filter("size IS NOT NULL").select("path", "seq", "size", "at")

    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        hits = []
        for seq, size, at in zip(rows["seq"], rows["size"], rows["at"]):
            if pd.isna(size):
                last, seen = None, 0
                continue
            seen = seen + 1 if last is not None and size == last else 1
            last = int(size)
            if seen >= checks:
                hits.append((key[0], int(seq), last, at))
                last, seen = None, 0
        if last is None:
            state.remove()
        else:
            state.update((last, seen))
            newest = int(rows["at"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + forget_after_ms)
        if hits:
            yield pd.DataFrame(hits, columns=["path", "seq", "size", "at"])

    return (
        observations.withWatermark("at", delay)
        .groupBy("path")
        .applyInPandasWithState(
            settle,
            "path string, seq bigint, size bigint, at timestamp",
            "last bigint, seen int",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
