"""Progress of running jobs; the same aggregates over a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_progress(events: DataFrame) -> DataFrame:
    """Latest state per file from events (file_id, kind, seq, percent, eta_s, success).

    Kinds are ``start``, ``progress`` and ``done``.
    """
    kind, seq = F.col("kind"), F.col("seq")
    moving = kind == "progress"
    latest = events.groupBy("file_id").agg(
        F.max_by("percent", F.when(moving, seq)).alias("percent"),
        F.max_by("eta_s", F.when(moving, seq)).alias("eta_s"),
        F.max_by("success", F.when(kind == "done", seq)).alias("success"),
        F.max_by("kind", seq).alias("last_kind"),
    )
    state = (
        F.when(F.col("last_kind") != "done", F.lit("processing"))
        .when(F.col("success"), F.lit("done"))
        .otherwise(F.lit("failed"))
    )
    return latest.select(
        "file_id",
        F.when(F.col("last_kind") == "done", F.lit(100)).otherwise(F.coalesce("percent", F.lit(0))).alias("percent"),
        F.when(F.col("last_kind") != "done", F.col("eta_s")).alias("eta_s"),
        state.alias("state"),
    )


def overall_progress(events: DataFrame) -> DataFrame:
    """Finished files of the announced total, over all events."""
    return events.agg(
        F.count_if(F.col("kind") == "done").alias("done"),
        F.count_if((F.col("kind") == "done") & F.col("success")).alias("succeeded"),
        F.max("total_files").alias("total"),
    )
