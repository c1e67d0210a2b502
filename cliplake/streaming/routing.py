"""Notification routing: which event goes to which channel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplake.operators.ordered import fused

# Event types and the settings every channel needs.
EVENT_TYPES = ("on_transcode_complete", "on_merge_complete", "on_upload_complete", "on_error")
CHANNEL_SETTINGS = {
    "macos": (),
    "telegram": ("bot_token", "chat_id"),
    "discord": ("webhook_url",),
    "slack": ("webhook_url",),
}
ON_BY_DEFAULT = ("macos",)


def ready_channels(channels: DataFrame) -> DataFrame:
    """Channels (channel, enabled, settings map) that are switched on and completely set up."""
    ready = F.lit(False)
    for name, needed in CHANNEL_SETTINGS.items():
        complete = F.lit(True)
        for key in needed:
            complete = complete & (F.coalesce(F.element_at("settings", key), F.lit("")) != "")
        on = F.coalesce("enabled", F.lit(name in ON_BY_DEFAULT))
        ready = ready | ((F.col("channel") == name) & on & complete)
    return channels.filter(ready).select("channel")


def subscriptions(rules: DataFrame, channels: DataFrame) -> DataFrame:
    """(event_type, channel) pairs: a type is on unless its rule says no."""
    types = ready_channels(channels).withColumn("event_type", F.explode(F.array(*[F.lit(t) for t in EVENT_TYPES])))
    off = rules.filter(~F.col("enabled")).select("event_type").distinct()
    return types.join(off, "event_type", "left_anti")


def route(events: DataFrame, subscribed: DataFrame) -> DataFrame:
    """One outbox row per event and subscribed channel; works on streams as well."""
    return events.join(subscribed, "event_type")


def route_as_of(events: DataFrame, rule_log: DataFrame, channels: DataFrame) -> DataFrame:
    """Events (event_id, event_type, at) routed by the rules as they stood at that moment.

    ``rule_log`` holds changes (rule_id, event_type, enabled, valid_from). A change holds from its
    moment on, also for events of that very moment; of changes at one moment the last by id
    counts. A type is on before its first change and where a change says nothing. Changes
    and events are read along time in one ordered scan, in range blocks, as there are
    few types and each may have any number of events.
    """
    none = F.lit(None)
    changes = rule_log.select(
        "event_type", F.col("valid_from").alias("at"), F.lit(0).alias("kind"), F.col("rule_id").cast("bigint").alias("no"),
        F.coalesce("enabled", F.lit(True)).alias("on"),
    )
    asked = events.select("event_type", "at", F.lit(1).alias("kind"), F.col("event_id").cast("bigint").alias("no"), none.cast("boolean").alias("on"))
    known = fused(changes.unionByName(asked), ["event_type"], ["at", "kind", "no"], now=("last", F.col("on")))
    sent = known.where(F.col("event_type").isin(*EVENT_TYPES) & (F.col("kind") == 1) & F.coalesce("now", F.lit(True)))
    return sent.select(F.col("no").alias("event_id"), "event_type", "at").crossJoin(ready_channels(channels))  # four channels at most


def outbox_writer(
    folder: str,
    read_rules: Callable[[], DataFrame],
    read_channels: Callable[[], DataFrame],
    send: dict[str, Callable[[DataFrame, int], None]] | None = None,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that fills an outbox partitioned by batch.

    Rules and channels are read again for every batch, so changes take effect between
    batches. A batch that is retried overwrites its own folder. ``send`` may hand a
    channel's rows on; a channel that fails is noted and does not stop the others.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        routed = route(batch, subscriptions(read_rules(), read_channels()))
        routed.write.mode("overwrite").parquet(f"{folder}/outbox/batch={batch_id}")
        spark = batch.sparkSession
        stored = spark.read.schema(routed.schema).parquet(f"{folder}/outbox/batch={batch_id}")
        failures = []
        for channel, deliver in (send or {}).items():
            try:
                deliver(stored.filter(F.col("channel") == channel), batch_id)
            except Exception as exc:  # noqa: BLE001 - one channel must not stop the others
                failures.append((channel, str(exc)))
        # also without failures, so that a retry that succeeds leaves none behind
        spark.createDataFrame(failures, "channel string, error string").write.mode("overwrite").parquet(
            f"{folder}/failures/batch={batch_id}"
        )

    return write
