"""The receive path as a stream: every micro-batch adds messages and contacts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from whisperlake.operators.changes import ADDED
from whisperlake.operators.inbox import implied_contacts, new_messages, received, unseen
from whisperlake.streaming import log

_KEY = "owner string, id string"
_CONTACT = "owner string, pubkey string, is_request boolean"


def stream_inbox(
    wraps: DataFrame, layers: Callable[[DataFrame], tuple[DataFrame, DataFrame]], processed: DataFrame,
    block_log: DataFrame, path: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None, block_keys: tuple[str, ...] | None = None,
) -> StreamingQuery:
    """Folds a stream of wraps into ``path``: tables of handled wraps, messages and contacts.

    ``layers`` gives the opened (seals, rumors) for a batch of wraps. A wrap is handled once in the life of the stream: its id
    is kept, per owner, with the batch that saw it first, and messages and contacts that exist are not added again.
    Each batch overwrites its own folders, so one that runs again after a lost executor or driver leaves the same rows. It reads only
    the parts of the three tables that its own keys fall into.
    ``on_change`` receives the added messages of every batch. ``trigger`` is passed to the stream (default: the stored part, then
    stop; a processing time keeps it going).
    """
    def fold(batch: DataFrame, batch_id: int) -> None:
        spark, keys, person = batch.sparkSession, ["owner", "id"], ["owner", "pubkey"]
        for table, schema, by in (("handled", _KEY, keys), ("message-ids", _KEY, keys), ("contacts", _CONTACT, person)):
            log.settle(spark, f"{path}/{table}", batch_id, schema, by)
        seen = log.before(spark, f"{path}/handled", batch_id, _KEY, batch, keys).drop("batch")
        # Kept with what the fold reads of a wrap, so that messages and contacts come from these rows alone.
        new = log.append(unseen(batch, seen, processed), f"{path}/handled", batch_id)
        kept = received(new, *layers(batch), block_log, block_keys)
        # Layers are not looked at where a batch brings nothing new.
        kept = log.append(spark.createDataFrame([], kept.schema) if new.isEmpty() else kept, f"{path}/received", batch_id)
        stored = log.before(spark, f"{path}/message-ids", batch_id, _KEY, kept, keys)
        added = log.append(new_messages(kept, stored), f"{path}/messages", batch_id)
        log.append(added.select(*keys), f"{path}/message-ids", batch_id)
        people = implied_contacts(kept)
        there = log.before(spark, f"{path}/contacts", batch_id, "owner string, pubkey string", people, person)
        log.append(people.join(there, person, "left_anti").select(people.columns), f"{path}/contacts", batch_id)
        if on_change is not None:
            on_change(added.withColumn("change", F.lit(ADDED)), batch_id)

    return wraps.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def current_messages(spark: SparkSession, path: str) -> DataFrame:
    """Message table of :func:`stream_inbox`: one row per (owner, id)."""
    return log.everything(spark, f"{path}/messages").drop("batch")


def current_contacts(spark: SparkSession, path: str) -> DataFrame:
    """Contacts implied so far; the batch that created one fixes its request flag."""
    return log.everything(spark, f"{path}/contacts").drop("batch")
