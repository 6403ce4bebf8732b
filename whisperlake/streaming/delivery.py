"""Delivery states as a stream: acknowledgements matched, and states kept, message by message."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from whisperlake.operators.changes import row_changes
from whisperlake.operators.delivery import match_acks
from whisperlake.schemas import FAILED, PUBLISH_TIMEOUT_SECONDS, SENDING, SENT
from whisperlake.streaming import log

_LOG = ("message_id long, relay long, attempt int, sent_at long, ack_ok boolean, ack_text string, acked_at long")
_STATE = "message_id long, n_accepted long, n_answered long, n_targets long, silent_since long"


def delivery_log(publishes: DataFrame, acks: DataFrame) -> DataFrame:
    """Sends and answers as one table or stream: ``attempt`` is null in answers."""
    return publishes.select("message_id", "relay", "attempt", "sent_at").unionByName(
        acks.select("message_id", "relay", "ack_ok", "ack_text", "acked_at"), allowMissingColumns=True)


def _summary(history: DataFrame, timeout: int) -> DataFrame:
    """Per message, of its latest attempt: relays that accepted and that answered, its targets, and the last send without answer."""
    keys = ["message_id", "relay", "attempt"]
    sends = history.filter("attempt is not null").groupBy(*keys).agg(F.min("sent_at").alias("sent_at"))
    answers = history.filter("attempt is null").select("message_id", "relay", "ack_ok", "ack_text", "acked_at")
    pairs = match_acks(sends, answers, timeout)
    per_attempt = pairs.groupBy("message_id", "attempt").agg(
        F.count_if("accepted").alias("n_accepted"), F.count("acked_at").alias("n_answered"), F.count(F.lit(1)).alias("n_targets"),
        F.max(F.when(F.col("acked_at").isNull(), F.col("sent_at"))).alias("silent_since"))
    latest = F.max_by(F.struct("n_accepted", "n_answered", "n_targets", "silent_since"), "attempt")
    return per_attempt.groupBy("message_id").agg(latest.alias("l")).select("message_id", "l.*")


def _dealt(history: DataFrame) -> DataFrame:
    """``history`` by message. A message has few rows, so they stay where they are for all groupings and joins that follow; the session is the stream's own."""
    history.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return history.repartition("message_id")


def stream_delivery(
    rows: DataFrame, path: str, checkpoint: str, timeout: int = PUBLISH_TIMEOUT_SECONDS, trigger: dict | None = None,
    on_change: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Keeps the state of every message of a stream of :func:`delivery_log` rows, in any order and however late.

    A batch appends its rows and matches again the messages that it touches, from all that was ever said about them. Nothing
    is dropped for its age, so the states are those of the batch form at any time. A batch that runs again replaces its rows.
    ``on_change`` receives the states that a batch added or updated, with ``change``.
    """
    def fold(batch: DataFrame, batch_id: int) -> None:
        spark, keys = batch.sparkSession, ["message_id"]
        log.settle(spark, f"{path}/log", batch_id, _LOG, keys)
        log.settle(spark, f"{path}/states", batch_id, _STATE, keys, newest=True)
        now = log.append(batch.select(*[c.split()[0] for c in _LOG.split(", ")]), f"{path}/log", batch_id)
        touched = now.select("message_id").distinct()
        old = log.before(spark, f"{path}/log", batch_id, _LOG, touched, keys).drop("batch")
        history = _dealt(now.unionByName(old.join(touched, "message_id", "left_semi")))
        states = log.append(_summary(history, timeout), f"{path}/states", batch_id)
        if on_change is not None:
            earlier = log.before(spark, f"{path}/states", batch_id, _STATE, touched, keys).join(states.select("message_id"), "message_id", "left_semi")
            on_change(row_changes(_last(earlier), states, keys).drop("old_id"), batch_id)

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def _last(rows: DataFrame) -> DataFrame:
    fields = F.struct(*[c for c in rows.columns if c not in ("message_id", "batch")])
    return rows.groupBy("message_id").agg(F.max_by(fields, "batch").alias("s")).select("message_id", "s.*")


def delivery_states(spark: SparkSession, path: str, as_of: int, timeout: int = PUBLISH_TIMEOUT_SECONDS) -> DataFrame:
    """State of every message by its latest attempt, at the time ``as_of``.

    Sent once a relay accepted; Failed when every target has answered or run out of time and none accepted; else Sending.
    ``relays_accepted`` only rises within an attempt; ``n_answered`` of its ``n_targets`` relays have answered in time.
    """
    last = _last(log.everything(spark, f"{path}/states", _STATE))
    waiting = F.coalesce(F.col("silent_since") + timeout > as_of, F.lit(False))
    status = F.when(F.col("n_accepted") > 0, SENT).when(waiting, SENDING).otherwise(FAILED)
    return last.select("message_id", F.col("n_accepted").alias("relays_accepted"), "n_answered", "n_targets", status.alias("status"))
