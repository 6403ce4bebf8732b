"""Delivery: acknowledgements, message states, relay and authentication reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whisperlake.functions.urls import is_onion
from whisperlake.schemas import FAILED, PUBLISH_TIMEOUT_SECONDS, SENDING, SENT

AUTH_REQUIRED = "auth-required:"
DUPLICATE = "duplicate:"


def rank_acks(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Keeps the deciding acknowledgement per key.

    One refusal that asks for authentication is answered by sending again, so the second
    answer then decides. Only the first two answers matter, and the rank limit drops the
    rest of a hot key before the shuffle.
    """
    by_time = Window.partitionBy(*keys).orderBy("acked_at", "ack_text", "ack_ok")
    first_two = pairs.withColumn("nth", F.row_number().over(by_time)).filter("nth <= 2")
    again = ~F.col("ack_ok") & F.col("ack_text").startswith(AUTH_REQUIRED)
    answer = F.struct("ack_ok", "ack_text", "acked_at")
    return (
        first_two.groupBy(*keys)
        .agg(
            F.max(F.when(F.col("nth") == 1, again)).alias("again"),
            F.max(F.when(F.col("nth") == 1, answer)).alias("one"),
            F.max(F.when(F.col("nth") == 2, answer)).alias("two"),
        )
        .select(*keys, F.when(F.col("again"), F.col("two")).otherwise(F.col("one")).alias("ack"))
    )


def match_acks(publishes: DataFrame, acks: DataFrame, timeout: int = PUBLISH_TIMEOUT_SECONDS) -> DataFrame:
    """Outcome of every (message, relay, attempt): accepted or not, answer text, answer time.

    publishes: message_id, relay, attempt, sent_at; acks: message_id, relay, ack_ok, ack_text,
    acked_at. No answer within ``timeout`` seconds counts as "timed out".
    """
    keys = ["message_id", "relay", "attempt"]
    sent = publishes.select(*keys, "sent_at")
    in_time = F.col("acked_at").between(F.col("sent_at"), F.col("sent_at") + timeout)
    pairs = sent.join(acks, ["message_id", "relay"]).filter(in_time)
    return sent.join(rank_acks(pairs, keys), keys, "left").select(
        *keys, "sent_at",
        F.coalesce(F.col("ack.ack_ok") | F.col("ack.ack_text").startswith(DUPLICATE), F.lit(False)).alias("accepted"),
        F.coalesce("ack.ack_text", F.lit("timed out")).alias("answer"),
        F.col("ack.acked_at").alias("acked_at"),
    )


def delivery_status(messages: DataFrame, attempts: DataFrame, as_of: int | None = None,
                    timeout: int = PUBLISH_TIMEOUT_SECONDS) -> DataFrame:
    """State of every message by its latest attempt.

    attempts: message_id, relay, attempt, outcome (accepted, rejected, pending), sent_at. One
    acceptance makes it Sent for good. It is Failed only when every target has answered and
    none accepted, or there were no targets. A silent relay counts as refused once ``as_of`` is
    past the timeout.
    """
    pending = F.col("outcome") == "pending"
    if as_of is not None:
        pending = pending & (F.col("sent_at") + timeout > F.lit(as_of))
    # Counts only, so both aggregations run as hash aggregations with partial sums.
    per_attempt = attempts.groupBy("message_id", "attempt").agg(
        F.count_if(F.col("outcome") == "accepted").alias("n_accepted"), F.count_if(pending).alias("n_open"))
    latest = per_attempt.groupBy("message_id").agg(
        F.max_by("n_accepted", "attempt").alias("n_accepted"), F.max_by("n_open", "attempt").alias("n_open"))
    status = (
        F.when(F.col("n_accepted") > 0, SENT)
        .when(F.coalesce("n_open", F.lit(0)) == 0, FAILED)
        .otherwise(SENDING)
    )
    return messages.select("message_id").join(latest, "message_id", "left").select(
        "message_id", status.alias("status"),
        F.coalesce("n_accepted", F.lit(0).cast("bigint")).alias("relays_accepted"))


def delivery_tick(status: Column, relays_accepted: Column) -> Column:
    """Clock while sending, one tick when stored, two when stored on several relays."""
    return F.coalesce(
        F.when(status == SENDING, "clock")
        .when(status == SENT, F.when(relays_accepted > 1, "two ticks").otherwise("one tick"))
        .when(status == FAILED, "error"),
        F.lit(""),
    )


def delivery_ticks(states: DataFrame) -> DataFrame:
    widely = (F.col("status") == SENT) & (F.col("relays_accepted") > 1)
    return states.withColumn("tick", delivery_tick(F.col("status"), F.col("relays_accepted"))).withColumn(
        "widely_stored", widely)


def connection_summary(relays: DataFrame, via_proxy: bool = False) -> DataFrame:
    """One row: connected and configured relays, offline flag and text."""
    # The texts of the connection line.
    proxy = " via Tor" if via_proxy else ""
    n = F.col("connected").cast("string")
    return relays.agg(
        F.count_if(F.col("status") == "connected").alias("connected"), F.count(F.lit(1)).alias("total")
    ).select(
        "connected", "total", (F.col("connected") == 0).alias("is_offline"),
        F.when(F.col("connected") == 0, F.lit(f"Connecting{proxy}…")).otherwise(
            F.concat(F.lit("Connected to "), n, F.lit(" of "), F.col("total").cast("string"), F.lit(f" relays{proxy}"))
        ).alias("text"),
    )


def relay_status(settings: DataFrame, live: DataFrame) -> DataFrame:
    """Configured relays (owner, relays array) with the state of their live connection, order kept.

    live: owner, url, state (connected, connecting, disconnected), last_error.
    """
    configured = settings.select("owner", F.posexplode("relays").alias("pos", "url"))
    # The texts of a relay's state.
    text = (
        F.when(F.col("state") == "connected", "● connected")
        .when(F.col("state") == "connecting", "○ connecting…")
        .otherwise(F.concat(F.lit("✕ "), F.coalesce("last_error", F.lit("offline"))))
    )
    return configured.join(live, ["owner", "url"], "left").select(
        "owner", "pos", "url", text.alias("status"), is_onion("url").alias("is_onion"),
        F.coalesce(F.col("state") == "connected", F.lit(False)).alias("is_connected"))


def classify_answers(frames: DataFrame) -> DataFrame:
    """Adds ``outcome`` to OK and CLOSED frames: accepted, refused, retried or error.

    frames: relay (one connection), seq, verb, key (event or subscription id), flag, text. A
    refusal that asks for authentication is retried once per key, if a challenge was sent
    before it. Both "before" tests are aggregates joined back, so that one busy connection is
    never sorted in one task.
    """
    challenges = frames.filter("verb = 'AUTH'").groupBy("relay").agg(F.min("seq").alias("challenged_at"))
    answers = frames.filter("verb in ('OK', 'CLOSED')").join(challenges, "relay", "left")
    asks = (
        (~F.coalesce("flag", F.lit(False))) & F.col("text").startswith(AUTH_REQUIRED)
        & F.coalesce(F.col("challenged_at") < F.col("seq"), F.lit(False))
    )
    marked = answers.withColumn("asks", asks).drop("challenged_at")
    first = marked.filter("asks").groupBy("relay", "verb", "key").agg(F.min("seq").alias("first_ask"))
    taken = F.coalesce("flag", F.lit(False)) | F.col("text").startswith(DUPLICATE)
    return marked.join(first, ["relay", "verb", "key"], "left").withColumn(
        "outcome",
        F.when(F.col("asks") & (F.col("seq") == F.col("first_ask")), "retried")
        .when(F.col("verb") == "CLOSED", "error")
        .when(taken, "accepted")
        .otherwise("refused"),
    ).drop("asks", "first_ask")


def auth_outcomes(frames: DataFrame) -> DataFrame:
    """Counts of each outcome per relay, and the share of answers that asked for authentication."""
    counted = classify_answers(frames).groupBy("relay").agg(
        *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("accepted", "refused", "retried", "error")],
        F.count(F.lit(1)).alias("n_answers"))
    return counted.withColumn("retry_rate", F.round(F.col("n_retried") / F.col("n_answers"), 6))
