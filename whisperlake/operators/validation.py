"""Checks on events that came from untrusted sources and on messages about to be sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.functions.events import event_json, has_valid_id
from whisperlake.functions.padding import payload_text_length
from whisperlake.functions.text import is_lower_hex, trimmed
from whisperlake.operators.attachments import attachment_from_event
from whisperlake.operators.filters import EventFilter, any_matches, row_matches
from whisperlake.schemas import FAILED, KIND_CHAT, KIND_FILE, MAX_ATTACHMENT_BYTES, MAX_PLAINTEXT_BYTES


def valid_event_ids(events: DataFrame) -> DataFrame:
    return events.filter(has_valid_id())


def _first_failing(known: Column, asked: Column) -> Column:
    signed = is_lower_hex("sig", 64) & F.coalesce(F.col("sig_ok"), F.lit(False))
    return (
        F.when(~known, "unknown subscription")
        .when(~F.coalesce(asked, F.lit(False)), "not asked for")
        .when(~has_valid_id(), "bad id")
        .when(~signed, "bad signature")
    )


def refusal_reason(subscriptions: dict[str, list[EventFilter]]) -> Column:
    """Why an event is not accepted (null = accepted), cheapest test first.

    Needs ``sub_id`` and the signature verdict ``sig_ok`` as input columns.
    """
    asked = F.lit(False)
    for sub_id, filters in subscriptions.items():
        asked = asked | ((F.col("sub_id") == sub_id) & any_matches(filters))
    known = F.coalesce(F.col("sub_id").isin(list(subscriptions)), F.lit(False))
    return _first_failing(known, asked)


def accept_events(events: DataFrame, subscriptions: dict[str, list[EventFilter]] | DataFrame) -> DataFrame:
    """Adds ``reason``: null for events to keep, else the first failing test.

    ``subscriptions`` are a few filters by sub_id, or a table of any size with one row for each filter (sub_id, ids, authors, kinds, tags, since, until; null:
    no constraint). An event names its subscription, so it meets that one's filters only: they are gathered in one row, which the join
    with the events, on sub_id, brings to each of them; a hot subscription's events can be split.
    """
    if isinstance(subscriptions, dict):
        return events.withColumn("reason", refusal_reason(subscriptions))
    parts = ["ids", "authors", "kinds", "tags", "since", "until"]
    # A subscription has few filters: what one request can hold.
    listed = subscriptions.filter("sub_id is not null").groupBy(F.col("sub_id").alias("_sub")).agg(F.collect_list(F.struct(*parts)).alias("_filters"))
    met = events.join(listed, events["sub_id"] == listed["_sub"], "left")
    asked = F.exists("_filters", lambda f: F.coalesce(row_matches(lambda part: f[part]), F.lit(False)))
    return met.withColumn("reason", _first_failing(F.col("_sub").isNotNull(), asked)).drop("_sub", "_filters")


def chat_payloads(rumors: DataFrame) -> DataFrame:
    """Non-empty texts and readable file messages; adds ``attachment`` (null for texts)."""
    withfile = rumors.withColumn("attachment", attachment_from_event())
    is_text = (F.col("kind") == KIND_CHAT) & (F.length("content") > 0)
    return withfile.filter(is_text | ((F.col("kind") == KIND_FILE) & F.col("attachment").isNotNull()))


def sealed_json_length(rumor_bytes: Column) -> Column:
    """Bytes of the signed seal that carries a rumor of this size: fixed fields around the payload text."""
    fixed = len('{"id":"","pubkey":"","created_at":,"kind":13,"tags":[],"content":"","sig":""}') + 64 + 64 + 10 + 128
    return payload_text_length(rumor_bytes) + F.lit(fixed)


def validate_outgoing(drafts: DataFrame, contacts: DataFrame) -> DataFrame:
    """Adds the trimmed text, both layer sizes and ``reason`` (null = may be sent).

    ``drafts`` are unsigned events (id, pubkey, created_at, kind, tags, content) plus
    ``peer``; the size limit applies to each serialised layer, not to the text.
    """
    blocked = contacts.filter("is_blocked").select(F.col("pubkey").alias("peer"), F.lit(True).alias("peer_blocked"))
    sized = (
        drafts.withColumn("content", trimmed("content"))
        .withColumn("rumor_bytes", F.octet_length(event_json(sig=False)).cast("bigint"))
        .withColumn("seal_bytes", sealed_json_length(F.col("rumor_bytes")))
    )
    too_long = (F.col("rumor_bytes") > MAX_PLAINTEXT_BYTES) | (F.col("seal_bytes") > MAX_PLAINTEXT_BYTES)
    return sized.join(blocked, "peer", "left").withColumn(
        "reason",
        F.when(F.col("content") == "", "empty")
        .when(F.coalesce(F.col("peer_blocked"), F.lit(False)), "blocked")
        .when(too_long, "too long"),
    ).drop("peer_blocked")


def validate_files(files: DataFrame, contacts: DataFrame) -> DataFrame:
    """Adds ``reason`` to files (``peer``, ``n_bytes``) about to be sent."""
    blocked = contacts.filter("is_blocked").select(F.col("pubkey").alias("peer"), F.lit(True).alias("peer_blocked"))
    return files.join(blocked, "peer", "left").withColumn(
        "reason",
        F.when(F.col("n_bytes") == 0, "empty")
        .when(F.col("n_bytes") > MAX_ATTACHMENT_BYTES, "too large")
        .when(F.coalesce(F.col("peer_blocked"), F.lit(False)), "blocked"),
    ).drop("peer_blocked")


def failed_messages(messages: DataFrame) -> DataFrame:
    """Retry queue: files never uploaded go through upload again, the rest is published under the same id."""
    url = F.col("attachment.url")
    return messages.filter(F.col("status") == FAILED).withColumn(
        "retry", F.when(url.isNotNull() & (url == ""), "upload").otherwise("publish")
    )
