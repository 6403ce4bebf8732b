"""Conversation list and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.functions.keys import avatar_bucket, display_name, initial
from whisperlake.functions.labels import day_label, day_of, time_label
from whisperlake.functions.text import is_blank, trimmed
from whisperlake.operators.delivery import delivery_tick
from whisperlake.operators.ordered import in_range_buckets, with_neighbour, with_running_sum
from whisperlake.schemas import FAILED, GROUP_GAP_SECONDS, RECEIVED


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a peer with many are ordered in ranges of about equal size."""
    return in_range_buckets(rows, ["peer"], "created_at", "id")


def last_message(messages: DataFrame) -> DataFrame:
    """Per peer the newest message; of several with the same time, the first stored (lowest ``seq``)."""
    payload = F.struct(*[c for c in messages.columns if c != "peer"])
    newest = F.max_by(payload, F.struct(F.col("created_at"), -F.col("seq")))
    return messages.groupBy("peer").agg(newest.alias("last"))


def unread_counts(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """Received messages per contact that are strictly newer than the last read time; contacts with none are absent."""
    received = messages.filter(F.col("status") == RECEIVED).select("peer", "created_at")
    read = contacts.select(F.col("pubkey").alias("peer"), "last_read_at")
    newer = received.join(read, "peer").filter(F.col("created_at") > F.col("last_read_at"))
    return newer.groupBy("peer").agg(F.count(F.lit(1)).alias("unread_count"))


def conversations(contacts: DataFrame, messages: DataFrame) -> DataFrame:
    """Every contact that is not blocked, with its last message (``last``, may be null) and unread count."""
    shown = contacts.filter(~F.col("is_blocked"))
    last = last_message(messages).withColumnRenamed("peer", "pubkey")
    unread = unread_counts(messages, shown).withColumnRenamed("peer", "pubkey")
    return (
        shown.join(last, "pubkey", "left")
        .join(unread, "pubkey", "left")
        .withColumn("unread_count", F.coalesce("unread_count", F.lit(0).cast("bigint")))
    )


def with_display_name(contacts: DataFrame) -> DataFrame:
    return contacts.withColumn("display_name", display_name("name", "pubkey"))


def chat_list(contacts: DataFrame, messages: DataFrame, now: int | Column, ordered: bool = True) -> DataFrame:
    """The rows of the conversation list, newest first, then by name."""
    now = F.lit(now).cast("bigint") if isinstance(now, int) else now
    df = with_display_name(conversations(contacts, messages))
    last = lambda field: F.col(f"last.{field}")
    outgoing = last("status") != RECEIVED
    stored = last("relays_accepted") if "relays_accepted" in messages.columns else F.lit(0)
    rows = df.select(
        "pubkey", F.col("display_name").alias("title"), initial("name").alias("initial"),
        (~is_blank("name")).alias("has_name"), avatar_bucket("pubkey").alias("bucket"),
        F.coalesce(
            F.regexp_replace(last("text"), r"\r\n|[\r\n\x0c\x{85}\x{2028}\x{2029}]", " "),
            # The texts shown for a chat without messages.
            F.when(F.col("is_request"), "Message request").otherwise("Tap to start chatting"),
        ).alias("preview"),
        F.coalesce(time_label(last("created_at"), now), F.lit("")).alias("time"),
        F.coalesce(last("created_at"), F.lit(0).cast("bigint")).alias("last_at"),
        "unread_count",
        F.when(F.col("unread_count") > 99, "99+").otherwise(F.col("unread_count").cast("string")).alias("badge"),
        "is_request",
        F.when(outgoing, delivery_tick(last("status"), stored)).otherwise("").alias("tick"),
        F.coalesce(last("status") == FAILED, F.lit(False)).alias("is_failed"),
        last("text").alias("last_text"),
    )
    if not ordered:
        return rows
    return rows.orderBy(F.col("last_at").desc(), F.lower("title"), "pubkey")


def chat_list_filter(rows: DataFrame, mode: str = "all", search: str = "") -> DataFrame:
    """Tabs ``all``, ``unread`` and ``requests`` plus a case-insensitive search in name or last text."""
    keep = {"all": F.lit(True), "unread": F.col("unread_count") > 0, "requests": F.col("is_request")}[mode]
    wanted = F.lower(trimmed(F.lit(search)))
    found = F.lower("title").contains(wanted) | F.coalesce(F.lower("last_text").contains(wanted), F.lit(False))
    return rows.filter(keep & ((wanted == "") | found))


def contacts_sorted(contacts: DataFrame) -> DataFrame:
    return with_display_name(contacts).orderBy(F.lower("display_name"), "pubkey")


def blocked_contacts(contacts: DataFrame) -> DataFrame:
    return contacts_sorted(contacts.filter("is_blocked"))


def timeline(messages: DataFrame, peer: str | None = None, gap: int = GROUP_GAP_SECONDS) -> DataFrame:
    """Marks where days and groups start, per peer in (created_at, id) order.

    A group ends on a new day, a change of direction, or a pause longer than ``gap`` seconds.
    """
    rows = messages if peer is None else messages.filter(F.col("peer") == peer)
    return _marked(rows, gap).drop("_bucket")


def _marked(rows: DataFrame, gap: int) -> DataFrame:
    rows = _dealt(rows.withColumn("is_outgoing", F.col("status") != RECEIVED))
    near = with_neighbour(rows, ["peer"], ["created_at", "id"], ["created_at", "is_outgoing"], prefix="prev_")
    first = F.col("prev_created_at").isNull()
    new_day = first | (day_of("created_at") != day_of("prev_created_at"))
    pause = F.col("created_at") - F.col("prev_created_at") > gap
    return (
        near.withColumn("new_day", new_day)
        .withColumn("starts_group", F.col("new_day") | (F.col("is_outgoing") != F.col("prev_is_outgoing")) | pause)
        .drop("prev_created_at", "prev_is_outgoing")
    )


def _numbered(marked: DataFrame) -> DataFrame:
    return with_running_sum(marked, ["peer"], ["created_at", "id"], F.col("starts_group"), "group_no")


def with_group_numbers(marked: DataFrame) -> DataFrame:
    """Numbers the groups of a :func:`timeline` from 1 per peer."""
    return _numbered(_dealt(marked)).drop("_bucket")


def message_groups(messages: DataFrame, gap: int = GROUP_GAP_SECONDS) -> DataFrame:
    """One row per group: its size, time span and direction."""
    # Only what the groups need is dealt out, and once for both steps.
    numbered = _numbered(_marked(messages.select("peer", "id", "created_at", "status"), gap))
    return numbered.groupBy("peer", "group_no").agg(
        F.count(F.lit(1)).alias("n_messages"), F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"), F.bool_or("is_outgoing").alias("is_outgoing"),
        F.bool_or("new_day").alias("opens_day"),
    )


def timeline_rows(marked: DataFrame, now: int) -> DataFrame:
    """Message rows with a date row in front of the first message of each day (``row_type`` 0 = date)."""
    dates = marked.filter("new_day").select(
        "peer", "created_at", "id", F.lit(0).alias("row_type"),
        day_label("created_at", F.lit(now).cast("bigint")).alias("label"))
    rows = marked.select("peer", "created_at", "id", F.lit(1).alias("row_type"), F.col("text").alias("label"))
    return dates.unionByName(rows)


def rebuild_on_late(stored: DataFrame, late: DataFrame, gap: int = GROUP_GAP_SECONDS) -> DataFrame:
    """Timelines of the peers that a late batch touches, as if everything had been sorted from the start."""
    touched = late.select("peer").distinct()
    news = late.join(stored.select("id"), "id", "left_anti").select(*stored.columns)
    return timeline(stored.join(touched, "peer", "left_semi").unionByName(news.select(*stored.columns)), gap=gap)
