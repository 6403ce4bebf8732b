"""Contacts: imports, inbox relay lookup, and the fold of the contact change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.functions.events import tag_values
from whisperlake.functions.keys import npub, parse_public_key
from whisperlake.functions.text import is_blank, staged, trimmed
from whisperlake.functions.urls import RELAY_SCHEMES, relay_url_list
from whisperlake.schemas import INBOX_CACHE_SECONDS, INBOX_RELAY_COUNT, KIND_INBOX_LIST

# Operations that make a contact exist, and those that only change one that does.
CREATING = ("upsert", "add", "block", "ensure")
CHANGING = ("unblock", "mark_read")


def import_contacts(raw: DataFrame, me: str | Column) -> tuple[DataFrame, DataFrame]:
    """Parses a list of key texts (``raw``): (accepted: pubkey, npub), (rejected: raw, reason)."""
    me = F.lit(me) if isinstance(me, str) else me
    parsed = staged(raw, raw.columns, [parse_public_key("raw").alias("pubkey")]).withColumn(
        "reason", F.when(F.col("pubkey").isNull(), "invalid key").when(F.col("pubkey") == me, "own key"))
    accepted = parsed.filter("reason is null").select("pubkey").distinct().withColumn("npub", npub("pubkey"))
    return accepted, parsed.filter("reason is not null").select("raw", "reason")


def parse_inbox_list(tags: str | Column = "tags") -> Column:
    """Relay urls of an inbox list event: valid, normal form, distinct, order kept."""
    return relay_url_list(tag_values(tags, "relay"), RELAY_SCHEMES)


def latest_inbox_list(copies: DataFrame) -> DataFrame:
    """Per author the newest inbox list that is not empty.

    ``copies`` are events with ``relay``. Every relay is asked for one event only, so just the
    newest list per (author, relay) counts: an empty one hides that relay's older lists.
    """
    rank = F.struct((-F.col("created_at")).alias("age"), "id")
    per_relay = (
        copies.filter(F.col("kind") == KIND_INBOX_LIST)
        .groupBy("pubkey", "relay")
        .agg(F.min(F.struct(rank.alias("rank"), "tags")).alias("newest"))
        .select("pubkey", "newest.rank", parse_inbox_list(F.col("newest.tags")).alias("relays"))
    )
    return (
        per_relay.filter(F.size("relays") > 0)
        .groupBy("pubkey")
        .agg(F.min(F.struct("rank", "relays")).alias("best"))
        .select("pubkey", F.col("best.relays").alias("relays"), (-F.col("best.rank.age")).alias("listed_at"))
    )


def resolve_inbox_relays(
    contacts: DataFrame, lists: DataFrame, own_relays: Column, now: int, cache_seconds: int = INBOX_CACHE_SECONDS
) -> DataFrame:
    """Where to deliver to each contact: fresh cache, latest list, stale cache, own relays, in this order."""
    cached = F.when(F.size("inbox_relays") > 0, F.col("inbox_relays"))
    fresh = F.when(F.lit(now) - F.col("fetched_at") < cache_seconds, cached)
    found = lists.select("pubkey", F.col("relays").alias("listed"))
    return contacts.join(found, "pubkey", "left").select(
        "pubkey", F.coalesce(fresh, F.col("listed"), cached, own_relays).alias("relays"),
        F.when(fresh.isNotNull(), "cache").when(F.col("listed").isNotNull(), "list")
        .when(cached.isNotNull(), "stale cache").otherwise("own").alias("source"),
    )


def top_n_list(urls: str | Column, n: int = INBOX_RELAY_COUNT) -> Column:
    """The first ``n`` configured relays."""
    return F.slice(urls, 1, n)


def apply_contact_changes(state: DataFrame, log: DataFrame, me: str | Column | None = None) -> DataFrame:
    """Folds an ordered change log into the contact table.

    state: pubkey, name, is_request, is_blocked, last_read_at
    log: seq (>= 0), pubkey, op, name, is_request, is_blocked, last_read_at. Ops: upsert (all fields),
    add (blank name keeps the old one, clears the request flag), block, unblock, mark_read, ensure
    (only if missing; its request flag counts then), remove.

    Every field is "the last operation that sets it", so the fold is a plain aggregation with
    partial results per task; no key is ever sorted or walked in one place.
    """
    rows = ["seq", "pubkey", "op", "name", "is_request", "is_blocked", "last_read_at"]
    stored = state.select(F.lit(-1).cast("bigint").alias("seq"), F.lit("upsert").alias("op"), *[
        c for c in rows if c not in ("seq", "op")])
    ops = stored.unionByName(log.select(*rows))
    if me is not None:
        me = F.lit(me) if isinstance(me, str) else me
        ops = ops.filter(~((F.col("op") == "add") & (F.col("pubkey") == me)))
    # What happened up to the last removal of a contact no longer counts.
    removed = ops.filter("op = 'remove'").groupBy("pubkey").agg(F.max("seq").alias("removed_at"))
    live = ops.filter("op <> 'remove'").join(removed, "pubkey", "left").filter(
        F.col("seq") > F.coalesce("removed_at", F.lit(-2)))

    op = F.col("op")
    is_add_name = (op == "add") & ~is_blank("name")

    def last_where(condition: Column, value: Column) -> Column:
        return F.max_by(F.when(condition, value), F.when(condition, F.col("seq")))

    def last_flag(condition: Column, value: Column) -> Column:
        # Booleans as numbers keep the buffers fixed-width, hence a hash aggregation.
        return last_where(condition, value.cast("int"))

    folded = live.groupBy("pubkey").agg(
        F.min(F.when(op.isin(*CREATING), F.col("seq"))).alias("created_seq"),
        last_flag(op.isin("upsert", "add", "block"), F.when(op == "upsert", F.col("is_request")).otherwise(False)).alias("request"),
        F.min_by(F.when(op == "ensure", F.col("is_request").cast("int")),
                 F.when(op == "ensure", F.col("seq"))).alias("ensured_request"),
        last_flag(op.isin("upsert", "block", "unblock"),
                  F.when(op == "upsert", F.col("is_blocked")).otherwise(op == "block")).alias("blocked"),
        F.max(F.when(op.isin("upsert", "mark_read"), F.col("seq"))).alias("read_seq"),
        last_where(op.isin("upsert", "mark_read"), F.col("last_read_at")).alias("read_at"),
        F.max(F.when((op == "upsert") | is_add_name, F.struct("seq", trimmed_add_name().alias("name")))).alias("named"),
    )
    return folded.filter("created_seq is not null").select(
        "pubkey", F.col("named.name").alias("name"),
        F.coalesce("request", "ensured_request", F.lit(0)).cast("boolean").alias("is_request"),
        F.coalesce("blocked", F.lit(0)).cast("boolean").alias("is_blocked"),
        # Reading marks before the contact existed had no effect.
        F.when(F.col("read_seq") >= F.col("created_seq"), F.col("read_at")).otherwise(0).alias("last_read_at"),
    )


def trimmed_add_name() -> Column:
    """``add`` trims the name, ``upsert`` stores it as it is."""
    return F.when(F.col("op") == "add", trimmed("name")).otherwise(F.col("name"))
