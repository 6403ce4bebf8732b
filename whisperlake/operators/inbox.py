"""The receive path: layered authentication, block log, fold into messages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.functions.events import first_tag, has_valid_id, participants
from whisperlake.functions.media import attachment_label
from whisperlake.functions.text import as_col, packed, unpacked
from whisperlake.operators.ordered import in_buckets, with_last, with_neighbour
from whisperlake.operators.validation import chat_payloads
from whisperlake.schemas import KIND_GIFT_WRAP, KIND_SEAL, RECEIVED, SENT

_LOG_BUCKET_SECONDS = 30 * 86_400
# Changes of one key's block state that messages are compared with one by one.
MOST_CHANGES = 64


def authenticate_layers(wraps: DataFrame, seals: DataFrame, rumors: DataFrame) -> DataFrame:
    """Joins opened layers to their wraps; one row per wrap with the rumor or the first failing ``reason``.

    wraps: id, kind, wrap_ok, seal_id (other columns pass through as they are)
    seals: id, kind, pubkey, n_tags, seal_ok
    rumors: seal_id, id, pubkey, created_at, kind, tags, content (must be unsigned)
    """
    inner = seals.select(
        F.col("id").alias("seal_id"), F.col("kind").alias("seal_kind"), F.col("pubkey").alias("seal_pubkey"),
        F.col("n_tags").alias("seal_tags"), "seal_ok", F.lit(True).alias("has_seal"),
    )
    # The id is checked where the rumor is stored, so hashing happens once and in parallel.
    letters = rumors.withColumn("rumor_ok", has_valid_id()).select(
        "seal_id", F.struct("id", "pubkey", "created_at", "kind", "tags", "content").alias("rumor"), "rumor_ok",
    )
    joined = (
        wraps.withColumnsRenamed({"id": "wrap_id", "kind": "wrap_kind", "pubkey": "wrap_pubkey"})
        .join(inner, "seal_id", "left")
        .join(letters, "seal_id", "left")
    )
    reason = (
        F.when(F.col("wrap_kind") != KIND_GIFT_WRAP, "not a gift wrap")
        .when(~F.coalesce("wrap_ok", F.lit(False)), "bad wrap signature")
        .when(F.col("has_seal").isNull(), "cannot open wrap")
        .when((F.col("seal_kind") != KIND_SEAL) | (F.col("seal_tags") != 0), "not a seal")
        .when(~F.coalesce("seal_ok", F.lit(False)), "bad seal signature")
        .when(F.col("rumor").isNull(), "cannot open seal")
        .when(F.col("rumor.pubkey") != F.col("seal_pubkey"), "impersonation")
        .when(~F.col("rumor_ok"), "bad rumor id")
    )
    return joined.withColumn("reason", reason).select(
        *[c for c in joined.columns if c.startswith("wrap_") or c in ("owner", "arrival")],
        "reason", F.when(F.col("reason").isNull(), F.col("rumor")).alias("rumor"),
    )


def authentic_rumors(wraps: DataFrame, seals: DataFrame, rumors: DataFrame) -> DataFrame:
    """The rows of :func:`authenticate_layers` without a failing ``reason``.

    Each layer is tested where it is stored, so that only what passes is shuffled, with ids and keys in half the bytes.
    """
    passes = lambda fails: ~F.coalesce(fails, F.lit(False))
    outer = wraps.filter(passes(F.col("kind") != KIND_GIFT_WRAP) & F.coalesce("wrap_ok", F.lit(False)))
    inner = seals.filter(passes((F.col("kind") != KIND_SEAL) | (F.col("n_tags") != 0)) & F.coalesce("seal_ok", F.lit(False))).select(
        packed("id").alias("seal_id"), packed("pubkey").alias("seal_pubkey"))
    letters = rumors.filter(passes(~has_valid_id())).select(
        packed("seal_id").alias("seal_id"), packed("id").alias("id"), packed("pubkey").alias("pubkey"), "created_at", "kind", "tags", "content")
    sealed = inner.join(letters, "seal_id").filter(passes(F.col("pubkey") != F.col("seal_pubkey"))).select("seal_id", F.struct(
        "id", "pubkey", "created_at", "kind", "tags", "content").alias("rumor"))
    named = outer.withColumnsRenamed({"id": "wrap_id", "kind": "wrap_kind", "pubkey": "wrap_pubkey"})
    kept = [c for c in named.columns if c.startswith("wrap_") or c in ("owner", "arrival")]
    names = [c for c in ("wrap_id", "wrap_pubkey", "owner") if c in kept]
    found = named.select(*kept, "seal_id").withColumns({c: packed(c) for c in (*names, "seal_id")}).join(sealed, "seal_id")
    rumor = F.struct(unpacked("rumor.id").alias("id"), unpacked("rumor.pubkey").alias("pubkey"), *(F.col(f"rumor.{c}") for c in ("created_at", "kind", "tags", "content")))
    return found.select(*(unpacked(c).alias(c) if c in names else c for c in kept), rumor.alias("rumor"))


def block_intervals(block_log: DataFrame, keys: list[str]) -> DataFrame:
    """Blocked stretches [blocked_from, blocked_until) per key; the last one may be open (null end)."""
    log = block_log.groupBy(*keys, "changed_at").agg(F.bool_or("blocked").alias("blocked"))
    log = in_buckets(log, F.floor(F.col("changed_at") / _LOG_BUCKET_SECONDS))
    spans = with_neighbour(log, keys, ["changed_at"], ["changed_at"], prefix="next_", following=True)
    return spans.filter("blocked").select(
        *keys, F.col("changed_at").alias("blocked_from"), F.col("next_changed_at").alias("blocked_until"))


def drop_blocked(
    messages: DataFrame, block_log: DataFrame, arrival: str | Column = "created_at", keys: tuple[str, ...] | None = None
) -> DataFrame:
    """Drops incoming messages that arrived while their author was blocked.

    What arrives while blocked stays lost after unblocking, so this looks at the log, not at
    today's flag. Outgoing messages are never dropped. Where messages have an ``owner``, a block
    is that owner's alone, and the log must name the owner too; ``keys`` overrides this.

    A message is compared with the blocked stretches of its key. Keys with more than ``MOST_CHANGES`` changes, of which the log is asked first, go through one
    ordered pass over changes and messages instead, so that no message meets more than half as many stretches.
    """
    keys = list(keys or (("owner", "peer") if "owner" in messages.columns else ("peer",)))
    at = as_col(arrival)
    restless = block_log.groupBy(*keys).agg(F.countDistinct("changed_at").alias("n")).filter(F.col("n") > MOST_CHANGES).select(*keys)
    if restless.isEmpty():
        return _outside(messages, block_intervals(block_log, keys), at, keys)
    calm = _outside(messages.join(restless, keys, "left_anti"), block_intervals(block_log.join(restless, keys, "left_anti"), keys), at, keys)
    swept = _swept(messages.join(restless, keys, "left_semi"), block_log.join(restless, keys, "left_semi"), at, keys)
    return calm.select(messages.columns).unionByName(swept.select(messages.columns))


def _outside(messages: DataFrame, spans: DataFrame, at: Column, keys: list[str]) -> DataFrame:
    """Messages without those received within one of the stretches of their key."""
    spans = spans.withColumnsRenamed({k: f"b_{k}" for k in keys})
    hit = (F.col("status") == RECEIVED) & (at >= F.col("blocked_from")) & (
        F.col("blocked_until").isNull() | (at < F.col("blocked_until")))
    for k in keys:
        hit = (F.col(k) == F.col(f"b_{k}")) & hit
    return messages.join(spans, hit, "left_anti")


def _swept(messages: DataFrame, block_log: DataFrame, at: Column, keys: list[str]) -> DataFrame:
    """The same by order: the last change at or before a message's time says whether it is lost."""
    log = block_log.groupBy(*keys, "changed_at").agg(F.bool_or("blocked").alias("_blocked"))
    row = F.struct(*messages.columns).alias("_row")
    both = messages.select(*keys, at.alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("boolean").alias("_blocked"), row).unionByName(
        log.select(*keys, F.col("changed_at").alias("_at"), F.lit(0).alias("_kind"), "_blocked"), allowMissingColumns=True)
    state = with_last(in_buckets(both, F.floor(F.col("_at") / 3600)), keys, ["_at", "_kind"], "_blocked", "_state")
    lost = (F.col("_row.status") == RECEIVED) & F.coalesce("_state", F.lit(False))
    return state.filter((F.col("_kind") == 1) & ~F.coalesce(lost, F.lit(False))).select("_row.*")


def drop_blocked_now(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """Snapshot form: drops incoming messages of contacts that are blocked today."""
    blocked = contacts.filter("is_blocked").select(F.col("pubkey").alias("b_peer"))
    hit = (F.col("peer") == F.col("b_peer")) & (F.col("status") == RECEIVED)
    return messages.join(blocked, hit, "left_anti")


def rumors_to_messages(rumors: DataFrame, me: str | Column = "owner") -> DataFrame:
    """Message rows of authenticated rumors (``rumor`` struct); self-only ones have no peer and vanish."""
    me = as_col(me)
    flat = rumors.select(*[c for c in rumors.columns if c != "rumor"], "rumor.*")
    outgoing = F.col("pubkey") == me
    peer = F.when(outgoing, F.get(participants("tags", "pubkey", me), F.lit(0))).otherwise(F.col("pubkey"))
    return chat_payloads(flat).withColumn("peer", peer).filter("peer is not null").select(
        *[c for c in ("owner", "arrival", "wrap_id") if c in flat.columns],
        "id", "peer", F.col("pubkey").alias("author"),
        F.when(F.col("attachment").isNull(), F.col("content"))
        .otherwise(attachment_label(F.col("attachment.mime"))).alias("text"),
        "created_at", F.when(outgoing, SENT).otherwise(RECEIVED).alias("status"),
        first_tag("tags", "e").alias("reply_to"), "attachment",
    )


class Fold(NamedTuple):
    """What a batch of wraps comes to: new ``messages``, all wraps ``handled`` (owner, id), opened or not, and the ``contacts`` that must exist."""

    messages: DataFrame
    handled: DataFrame
    contacts: DataFrame


# What the fold reads of a wrap; anything else would only be shuffled along.
_WRAP = ["owner", "id", "arrival", "kind", "wrap_ok", "seal_id"]


def first_arrivals(wraps: DataFrame) -> DataFrame:
    """The earliest copy of each wrap in each inbox: later copies are never looked at."""
    rest = [c for c in wraps.columns if c not in ("owner", "id", "arrival")]
    first = F.min(F.struct("arrival", *rest))
    return wraps.groupBy("owner", "id").agg(first.alias("w")).select(*[c if c in ("owner", "id") else f"w.{c}" for c in wraps.columns])


def unseen(wraps: DataFrame, *processed: DataFrame) -> DataFrame:
    """First copies of the wraps that none of the tables ``processed`` has (id, and owner where ids are kept per owner)."""
    names = ("owner", "id", "seal_id")
    new = first_arrivals(wraps.select(*(packed(c).alias(c) if c in names else c for c in _WRAP)))
    for p in sorted(processed, key=lambda p: "owner" not in p.columns):
        known = ["owner", "id"] if "owner" in p.columns else ["id"]
        new = new.join(p.select(*(packed(c).alias(c) for c in known)), known, "left_anti").select(*_WRAP)
    return new.select(*(unpacked(c).alias(c) if c in names else c for c in _WRAP))


def received(new: DataFrame, seals: DataFrame, rumors: DataFrame, block_log: DataFrame, block_keys: tuple[str, ...] | None = None) -> DataFrame:
    """The messages that wraps bring, with ``arrival`` and ``wrap_id``, without those that came while their author was blocked."""
    # Other rumors bring no message, so they aren't hashed.
    letters = chat_payloads(rumors).select(rumors.columns)
    return drop_blocked(rumors_to_messages(authentic_rumors(new, seals, letters)), block_log, "arrival", block_keys)


def new_messages(kept: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row for each (owner, id) of the rows of :func:`received` that is not ``stored``: the one that arrived first."""
    if stored is not None:
        kept = kept.join(stored.select("owner", "id"), ["owner", "id"], "left_anti").select(kept.columns)
    first = F.min_by(F.struct(*kept.columns), F.struct("arrival", "wrap_id"))
    return kept.groupBy("owner", "id").agg(first.alias("m")).select("m.*")


def fold_inbox(
    wraps: DataFrame, seals: DataFrame, rumors: DataFrame, processed: DataFrame, block_log: DataFrame,
    stored: DataFrame | None = None, block_keys: tuple[str, ...] | None = None,
) -> Fold:
    """New messages of many inboxes: one row per (owner, id), the earliest arrival kept.

    wraps also carry ``owner`` (whose inbox) and ``arrival``. A wrap counts as handled before anything
    else happens to it, so what its first copy came to (refused, or lost while the author was blocked)
    is final. ``processed`` has id, and owner where ids are kept per owner. ``stored`` (owner, id)
    are messages that exist; they are not added again, but imply their contacts (:func:`implied_contacts`) like any other.
    """
    new = unseen(wraps, processed)
    kept = received(new, seals, rumors, block_log, block_keys)
    return Fold(new_messages(kept, stored), new.select("owner", "id"), implied_contacts(kept))


def implied_contacts(messages: DataFrame) -> DataFrame:
    """Contacts a batch of messages creates when missing: a request if the other side wrote first."""
    first = F.struct("arrival", "id", (F.col("status") == RECEIVED).alias("is_request"))
    return messages.groupBy("owner", F.col("peer").alias("pubkey")).agg(F.min(first).alias("f")).select(
        "owner", "pubkey", F.col("f.is_request").alias("is_request"))
