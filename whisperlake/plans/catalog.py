"""Every operator as a query over the test tables: name -> function of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from whisperlake.functions import keys, labels, media, padding, text, urls
from whisperlake.functions.events import event_id, first_tag, participants, tag_values
from whisperlake.operators import (
    attachments, audit, build, contacts, conversations, delivery, filters, inbox, merge, messages, validation,
)
from whisperlake.operators.filters import EventFilter
from whisperlake.plans import views as v
from whisperlake.sources import blobs, feed, frames, snapshot
from whisperlake.session import configure_session, work_dir
from whisperlake.streaming import dedup
from whisperlake.streaming import delivery as stream_delivery
from whisperlake.streaming import inbox as stream_inbox
from whisperlake.streaming import messages as stream_messages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(configure_session(spark), sf)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn

    return register


def joined(c: str | Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)


# --- sources and sinks -------------------------------------------------------------------


@query("s1_parse_frames")
def _(spark, sf):
    t = frames.typed_frames(v.frames(spark, sf), keep=["event_id"])
    return t.select(
        "event_id", F.coalesce("verb", F.lit("")).alias("verb"), "sub_id", F.col("event.id").alias("id"), "message_id",
        "ack_ok", "ack_text", "text", "problem")


@query("s2_parse_events")
def _(spark, sf):
    e = frames.read_events(v.event_texts(spark, sf), keep=["event_id"]).select("event_id", "event.*")
    return e.select("event_id", "id", "created_at", "kind", text.tags_json("tags").alias("tags"), "content", "sig")


@query("s3_events_to_json")
def _(spark, sf):
    e = v.events(spark, sf).withColumn("sig", F.when(F.col("event_id") % 2 == 0, F.concat("id", "id")))
    return frames.events_to_json(e, keep=["event_id"])


@query("s4_read_snapshot")
def _(spark, sf):
    """Customers' settings and contact sections as snapshot files, with missing and empty parts, read back."""
    c = v.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = F.col("c_custkey")
    contact = F.create_map(v.H(n + 1), F.struct(F.col("c_name").alias("Name"), (n % 3 == 0).alias("IsBlocked")))
    settings = (
        F.when(n % 4 == 0, F.lit(None)).when(n % 4 == 1, F.struct(
            F.array(F.lit("wss://relay.example")).alias("Relays"), F.lit(None).cast("array<string>").alias("MediaServers")))
        .when(n % 4 == 2, F.struct(F.array().cast("array<string>").alias("Relays"),
                                   F.array(F.lit("https://m.example")).alias("MediaServers"))))
    files = c.select("c_nationkey", F.to_json(F.struct(
        F.when(n % 2 == 0, contact).alias("Contacts"), F.when(n % 5 == 0, n).alias("LastSyncAt"),
        settings.alias("Settings"))).alias("value"))
    path = work_dir(spark, "snapshots")
    # One object per line here; each line is one owner's snapshot.
    files.write.partitionBy("c_nationkey").text(path)
    t = snapshot.snapshot_tables(snapshot.read_snapshot_lines(spark, path))
    per = lambda df, kind, key: df.select(F.lit(kind).alias("part"), key.alias("value"))
    rows = (
        per(t["contacts"], "contact", F.concat_ws("|", "pubkey", "name", F.col("is_blocked").cast("string")))
        .unionByName(per(t["settings"], "settings", F.concat_ws("|", joined("relays", ","), joined("media_servers", ","))))
        .unionByName(per(t["last_sync"], "last sync", F.col("last_sync_at").cast("string")))
    )
    return rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))


@query("s4_snapshot_files")
def _(spark, sf):
    """A thousand customers at a time as one stored history, with all five sections: as many files as the table calls for, none large."""
    c = v.table(spark, sf, "customer").select("c_custkey", "c_name", F.floor(F.col("c_custkey") / 1000).alias("history"))
    n, k = F.col("c_custkey"), F.col("history")
    contact = F.struct(F.col("c_name").alias("Name"), (n % 3 == 0).alias("IsBlocked"))
    message = F.struct(
        F.concat(F.lit("m"), n.cast("string")).alias("Id"), v.H(n).alias("PeerPubKey"), F.col("c_name").alias("Text"),
        (v.EPOCH + n).alias("CreatedAt"), F.lit("Received").alias("Status"))
    per = c.groupBy("history").agg(
        F.map_from_entries(F.collect_list(F.struct(v.H(n), contact))).alias("Contacts"), F.collect_list(message).alias("Messages"),
        F.collect_list(F.when(n % 7 == 0, v.H(n + 1))).alias("ProcessedWrapIds"))
    settings = F.when(k % 2 == 0, F.struct(F.array(F.lit("wss://relay.example")).alias("Relays")))
    files = per.select("history", F.to_json(F.struct(
        "Contacts", "Messages", "ProcessedWrapIds", F.when(k % 3 == 0, k).alias("LastSyncAt"), settings.alias("Settings"))).alias("value"))
    path = work_dir(spark, "histories")
    files.write.partitionBy("history").text(path)
    t = snapshot.read_snapshot(spark, path)
    row = lambda part, *values: t[part].select(
        F.lit(part).alias("part"), F.concat_ws("|", *values).alias("value"))
    rows = row("contacts", "pubkey", "name", F.col("is_blocked").cast("string")).unionByName(
        row("messages", "id", "peer", "text", F.col("created_at").cast("string"))).unionByName(row("processed", "id")).unionByName(
        row("settings", joined("relays", ","), joined("media_servers", ","))).unionByName(
        row("last_sync", F.col("last_sync_at").cast("string")))
    return rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))


@query("s5_snapshot_round_trip")
def _(spark, sf):
    path = work_dir(spark, "store")
    tables = {"contacts": v.contacts(spark, sf), "messages": v.messages(spark, sf)}
    snapshot.write_snapshot(spark, {"contacts": tables["contacts"].limit(0)}, path)
    snapshot.write_snapshot(spark, tables, path)
    back = snapshot.load_snapshot(spark, path)
    m = back["messages"].select(F.lit("message").alias("part"), F.col("id").alias("key"), F.col("created_at").alias("at"))
    return m.unionByName(back["contacts"].select(
        F.lit("contact").alias("part"), F.col("pubkey").alias("key"), F.col("last_read_at").alias("at")))


@query("s6_address_blobs")
def _(spark, sf):
    stored = attachments.address_blobs(v.blobs(spark, sf))
    return stored.select("url", "sha256", F.octet_length("content").cast("bigint").alias("length"))


@query("s6_read_blobs")
def _(spark, sf):
    """Benchmark items as files, one each, read back as blobs."""
    path = work_dir(spark, "blob-files")
    v.table(spark, sf, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    stored = blobs.read_blobs(spark, path, "*.txt")
    return stored.select(F.regexp_extract("url", "item_id=([0-9]+)", 1).cast("bigint").alias("item_id"), "length", "sha256")


@query("s7_stream_events")
def _(spark, sf):
    """The stored part of the feed, run as a stream over the event table."""
    raw = spark.read.parquet(f"{sf}/events.parquet").schema
    e = feed.stream_events(spark, sf, raw, glob="events.parquet")
    path = work_dir(spark, "feed")
    shaped = e.select("event_id", v.H("user_id").alias("pubkey"), "event_type", "props",
                      F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"))
    shaped.writeStream.format("parquet").option("checkpointLocation", f"{path}/cp").trigger(
        availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(shaped.schema).parquet(f"{path}/out")


@query("s8_parse_subscriptions")
def _(spark, sf):
    lines = v.subs(v.table(spark, sf, "customer"), "c_custkey").select(frames.subscription_json().alias("value"))
    s = frames.parse_subscriptions(lines)
    return s.select(
        "sub_id", F.col("filter_no").cast("int").alias("filter_no"), F.col("ids").isNull().alias("any_id"),
        joined(F.transform("kinds", lambda k: k.cast("string"))).alias("kinds"),
        joined("authors").alias("authors"), joined(F.try_element_at("tags", F.lit("p"))).alias("p_values"),
        F.size(F.try_element_at("tags", F.lit("k"))).alias("n_k"), "since", "until", "lim")


@query("s8_quarantined_subscriptions")
def _(spark, sf):
    lines = v.broken_subs(spark, sf)
    bad = frames.quarantined_subscriptions(lines).select("sub_id", F.col("filter_no").cast("int"), "problem")
    good = frames.parse_subscriptions(lines).select("sub_id", F.col("filter_no").cast("int"), F.lit("none").alias("problem"))
    return bad.unionByName(good)


# --- expressions -------------------------------------------------------------------------


@query("e1_tag_values")
def _(spark, sf):
    return v.bare_events(spark, sf).select(
        "event_id", joined(tag_values("tags", "p")).alias("p"), first_tag("tags", "k").alias("k"),
        first_tag("tags", "relay").alias("relay"))


@query("e2_json_escape")
def _(spark, sf):
    d = v.table(spark, sf, "documents")
    odd = F.concat("text", F.when(F.col("doc_id") % 4 == 0, "\x01\x1f\x0b\"\\").otherwise(""))
    escaped = text.staged(text.staged(d, ["doc_id"], [odd.alias("odd")]), ["doc_id"], [text.json_string("odd").alias("e")])
    return escaped.select("doc_id", F.octet_length("e").alias("n_bytes"), F.sha2(F.col("e").cast("binary"), 256).alias("digest"))


@query("e3_event_id")
def _(spark, sf):
    return v.bare_events(spark, sf).select("event_id", event_id().alias("id"))


@query("e3_event_id_documents")
def _(spark, sf):
    d = v.table(spark, sf, "documents").select(
        "doc_id", v.H("doc_id").alias("pubkey"), (v.EPOCH + F.col("doc_id")).alias("created_at"), F.lit(14).alias("kind"),
        F.array(F.array(F.lit("source"), F.col("source")), F.array(F.lit("lang"), F.col("lang"))).alias("tags"),
        F.col("text").alias("content"))
    return d.select("doc_id", event_id().alias("id"))


@query("e4_is_lower_hex")
def _(spark, sf):
    e = v.events_bad(spark, sf)
    return e.select(
        "event_id", text.is_lower_hex("id", 32).alias("id_ok"), text.is_lower_hex("sig", 64).alias("sig_ok"),
        text.hex_lower(F.unhex("id")).alias("again"))


@query("e5_participants")
def _(spark, sf):
    e = v.events(spark, sf)
    me = v.H(F.col("event_id") % 150)
    return e.select("event_id", joined(participants("tags", "pubkey", me)).alias("others"))


@query("e6_relay_urls")
def _(spark, sf):
    return v.urls(spark, sf).select(
        "page_id", urls.relay_url_valid("url", urls.WEB_SCHEMES).alias("valid"),
        urls.normalize_relay_url("url").alias("normal"), urls.is_onion("url").alias("onion"))


@query("e7_media_servers")
def _(spark, sf):
    grouped = v.urls(spark, sf).groupBy(F.floor(F.col("page_id") / 5).alias("owner")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda s: s["url"]).alias("urls"))
    servers = urls.require_servers(urls.media_server_list("urls"))
    return grouped.select(
        "owner", joined(servers).alias("servers"), urls.proxy_url_valid(F.get("urls", F.lit(0))).alias("proxy_ok"))


def _flat_attachment(a: Column) -> list[Column]:
    plain = ("url", "mime", "key", "nonce", "encrypted_sha256", "plain_sha256", "size", "dimensions", "duration_seconds")
    return [a[c].alias(c) for c in plain] + [joined(a["fallbacks"]).alias("fallbacks")]


@query("e8_attachment_from_event")
def _(spark, sf):
    a = v.files(spark, sf).withColumn("a", attachments.attachment_from_event())
    return a.select("page_id", F.col("a").isNotNull().alias("readable"), *_flat_attachment(F.col("a")))


@query("e9_attachment_to_tags")
def _(spark, sf):
    a = v.files(spark, sf).withColumn("a", attachments.attachment_from_event()).filter("a is not null")
    return a.select("page_id", text.tags_json(attachments.attachment_to_tags("a")).alias("tags"))


@query("e10_attachment_kind")
def _(spark, sf):
    mime = first_tag("tags", "file-type")
    return v.files(spark, sf).select(
        "page_id", media.attachment_kind(mime).alias("kind"), media.attachment_label(mime).alias("label"))


@query("e11_media_types")
def _(spark, sf):
    d = v.files(spark, sf).withColumn("mime", F.lower(first_tag("tags", "file-type")))
    name = F.concat(F.lit("clip."), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".M4A").otherwise(".html"))
    return d.select(
        "page_id", media.mime_from_name(name).alias("from_name"), media.extension_for("mime").alias("extension"),
        joined(media.upload_labels("mime")).alias("labels"))


@query("e12_padded_length")
def _(spark, sf):
    d = v.table(spark, sf, "documents").withColumn("n", F.greatest("n_chars", F.lit(1)))
    return d.groupBy(padding.padded_length("n").alias("size_class")).agg(
        F.count(F.lit(1)).alias("n_messages"), F.min("n").alias("shortest"), F.max("n").alias("longest"))


@query("e13_display_names")
def _(spark, sf):
    return v.contacts(spark, sf).select(
        "pubkey", keys.display_name("name", "pubkey").alias("display_name"), keys.avatar_bucket("pubkey").alias("bucket"),
        keys.initial("name").alias("initial"))


@query("e14_labels")
def _(spark, sf):
    m = v.messages(spark, sf)
    now = F.lit(v.NOW - v.DAY * 10)
    return m.select(
        "id", labels.day_label("created_at", now).alias("day"), labels.time_label("created_at", now).alias("time"),
        labels.duration_label(F.col("seq") * 7 % 90_000 + 0.5).alias("duration"),
        labels.size_label(F.col("seq") * 7919 % 9_000_000).alias("size"))


@query("e15_build_events")
def _(spark, sf):
    t = v.turns(spark, sf).withColumn("author", v.H("conv_id")).withColumn("recipients", F.array(v.H(F.col("conv_id") + 1)))
    chat = build.build_chat_events(t.withColumnRenamed("id", "row_key"), keep=["row_key"])
    f = v.files(spark, sf).withColumn("attachment", attachments.attachment_from_event()).filter("attachment is not null")
    files = build.build_file_events(f.select(
        F.col("page_id").cast("string").alias("row_key"), F.col("pubkey").alias("author"),
        F.array(v.H(F.col("page_id") + 1)).alias("recipients"), "attachment", "created_at"), keep=["row_key"])
    own = v.contacts(spark, sf).select(
        F.col("pubkey").alias("row_key"), "pubkey", F.col("inbox_relays").alias("relays"), F.col("fetched_at").alias("created_at"))
    lists = build.build_inbox_lists(own, keep=["row_key"])
    return chat.unionByName(files).unionByName(lists).select("row_key", "kind", "id", text.tags_json("tags").alias("tags"))


# --- filters and checks ------------------------------------------------------------------


@query("f1_filter_events")
def _(spark, sf):
    wanted = EventFilter(kinds=[14, 1059], since=v.EPOCH + 5 * v.DAY, until=v.EPOCH + 25 * v.DAY,
                         tags={"k": [str(i) for i in range(0, 100, 3)]})
    return filters.filter_events(v.events(spark, sf), wanted).select("event_id", "id", "kind", "created_at")


@query("f2_fetch_events")
def _(spark, sf):
    wanted = [EventFilter(kinds=[1059], limit=50), EventFilter(kinds=[14, 1059], until=v.EPOCH + 20 * v.DAY, limit=40),
              EventFilter(kinds=[]), EventFilter(kinds=[10050])]
    return filters.fetch_events(v.events(spark, sf), wanted).select("id", "kind", "created_at")


@query("f3_valid_event_ids")
def _(spark, sf):
    return validation.valid_event_ids(v.events_bad(spark, sf)).select("event_id", "id")


@query("f4_accept_events")
def _(spark, sf):
    n = F.col("event_id")
    e = (
        v.events_bad(spark, sf).withColumn("sub_id", F.when(n % 3 == 0, "other").otherwise("inbox"))
        .withColumn("sig", F.when(n % 10 != 0, F.concat(v.H(n), v.H(n + 1)))).withColumn("sig_ok", n % 7 != 0)
    )
    wanted = {"inbox": [EventFilter(kinds=[1059]), EventFilter(kinds=[14, 15], since=v.EPOCH + 3 * v.DAY)]}
    return validation.accept_events(e, wanted).select("event_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


@query("f4_accept_events_table")
def _(spark, sf):
    """Thirty subscriptions are named, 25 are in the table."""
    n = F.col("event_id")
    e = (
        v.events(spark, sf).withColumn("sub_id", F.concat(F.lit("s"), (n % 30).cast("string")))
        .withColumn("sig", F.when(n % 10 != 0, F.concat(v.H(n), v.H(n + 1)))).withColumn("sig_ok", n % 7 != 0)
    )
    subs = v.subs(v.table(spark, sf, "nation"), "n_nationkey")
    return validation.accept_events(e, subs).select("event_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


@query("f5_chat_payloads")
def _(spark, sf):
    texts = v.turns(spark, sf).select(
        F.col("id").alias("row_key"), F.lit(14).alias("kind"), "tags",
        F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.col("text")).alias("content"))
    files = v.files(spark, sf).select(F.col("page_id").cast("string").alias("row_key"), "kind", "tags", "content")
    return validation.chat_payloads(texts.unionByName(files)).select("row_key", "kind", F.col("attachment.mime").alias("mime"))


@query("f6_readable_by")
def _(spark, sf):
    return filters.readable_by(v.bare_events(spark, sf), v.H(7)).select("event_id", "kind")


@query("f6_wraps_for_readers")
def _(spark, sf):
    readers = v.contacts(spark, sf).filter("is_request").select(F.col("pubkey").alias("reader"))
    return filters.wraps_for_readers(v.bare_events(spark, sf), readers).select("event_id", "reader")


def _chat_list(spark, sf, ordered=True):
    return conversations.chat_list(v.contacts(spark, sf), v.messages(spark, sf), v.NOW, ordered)


@query("f7_chat_list_filter")
def _(spark, sf):
    rows = _chat_list(spark, sf, ordered=False)
    unread = conversations.chat_list_filter(rows, "unread", " CUSTOMER#0000000 ").withColumn("tab", F.lit("unread"))
    requests = conversations.chat_list_filter(rows, "requests", '"K": 1').withColumn("tab", F.lit("requests"))
    return unread.unionByName(requests).select("tab", "pubkey", "title", "unread_count")


@query("f8_validate_outgoing")
def _(spark, sf):
    d = v.table(spark, sf, "documents")
    drafts = d.select(
        "doc_id", v.H("doc_id").alias("id"), v.H(v.ME).alias("pubkey"), (v.EPOCH + F.col("doc_id")).alias("created_at"),
        F.lit(14).alias("kind"), v.H(F.col("doc_id") % 1000).alias("peer"),
        F.when(F.col("doc_id") % 17 == 0, " \n\t").otherwise(F.concat(F.lit(" "), F.col("text"), F.lit("\n"))).alias("content"))
    drafts = drafts.withColumn("tags", F.array(F.array(F.lit("p"), F.col("peer"))))
    checked = validation.validate_outgoing(drafts, v.contacts(spark, sf))
    return checked.select("doc_id", "rumor_bytes", "seal_bytes", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query("f8_validate_files")
def _(spark, sf):
    p = v.table(spark, sf, "pages").select(
        "page_id", v.H("page_id").alias("peer"),
        (F.octet_length("html").cast("bigint") * (F.col("page_id") % 40) * 300).alias("n_bytes"))
    checked = validation.validate_files(p, v.contacts(spark, sf))
    return checked.select("page_id", "n_bytes", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query("f9_failed_messages")
def _(spark, sf):
    n = F.col("seq")
    m = v.messages(spark, sf).withColumn("attachment", F.when(
        n % 3 == 0, F.struct(F.when(n % 2 == 0, "").otherwise("https://cdn.example.com/x").alias("url"))))
    return validation.failed_messages(m).select("id", "retry")


@query("f10_find")
def _(spark, sf):
    one = filters.find_by_key(v.messages(spark, sf), "id", "m7").select("id")
    keys_wanted = v.table(spark, sf, "orders").select(v.H("o_custkey").alias("pubkey"))
    found = filters.lookup_keys(v.contacts(spark, sf), "pubkey", keys_wanted).select(F.col("pubkey").alias("id"))
    return one.unionByName(found)


# --- joins -------------------------------------------------------------------------------


@query("j1_match_subscriptions")
def _(spark, sf):
    s = v.subs(v.table(spark, sf, "nation"), "n_nationkey")
    return filters.match_subscriptions(v.events(spark, sf), s)


@query("j1_match_all")
def _(spark, sf):
    return filters.match_all_subscriptions(v.subs(v.table(spark, sf, "nation"), "n_nationkey"))


@query("j2_authenticate_layers")
def _(spark, sf):
    checked = inbox.authenticate_layers(*v.layers(spark, sf))
    return checked.select("wrap_id", F.coalesce("reason", F.lit("ok")).alias("reason"), F.col("rumor.id").alias("rumor_id"))


@query("j3_conversations")
def _(spark, sf):
    c = conversations.conversations(v.contacts(spark, sf), v.messages(spark, sf))
    return c.select("pubkey", F.col("last.id").alias("last_id"), F.col("last.created_at").alias("last_at"), "unread_count")


@query("j4_drop_blocked")
def _(spark, sf):
    return inbox.drop_blocked(v.messages(spark, sf), v.block_log(spark, sf)).select("id", "peer", "status")


@query("j4_drop_blocked_now")
def _(spark, sf):
    return inbox.drop_blocked_now(v.messages(spark, sf), v.contacts(spark, sf)).select("id", "peer", "status")


def _copies_text(spark, sf):
    return v.copies(spark, sf).withColumn("relay", F.col("relay").cast("string"))


@query("j5_resolve_inbox_relays")
def _(spark, sf):
    lists = contacts.latest_inbox_list(_copies_text(spark, sf))
    own = F.array(F.lit("wss://own.example.com"))
    r = contacts.resolve_inbox_relays(v.contacts(spark, sf), lists, own, v.NOW)
    return r.select("pubkey", joined("relays").alias("relays"), "source")


@query("j6_import_contacts")
def _(spark, sf):
    c = v.table(spark, sf, "customer")
    n = F.col("c_custkey")
    key = v.H(n - n % 3 * F.when(n % 6 == 1, 1).otherwise(0))
    raw = (
        F.when(n % 5 == 0, F.concat(F.lit("  nostr:"), keys.npub(key), F.lit("\n")))
        .when(n % 5 == 1, F.upper(key)).when(n % 5 == 2, keys.npub(key))
        .when(n % 5 == 3, F.concat(F.substring(keys.npub(key), 1, 62), F.lit("b"))).otherwise(F.col("c_name")))
    accepted, rejected = contacts.import_contacts(c.select(raw.alias("raw")), v.H(10))
    good = accepted.select(F.lit("accepted").alias("outcome"), F.col("pubkey").alias("key"), F.length("npub").alias("n_chars"))
    counted = rejected.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).cast("int").alias("n_chars"))
    return good.unionByName(counted.withColumn("key", F.lit("")))


@query("j7_match_acks")
def _(spark, sf):
    return delivery.match_acks(v.attempts(spark, sf), v.acks(spark, sf))


@query("j8_relay_status")
def _(spark, sf):
    n = F.col("s_suppkey")
    owner = F.floor(n / 5)
    s = v.table(spark, sf, "supplier").select("s_suppkey", owner.alias("owner"))
    url = F.concat(F.lit("wss://r"), n.cast("string"), F.when(n % 5 == 0, ".onion").otherwise(".example.com"))
    settings = s.groupBy("owner").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", url.alias("url")))), lambda x: x["url"]).alias("relays"))
    live = s.filter(n % 4 != 3).select(
        "owner", url.alias("url"),
        F.when(n % 4 == 0, "connected").when(n % 4 == 1, "connecting").otherwise("disconnected").alias("state"),
        F.when(n % 8 == 2, "no route").alias("last_error"))
    return delivery.relay_status(settings, live)


@query("j9_resolve_replies")
def _(spark, sf):
    r = messages.resolve_replies(v.turns(spark, sf))
    return r.select("id", "reply_to", "parent_author", F.length("parent_text").alias("parent_chars"))


@query("j10_fetch_blobs")
def _(spark, sf):
    return attachments.fetch_blobs(v.locations(spark, sf), v.blobs(spark, sf))


@query("j10_blob_locations")
def _(spark, sf):
    f = v.files(spark, sf).withColumn("attachment", attachments.attachment_from_event()).filter("attachment is not null")
    servers = F.array(F.lit("https://m1.example.com/"), F.lit("https://m2.example.com"))
    return attachments.blob_locations(f.withColumnRenamed("page_id", "file_id"), servers)


# --- aggregations ------------------------------------------------------------------------


@query("a1_last_message")
def _(spark, sf):
    m = conversations.last_message(v.messages(spark, sf))
    return m.select("peer", *[F.col(f"last.{c}").alias(c) for c in ("id", "created_at", "text", "status")])


@query("a2_unread_counts")
def _(spark, sf):
    return conversations.unread_counts(v.messages(spark, sf), v.contacts(spark, sf))


def _states(spark, sf):
    return delivery.delivery_status(v.order_messages(spark, sf), v.attempts(spark, sf), as_of=883_612_800)


@query("a3_delivery_status")
def _(spark, sf):
    return _states(spark, sf)


@query("a4_delivery_ticks")
def _(spark, sf):
    return delivery.delivery_ticks(_states(spark, sf))


@query("a5_upload_results")
def _(spark, sf):
    u = attachments.upload_results(v.uploads(spark, sf))
    return u.select("file_id", joined("urls").alias("urls"), joined("errors").alias("errors"), "primary_url",
                    joined("fallbacks").alias("fallbacks"), "status")


@query("a6_connection_summary")
def _(spark, sf):
    s = v.table(spark, sf, "supplier").select(
        F.when(F.col("s_acctbal") > 0, "connected").otherwise("disconnected").alias("status"))
    return delivery.connection_summary(s)


@query("a7_sync_high_water")
def _(spark, sf):
    e = v.events(spark, sf)
    done = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sub_id"),
                                        F.col("created_at").alias("seen_at"))
    users = v.table(spark, sf, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("sub_id"),
        (v.EPOCH + F.col("c_custkey") * 86_000 % 2_600_000).alias("last_sync_at"))
    return merge.sync_high_water(done, users)


def _contents(spark, sf):
    # The test table is one small file with one row group; it is dealt out as a stored log would be.
    return v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")).repartition("id")


@query("a8_leak_audit")
def _(spark, sf):
    wraps, _, rumors = v.layers(spark, sf)
    wraps = wraps.withColumn("created_at", F.when(F.col("event_id") % 101 == 0, F.col("created_at") + 500_000)
                             .otherwise(F.col("created_at"))).withColumn(
        "pubkey", F.when(F.col("event_id") % 97 == 0, v.H(F.col("event_id") % 150)).otherwise(F.col("pubkey")))
    identities = v.table(spark, sf, "customer").select(v.H("c_custkey").alias("pubkey"))
    contents = _contents(spark, sf)
    known = v.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("plaintext"))
    return audit.leak_audit(wraps, rumors, identities, contents, known)


@query("a8_plaintext_leaks")
def _(spark, sf):
    contents = _contents(spark, sf)
    known = v.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("plaintext"))
    return audit.plaintext_leaks(contents, known)


# --- ordered operators -------------------------------------------------------------------


@query("w1_latest_inbox_list")
def _(spark, sf):
    # Some lists are emptied so that an empty newest list hides an older one of the same relay.
    c = _copies_text(spark, sf)
    empty = (F.col("event_id") % 3 == 2) & (F.col("relay") == "1")
    emptied = c.withColumn("tags", F.when(empty, F.array().cast("array<array<string>>")).otherwise(F.col("tags")))
    return contacts.latest_inbox_list(emptied).select("pubkey", joined("relays").alias("relays"), "listed_at")


@query("w2_timeline")
def _(spark, sf):
    return conversations.timeline(v.messages(spark, sf)).select("peer", "id", "created_at", "new_day", "starts_group")


@query("w3_message_groups")
def _(spark, sf):
    return conversations.message_groups(v.messages(spark, sf), gap=6 * 3600)


@query("w3_timeline_rows")
def _(spark, sf):
    marked = conversations.timeline(v.messages(spark, sf))
    return conversations.timeline_rows(marked, v.NOW).select("peer", "id", "row_type", "label")


@query("w4_rebuild_on_late")
def _(spark, sf):
    m = v.messages(spark, sf)
    late = m.filter((F.col("seq") % 97 == 0))
    stored = m.filter((F.col("seq") % 97 != 0) | (F.col("seq") % 2 == 0))
    return conversations.rebuild_on_late(stored, late).select("peer", "id", "new_day", "starts_group")


@query("w5_chat_list")
def _(spark, sf):
    return _chat_list(spark, sf)


@query("w6_contacts_sorted")
def _(spark, sf):
    c = v.contacts(spark, sf)
    tabs = c.withColumn("tab", F.lit("all")).unionByName(c.filter("is_blocked").withColumn("tab", F.lit("blocked")))
    return conversations.contacts_sorted(tabs).select("tab", "pubkey", "display_name")


@query("w7_top_n_list")
def _(spark, sf):
    grouped = v.urls(spark, sf).groupBy(F.floor(F.col("page_id") / 8).alias("owner")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda s: s["url"]).alias("urls"))
    return grouped.select("owner", joined(contacts.top_n_list(urls.relay_url_list("urls", urls.WEB_SCHEMES))).alias("inbox"))


# --- set operations ----------------------------------------------------------------------


@query("x1_merge_relays")
def _(spark, sf):
    c = v.copies(spark, sf)
    merged = merge.merge_relays(*[c.filter(F.col("relay") == r) for r in range(3)], arrival=["arrival", "relay"])
    return merged.select("id", "relay", "arrival")


@query("x2_relay_changes")
def _(spark, sf):
    u = v.urls(spark, sf)
    return merge.relay_changes(u.filter("page_id % 3 <> 0"), u.filter("page_id % 2 = 0"), urls.WEB_SCHEMES)


@query("x3_unprocessed")
def _(spark, sf):
    e = v.events(spark, sf)
    done = v.copies(spark, sf).filter("relay = 2").select("id")
    return merge.unprocessed(e, done).select("event_id", "id")


# --- folds -------------------------------------------------------------------------------


@query("c1_apply_contact_changes")
def _(spark, sf):
    return contacts.apply_contact_changes(v.contacts(spark, sf), v.contact_log(spark, sf), v.H(5))


@query("c2_apply_message_changes")
def _(spark, sf):
    stored = v.order_messages(spark, sf).select(
        F.concat(F.lit("m"), F.col("message_id").cast("string"), F.lit("-0")).alias("id"), v.H(0).alias("peer"),
        F.lit("Received").alias("status"))
    return messages.apply_message_changes(stored, v.message_log(spark, sf))


def _processed(spark, sf):
    return v.table(spark, sf, "events").filter("event_id % 11 = 0").select(v.H(F.col("event_id") + 3_000_000).alias("id"))


def _fold(spark, sf):
    """Every wrap twice, some processed before, some messages stored already, blocks of some owners."""
    wraps, seals, rumors = v.layers(spark, sf)
    stored = v.events(spark, sf).filter("event_id % 13 = 0").select(
        v.H((F.col("user_id") * 7 + F.col("event_id")) % 150).alias("owner"), "id")
    return inbox.fold_inbox(
        wraps.union(v.repeated(wraps)), seals, rumors, _processed(spark, sf), v.owner_block_log(spark, sf), stored)


@query("c3_fold_inbox")
def _(spark, sf):
    return _fold(spark, sf).messages.select("owner", "id", "peer", "author", "text", "created_at", "status", "reply_to")


@query("c3_handled")
def _(spark, sf):
    return _fold(spark, sf).handled


@query("c3_implied_contacts")
def _(spark, sf):
    return inbox.implied_contacts(_fold(spark, sf).messages)


@query("c4_pending_uploads")
def _(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("n"))
    empty = F.lit(None).cast("string")
    files = d.select(
        F.col("doc_id"), v.H(v.ME).alias("author"), F.array(v.H("doc_id")).alias("recipients"),
        (v.EPOCH + F.col("doc_id")).alias("created_at"), F.struct(
            F.lit("").alias("url"), F.array().cast("array<string>").alias("fallbacks"), F.lit("image/png").alias("mime"),
            v.H(F.col("doc_id")).alias("key"), F.substring(v.H(F.col("doc_id") + 1), 1, 24).alias("nonce"),
            v.H(F.col("doc_id") + 2).alias("encrypted_sha256"), empty.alias("plain_sha256"),
            F.col("n").cast("bigint").alias("size"), empty.alias("dimensions"),
            F.lit(None).cast("double").alias("duration_seconds")).alias("attachment"))
    done = attachments.upload_results(v.uploads(spark, sf)).withColumn("file_id", v.H(F.col("file_id") + 2))
    return messages.pending_uploads(files, done)


# --- streams -----------------------------------------------------------------------------


def _fed(rows: DataFrame, number: Column, n: int, path: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Writes ``rows`` to ``path`` in ``n`` appends by ``number``; the stream that ``start`` makes takes each before the next comes, in one batch."""
    for i in range(n):
        rows.filter(number == i).write.option("compression", "zstd").mode("append").parquet(path)
        start(feed.stream_events(rows.sparkSession, path, rows.schema)).awaitTermination()


def _stored(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` as a table, so that slices are taken from it without computing all rows for each."""
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@query("t1_stream_dedup")
def _(spark, sf):
    """Copies relay by relay; one event in fifty comes long after newer ones, with its first copy."""
    path = work_dir(spark, "dedup")
    copies = v.copies(spark, sf)
    number = F.when(F.col("event_id") % 50 == 7, 3).otherwise(F.col("relay"))
    _fed(copies, number, 4, f"{path}/in", lambda source: dedup.stream_dedup(source.select("id", "relay", "arrival"), f"{path}/out", f"{path}/cp"))
    return dedup.deduplicated(spark, f"{path}/out").select("id")


@query("t2_catch_up_bound")
def _(spark, sf):
    synced = v.table(spark, sf, "customer").select(
        v.H("c_custkey").alias("pubkey"),
        F.when(F.col("c_custkey") % 6 == 0, 0).otherwise(v.EPOCH + F.col("c_custkey") * 7919 % 2_592_000).alias("last_sync_at"))
    bounds = synced.withColumn("since", merge.catch_up_bound(F.col("last_sync_at")))
    e = v.events(spark, sf).filter("kind = 1059")
    hits = e.join(bounds, "pubkey").filter(F.col("since").isNull() | (F.col("created_at") >= F.col("since")))
    return hits.groupBy("pubkey").agg(F.count(F.lit(1)).alias("n_wraps"), F.min("since").alias("since"))


@query("t3_stream_inbox")
def _(spark, sf):
    """Wraps in four slices: all of them, then all of them again, four days later."""
    path = work_dir(spark, "inbox")
    wraps, seals, rumors = v.layers(spark, sf)
    again = v.repeated(wraps)
    half = (F.col("arrival") > v.EPOCH + 15 * v.DAY).cast("int")
    both = wraps.withColumn("slice", half).union(again.withColumn("slice", half + 2))
    _fed(both, F.col("slice"), 4, f"{path}/in", lambda source: stream_inbox.stream_inbox(
        source.drop("slice"), lambda _: (seals, rumors), _processed(spark, sf), v.owner_block_log(spark, sf), f"{path}/store", f"{path}/cp"))
    return stream_inbox.current_messages(spark, f"{path}/store").select("owner", "id", "peer", "text", "status")


@query("t3_stream_messages")
def _(spark, sf):
    """The change log of c2 in four slices, as a stream."""
    path = work_dir(spark, "messages")
    rows = _stored(v.message_log(spark, sf), f"{path}/log")
    number = F.floor(F.col("seq") * 4 / (rows.agg(F.max("seq")).scalar() + 1))
    _fed(rows, number, 4, f"{path}/in", lambda source: stream_messages.stream_messages(source, f"{path}/store", f"{path}/cp"))
    return stream_messages.stored_messages(spark, f"{path}/store")


@query("t4_stream_delivery")
def _(spark, sf):
    """Sends and answers in four slices that follow neither their times nor each other."""
    path = work_dir(spark, "delivery")
    publishes = v.attempts(spark, sf).select("message_id", "relay", "attempt", "sent_at")
    rows = _stored(stream_delivery.delivery_log(publishes, v.acks(spark, sf)), f"{path}/log")
    at = F.coalesce("sent_at", "acked_at")
    _fed(rows, F.pmod(-F.floor(at / (200 * v.DAY)), F.lit(4)), 4, f"{path}/in", lambda source: stream_delivery.stream_delivery(
        source, f"{path}/store", f"{path}/cp"))
    return stream_delivery.delivery_states(spark, f"{path}/store", v.MID_SHIPPING)


@query("t5_first_answer")
def _(spark, sf):
    c = v.copies(spark, sf)
    results = c.select(
        F.col("pubkey").alias("query_id"), F.col("relay").alias("source"), "id",
        ((F.col("event_id") * 37 + F.col("relay") * 911) % 12_000).alias("arrival"))
    finishes = c.select("pubkey", "relay", "user_id").distinct().select(
        F.col("pubkey").alias("query_id"), F.col("relay").alias("source"),
        F.when(F.col("user_id") % 9 != F.col("relay"), (F.col("user_id") * 53 + F.col("relay") * 2000) % 11_000).alias("finished_at"))
    return merge.first_answer(results, finishes, 8_000)


@query("t6_auth_outcomes")
def _(spark, sf):
    e = v.raw_events(spark, sf)
    n = F.col("event_id")
    verb = F.when(n % 50 == 7, "AUTH").when(n % 4 == 0, "CLOSED").otherwise("OK")
    frames_ = e.select(
        (F.col("user_id") % 20).alias("relay"), n.alias("seq"), verb.alias("verb"),
        F.concat(F.lit("k"), (n % 500).cast("string")).alias("key"), F.when(verb == "OK", n % 5 == 0).alias("flag"),
        F.when(n % 3 == 0, "auth-required: no").when(n % 7 == 0, "duplicate: yes").otherwise("blocked: no").alias("text"))
    return delivery.auth_outcomes(frames_)


# --- blobs -------------------------------------------------------------------------------


@query("b1_verify_blobs")
def _(spark, sf):
    return attachments.verify_blobs(v.blobs(spark, sf)).select("url", "verdict")


@query("b2_decrypt_blobs")
def _(spark, sf):
    """Documents encrypted with built-in AES-GCM, some tampered with or with odd keys, then opened."""
    d = v.table(spark, sf, "documents").select("doc_id", "text", v.H("doc_id").alias("hex"))
    n = F.col("doc_id")
    nonce = F.substring("hex", 1, 24)
    sealed = F.aes_encrypt(F.col("text").cast("binary"), F.unhex("hex"), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(nonce))
    body = F.substring(sealed, F.lit(13), F.octet_length(sealed))
    blobs = d.select(
        "doc_id", F.when(n % 10 == 0, F.concat(body, F.lit("x").cast("binary"))).otherwise(body).alias("content"),
        F.when(n % 10 == 1, F.substring("hex", 1, 62)).otherwise(F.col("hex")).alias("key"),
        F.when(n % 10 == 2, F.substring("hex", 1, 32)).when(n % 10 == 3, F.substring("hex", 1, 8)).otherwise(nonce).alias("nonce"))
    opened = attachments.decrypt_blobs(blobs)
    return opened.select("doc_id", F.coalesce("failure", F.lit("ok")).alias("outcome"), F.sha2("plain", 256).alias("plain_sha256"))
