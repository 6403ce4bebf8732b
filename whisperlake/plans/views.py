"""Event-log views over the TPC-H-like test tables, so that every operator runs on real row counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whisperlake.functions.events import event_id, event_json
from whisperlake.functions.text import staged
from whisperlake.schemas import FAILED, RECEIVED, SENDING, SENT
from whisperlake.session import configure_session, work_dir

EPOCH = 1_704_067_200
DAY = 86_400
NOW = 1_706_659_200
# A moment at which some of the line items are still to be shipped.
MID_SHIPPING = 820_454_400
ME = -1


# Views that were written once for measuring: (folder, view) -> path.
_written: dict[tuple[str, str], str] = {}
_VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def storable(view):
    """A view that reads its stored rows where :func:`store_views` has written them."""
    def read(spark: SparkSession, sf: str) -> DataFrame:
        path = _written.get((sf, view.__name__))
        return spark.read.parquet(path) if path else view(spark, sf)

    _VIEWS[view.__name__] = view
    return read


def store_views(spark: SparkSession, sf: str) -> dict[str, int]:
    """Writes all storable views to the shared folder, as a real log would have them, and counts their rows."""
    rows = {}
    for name, view in _VIEWS.items():
        path = work_dir(spark, f"view-{name}")
        view(spark, sf).repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
        _written[sf, name] = path
        rows[name] = spark.read.parquet(path).count()
    return rows


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return configure_session(spark).read.parquet(f"{sf}/{name}.parquet")


def H(c) -> Column:
    """Lower-case SHA-256 hex of the decimal text of a number."""
    c = F.lit(c) if isinstance(c, int) else F.col(c) if isinstance(c, str) else c
    return F.sha2(c.cast("string").cast("binary"), 256)


def _every(c: str, n: int) -> Column:
    return F.col(c) % n == 0


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "props",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"),
        F.regexp_extract("props", r'"k": *([0-9]+)', 1).alias("k"))


def _by_type(**values) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(F.col("event_type") == name, value).otherwise(out)
    return out


def bare_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events without their id."""
    e = raw_events(spark, sf)
    tag = lambda *parts: F.array(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    relay = F.concat(F.lit("wss://Relay"), (F.col("event_id") % 5).cast("string"), F.lit(".example.com/"))
    tags = F.when(F.col("event_type") == "signup", F.array(tag("relay", relay))).otherwise(
        F.array(tag("p", H((F.col("user_id") * 7 + F.col("event_id")) % 150)), tag("k", F.col("k"))))
    kind = _by_type(view=14, click=1059, purchase=15, signup=10050, error=13).cast("int")
    return e.select(
        "event_id", "user_id", H("user_id").alias("pubkey"), "created_at", kind.alias("kind"), tags.alias("tags"),
        F.col("props").alias("content"), F.lit(None).cast("string").alias("sig"))


@storable
def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their id, which a real log would have stored: computed once, not per use."""
    bare = bare_events(spark, sf)
    return staged(bare, bare.columns, [event_id().alias("id")])


@storable
def events_bad(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).withColumn(
        "created_at", F.when(_every("event_id", 13), F.col("created_at") + 1).otherwise(F.col("created_at"))
    ).withColumn("id", F.when(_every("event_id", 17), F.upper("id")).otherwise(F.col("id")))


@storable
def copies(spark: SparkSession, sf: str) -> DataFrame:
    spread = events(spark, sf).withColumn("relay", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))))
    late = F.when(_every("event_id", 50), 259_200).otherwise(0)
    return spread.withColumn("arrival", F.col("created_at") + F.col("relay") * 17 + F.col("event_id") % 90 + late)


def subs(keys: DataFrame, key: str) -> DataFrame:
    """Subscriptions numbered by ``key``."""
    s = F.col(key).cast("bigint")
    kinds = F.array(F.lit(14), F.lit(1059), F.lit(15), F.lit(10050), F.lit(13))
    values = F.array(H(s), H(s + 20))
    none = F.lit(None)
    return keys.select(
        F.concat(F.lit("s"), s.cast("string")).alias("sub_id"), F.lit(0).alias("filter_no"),
        none.cast("array<string>").alias("ids"), F.when(s % 6 == 5, F.array(H(s), H(s + 5))).alias("authors"),
        F.when(s % 4 == 0, none).when(s % 20 == 19, F.array().cast("array<int>"))
        .otherwise(F.array(F.get(kinds, (s % 5).cast("int")))).alias("kinds"),
        F.when(s % 9 == 4, F.create_map(F.lit("p"), values, F.lit("k"), F.transform(
            F.sequence(F.lit(0), F.lit(60)), lambda i: i.cast("string"))))
        .when(s % 3 != 0, F.create_map(F.lit("p"), values)).alias("tags"),
        F.when(s % 5 != 0, EPOCH + s % 20 * DAY).alias("since"),
        F.when(s % 7 == 3, EPOCH + (s % 20 + 12) * DAY).alias("until"), F.lit(5).alias("lim"))


def broken_subs(spark: SparkSession, sf: str) -> DataFrame:
    """REQ lines (``value``) of which most have one malformed part."""
    n = F.col("c_custkey")
    part = (
        F.when(n % 7 == 0, '{"kinds":"14"}').when(n % 7 == 1, '{"kinds":[14,1.7]}').when(n % 7 == 2, '{"ids":[1]}')
        .when(n % 7 == 3, '{"#p":["x",null]}').when(n % 7 == 4, '{"since":"1"},{"kinds":[14]}').when(n % 7 == 5, "7")
        .otherwise('{"kinds":[14],"authors":null}'))
    return table(spark, sf, "customer").select(F.concat(
        F.lit('["REQ","s'), n.cast("string"), F.lit('",'), part, F.lit("]")).alias("value"))


def layers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wraps, seals, rumors): one chain per event, broken on purpose in four ways."""
    e = events(spark, sf)
    n = F.col("event_id")
    seal_id = H(n + 2_000_000)
    wraps = e.select(
        "event_id", H(n + 3_000_000).alias("id"), H(n + 1_000_000).alias("pubkey"), F.lit(1059).alias("kind"),
        F.lit(True).alias("wrap_ok"), seal_id.alias("seal_id"),
        H((F.col("user_id") * 7 + n) % 150).alias("owner"), (F.col("created_at") + n % 90).alias("arrival"),
        (F.col("created_at") - n * 7919 % 172_800).alias("created_at"))
    seals = e.select(
        seal_id.alias("id"), F.when(n % 23 == 0, 14).otherwise(13).alias("kind"),
        F.when(n % 31 == 0, H(n)).otherwise(F.col("pubkey")).alias("pubkey"),
        F.when(n % 29 == 0, 1).otherwise(0).alias("n_tags"), F.lit(True).alias("seal_ok"))
    rumors = e.select(
        seal_id.alias("seal_id"), F.when(n % 37 == 0, H(n)).otherwise(F.col("id")).alias("id"),
        "pubkey", "created_at", "kind", "tags", "content")
    return wraps, seals, rumors


def repeated(wraps: DataFrame) -> DataFrame:
    """Each wrap once more, four days later: after any block that its first copy met."""
    return wraps.withColumn("arrival", F.col("arrival") + 4 * DAY)


def owner_block_log(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of every second owner against the authors that write to them; the other owners block nobody."""
    owner = (F.col("user_id") * 7 + F.col("event_id")) % 150
    pairs = table(spark, sf, "events").select(owner.alias("owner_no"), "user_id").distinct().filter("owner_no % 2 = 0")
    log = block_log(spark, sf)
    return pairs.select(H("owner_no").alias("owner"), H("user_id").alias("peer")).join(log, "peer").select(
        "owner", "peer", "changed_at", "blocked")


@storable
def messages(spark: SparkSession, sf: str) -> DataFrame:
    e = raw_events(spark, sf)
    status = _by_type(view=RECEIVED, click=RECEIVED, purchase=SENT, error=FAILED, signup=SENDING)
    return e.select(
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("id"), F.col("event_id").alias("seq"),
        H("user_id").alias("peer"), F.when(status == RECEIVED, H("user_id")).otherwise(H(ME)).alias("author"),
        F.col("props").alias("text"), (F.floor(F.col("created_at") / 900) * 900).alias("created_at"),
        status.alias("status"))


@storable
def contacts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    n = F.col("c_custkey")
    url = F.concat(F.lit("wss://inbox"), (n % 9).cast("string"), F.lit(".example.com"))
    return c.select(
        H(n).alias("pubkey"), F.when(n % 5 == 0, F.lit(None)).when(n % 7 == 0, "  ").otherwise(F.col("c_name")).alias("name"),
        (n % 11 == 0).alias("is_blocked"), ((n % 3 == 0) & (n % 11 != 0)).alias("is_request"),
        (EPOCH + n * 7919 % 2_592_000).alias("last_read_at"),
        F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(url)).alias("inbox_relays"),
        (NOW - n * 37 % 43_200).alias("fetched_at"))


def block_log(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").select("user_id").distinct()
    start = EPOCH + F.col("user_id") % 10 * DAY
    entries = F.array(
        F.struct(start.alias("changed_at"), F.lit(True).alias("blocked")),
        F.when(_every("user_id", 2), F.struct((start + 3 * DAY).alias("changed_at"), F.lit(False).alias("blocked"))))
    return users.select(H("user_id").alias("peer"), F.explode(F.array_compact(entries)).alias("e")).select("peer", "e.*")


@storable
def contact_log(spark: SparkSession, sf: str) -> DataFrame:
    e = raw_events(spark, sf)
    n = F.col("event_id")
    op = F.when(n % 41 == 0, "remove").when(n % 43 == 0, "upsert").otherwise(
        _by_type(view="ensure", click="mark_read", purchase="add", signup="block", error="unblock"))
    k = F.col("k").cast("int")
    return e.select(
        n.alias("seq"), H("user_id").alias("pubkey"), op.alias("op"),
        F.when(op == "upsert", F.concat(F.lit("u"), F.col("k")))
        .when(op == "add", F.when(k % 4 == 0, " ").otherwise(F.col("k"))).alias("name"),
        (n % 2 == 0).alias("is_request"), (n % 3 == 0).alias("is_blocked"), F.col("created_at").alias("last_read_at"))


@storable
def message_log(spark: SparkSession, sf: str) -> DataFrame:
    """add, replace and update per line item, remove for some suppliers; in line item order."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("n"))
    key, sup = F.col("l_orderkey"), F.col("l_suppkey")
    base = (key * 1000 + sup % 200 * 5) * 10
    final = F.concat(F.lit("m"), key.cast("string"), F.lit("-"), sup.cast("string"))
    draft = F.concat(F.lit("upload-"), key.cast("string"), F.lit("-"), sup.cast("string"))
    swap = key % 3 == 0

    def row(offset: int, op: str, ident: Column, old: Column, status: str) -> Column:
        return F.struct(
            (base + offset).alias("seq"), F.lit(op).alias("op"), ident.alias("id"), old.cast("string").alias("old_id"),
            F.lit(status).alias("status"))

    rows = F.array_compact(F.array(
        row(0, "add", F.when(swap, draft).otherwise(final), F.lit(None), SENDING),
        F.when(swap, row(1, "replace", final, draft, SENDING)),
        F.when(key % 2 == 0, row(2, "update", final, F.lit(None), SENT)),
        F.when(key % 7 == 0, row(3, "update", draft, F.lit(None), FAILED)),
        F.when(sup % 50 == 0, row(4, "remove", F.lit(None).cast("string"), F.lit(None), SENT)),
        F.when(key % 5 == 0, row(5, "add", final, F.lit(None), RECEIVED)),
    ))
    return li.select(H(sup).alias("peer"), F.explode(rows).alias("r")).select("r.*", "peer")


@storable
def attempts(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("r"),
        F.unix_seconds(F.min("l_shipdate").cast("timestamp")).alias("sent_at"))
    return li.select(
        F.col("l_orderkey").alias("message_id"), F.col("l_suppkey").alias("relay"), F.lit(1).alias("attempt"),
        F.when(F.col("a"), "accepted").when(F.col("r"), "rejected").otherwise("pending").alias("outcome"),
        "sent_at", (F.col("sent_at") + F.col("l_suppkey") % 45).alias("acked_at"))


@storable
def acks(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to the attempts: some ask for authentication first, some refuse as duplicates, some are late."""
    a = attempts(spark, sf).filter("outcome <> 'pending'")
    ok = F.col("outcome") == "accepted"
    asks = F.col("relay") % 11 == 0
    text = F.when(ok, "").when(F.col("relay") % 7 == 0, "duplicate: already have it").otherwise("blocked: not here")
    first = F.struct(F.lit(False).alias("ack_ok"), F.lit("auth-required: who are you").alias("ack_text"),
                     F.col("acked_at").alias("acked_at"))
    final = F.struct(ok.alias("ack_ok"), text.alias("ack_text"),
                     (F.col("acked_at") + F.when(asks, 2).otherwise(0)).alias("acked_at"))
    both = F.array_compact(F.array(F.when(asks, first), F.when(~(asks & (F.col("message_id") % 5 == 0)), final)))
    return a.select("message_id", "relay", F.explode(both).alias("x")).select("message_id", "relay", "x.*")


def order_messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("message_id"))


@storable
def turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    ident = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    turn = F.col("turn")
    reply = F.when(turn > 0, ident(turn - 1))
    return c.select(
        ident(turn).alias("id"), "conv_id", F.col("role").alias("author"), "text",
        (EPOCH + F.col("conv_id") * 3600 + turn * 173).alias("created_at"), reply.alias("reply_to"),
        F.when(reply.isNotNull(), F.array(F.array(F.lit("p"), F.col("role")), F.array(F.lit("e"), reply, F.lit(""), F.lit("reply"))))
        .otherwise(F.array(F.array(F.lit("p"), F.col("role")))).alias("tags"))


@storable
def urls(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", "url")
    host = F.regexp_extract("url", r"://([^/?#]+)", 1)
    port = F.when(F.col("url").startswith("https:"), ":443").otherwise(":80")
    loud = F.concat(F.regexp_extract("url", r"^([a-z]+://)", 1), F.upper(host), port,
                    F.regexp_extract("url", r"://[^/?#]+(.*)$", 1))
    url = F.when(_every("page_id", 4), loud).otherwise(F.col("url"))
    return p.select("page_id", F.when(_every("page_id", 5), F.concat(F.lit("  "), url, F.lit("  "))).otherwise(url).alias("url"))


@storable
def files(spark: SparkSession, sf: str) -> DataFrame:
    """File message events from pages."""
    p = table(spark, sf, "pages")
    n = F.col("page_id")
    pair = lambda name, value: F.array(F.lit(name), value)
    x = F.sha2(F.col("html").cast("binary"), 256)
    mirrors = F.transform(
        F.sequence(F.lit(0), F.lit(2)),
        lambda i: F.when(i < n % 3, pair("fallback", F.concat(F.lit("https://mirror"), i.cast("string"), F.lit(".example.com/"), x))))
    head = F.array(
        F.when(n % 4 == 0, pair("file-type", F.lit("image/JPEG"))).when(n % 4 == 1, pair("file-type", F.lit("video/mp4")))
        .when(n % 4 == 2, pair("file-type", F.lit("audio/mp4"))),
        pair("encryption-algorithm", F.when(n % 9 == 0, "rot13").otherwise("AES-GCM")),
        pair("decryption-key", F.substring(H(n), F.lit(1), F.when(n % 10 == 0, 63).otherwise(64))),
        pair("decryption-nonce", F.substring(H(n + 1), 1, 24)),
        pair("x", F.when(n % 3 == 0, F.upper(x)).otherwise(x)),
        pair("size", F.octet_length("html").cast("string")),
        F.when(n % 4 == 1, pair("duration", F.concat((n % 4000).cast("string"), F.lit(".25")))))
    return p.select(
        "page_id", H(n).alias("pubkey"), (EPOCH + n).alias("created_at"), F.lit(15).alias("kind"),
        F.concat(F.array_compact(head), F.array_compact(mirrors)).alias("tags"), F.col("url").alias("content"))


@storable
def blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes on three servers; some serve changed bytes, some nothing."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    spread = d.withColumn("server", F.explode(F.sequence(F.lit(0), F.lit(2)))).filter((F.col("doc_id") + F.col("server")) % 7 != 0)
    wrong = (F.col("doc_id") + F.col("server")) % 3 == 0
    return spread.select(
        "doc_id", "server", blob_url().alias("url"),
        F.when(wrong, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary").alias("content"),
        F.sha2(F.col("text").cast("binary"), 256).alias("expected_sha256"))


def blob_url() -> Column:
    return F.concat(F.lit("https://server"), F.col("server").cast("string"), F.lit(".example.com/"), F.col("doc_id").cast("string"))


@storable
def locations(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("expected_sha256"))
    return d.withColumn("server", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        F.col("doc_id").alias("file_id"), "expected_sha256", F.col("server").alias("pos"), blob_url().alias("url"))


@storable
def uploads(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sent_sha"))
    n, s = F.col("doc_id"), F.col("server_pos")
    grid = d.withColumn("server_pos", F.explode(F.sequence(F.lit(0), F.lit(2))))
    refused_label = (n + s) % 4 == 0
    tries = grid.withColumn("label_pos", F.explode(F.sequence(F.lit(0), F.when(refused_label, 1).otherwise(0))))
    down = (n + s) % 5 < 2
    ok = ~(refused_label & (F.col("label_pos") == 0)) & ~down
    return tries.select(
        F.col("doc_id").alias("file_id"), "sent_sha", "server_pos",
        F.concat(F.lit("https://Media"), s.cast("string"), F.lit(".example.com/")).alias("server"), "label_pos",
        F.when(refused_label & (F.col("label_pos") == 0), 415).when(down, 503).otherwise(200).alias("status"),
        F.when(ok, "OK").when(down, "Unavailable").otherwise("Unsupported").alias("reason"),
        F.when(ok & (n % 10 == 3), H(n)).when(ok & (n % 3 == 0), F.upper("sent_sha")).alias("reported_sha"),
        F.when(ok & (n % 2 == 0), F.concat(F.lit("https://cdn"), s.cast("string"), F.lit(".example.com/"), F.col("sent_sha"))).alias("url"))


@storable
def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Relay frames as text lines (``value``): one event each, some answers and notes, some broken on purpose."""
    e = staged(events(spark, sf), ["event_id", "id"], [event_json().alias("text")])
    n = F.col("event_id")
    every = n % 10
    quoted = F.concat(F.lit('"'), F.col("id"), F.lit('"'))
    event = F.concat(F.lit('["EVENT","inbox",'), F.col("text"), F.lit("]"))
    answer = F.when(n % 3 == 0, F.concat(F.lit('["OK",'), quoted, F.lit(",true]"))).when(
        n % 3 == 1, F.concat(F.lit('["OK",'), quoted, F.lit(',false,"blocked: no"]'))
    ).otherwise(F.concat(F.lit('["OK",'), quoted, F.lit(',"yes"]')))
    note = (
        F.when(every == 0, '["EOSE","inbox"]').when(every == 1, '["CLOSED","inbox","auth-required: x"]')
        .when(every == 2, F.concat(F.lit('["AUTH","ch'), n.cast("string"), F.lit('"]'))).when(every == 3, '["NOTICE",null]')
        .when(every == 4, '{"not":"array"}').when(every == 5, '["EVENT","inbox"]'))
    broken = F.when(n % 19 == 0, F.substring(event, F.lit(1), F.length(event) - 1)).when(
        n % 23 == 0, '["EVENT","inbox",{"id":"x"}]').otherwise(event)
    return e.select("event_id", F.explode(F.array(broken, answer, note)).alias("value")).filter("value is not null")


@storable
def event_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Event objects as JSON text, some with fields of the wrong type."""
    e = staged(events(spark, sf), ["event_id", "created_at"], [event_json().alias("text")])
    n, text = F.col("event_id"), F.col("text")
    swap = lambda a, b: F.replace(text, F.lit(a), b if isinstance(b, Column) else F.lit(b))
    stamp = F.concat(F.lit('"created_at":'), F.col("created_at").cast("string"))
    return e.select("event_id", F.when(n % 13 == 0, swap('"tags":[[', '"tags":[[5,'))
                    .when(n % 17 == 0, F.replace(text, stamp, F.concat(stamp, F.lit(".5"))))
                    .when(n % 19 == 0, swap('"content":', '"body":'))
                    .when(n % 23 == 0, swap('"kind":', '"sig":"","more":[1],"kind":'))
                    .when(n % 29 == 0, swap('"tags":[[', '"tags":[["x",null],['))
                    .otherwise(text).alias("json"))
