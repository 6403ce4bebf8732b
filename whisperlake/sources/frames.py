"""Relay frames, events and requests as JSON text: parsing and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whisperlake.functions.events import event_json
from whisperlake.functions.text import as_col, json_string, json_string_array, let, staged
from whisperlake.schemas import MAX_FRAME_BYTES

# Types the "tags" field may have: empty, empty tags only, or lists of texts (nulls fold into these).
_TAG_TYPES = ("ARRAY<VOID>", "ARRAY<ARRAY<VOID>>", "ARRAY<ARRAY<STRING>>")


# An event as it is read when every field has its type and no value is null, and the types that say so.
_PLAIN_EVENT = "struct<id:string,pubkey:string,created_at:bigint,kind:int,tags:array<array<string>>,content:string,sig:string>"
_PLAIN_TYPES = [
    f"OBJECT<content: STRING, created_at: BIGINT, id: STRING, kind: BIGINT, pubkey: STRING, {sig}tags: {tags}>"
    for sig in ("", "sig: STRING, ") for tags in _TAG_TYPES]


def _field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column) -> Column:
    """A text value; JSON null becomes ''. Null for any other type or a missing value."""
    return F.when(F.is_variant_null(v), "").when(_type(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _typed_text(v: Column, kind: Column) -> Column:
    """:func:`_text` of a value whose type is known."""
    return F.when(kind == "VOID", "").when(kind == "STRING", F.try_variant_get(v, "$", "string"))


def _whole(v: Column, kind: str) -> Column:
    """An integer in the range of ``kind``; a fraction or text gives null, unlike a plain cast."""
    return F.when(_type(v) == "BIGINT", F.try_variant_get(v, "$", kind))


def _event_struct(v: Column) -> Column:
    """Event struct of a variant, or null when it is no well-formed event."""

    def read(fields: Column) -> Column:
        get = lambda name: fields[name]
        tags = F.when(_type(get("tags")).isin(*_TAG_TYPES), F.try_variant_get(get("tags"), "$", "array<array<string>>"))
        signature = F.when(_type(get("sig")) == "STRING", F.try_variant_get(get("sig"), "$", "string"))
        return F.struct(
            _text(get("id")).alias("id"), _text(get("pubkey")).alias("pubkey"),
            _whole(get("created_at"), "bigint").alias("created_at"), _whole(get("kind"), "int").alias("kind"),
            F.transform(tags, lambda t: F.transform(t, lambda x: F.coalesce(x, F.lit("")))).alias("tags"),
            # Anything that is not a non-empty text counts as unsigned.
            _text(get("content")).alias("content"), F.nullif(signature, F.lit("")).alias("sig"))

    def complete(e: Column) -> Column:
        whole = ~F.exists(e["tags"], lambda t: t.isNull())
        for name in ("id", "pubkey", "created_at", "kind", "content"):
            whole = whole & e[name].isNotNull()
        return F.when(F.coalesce(whole, F.lit(False)), e)

    names = ("id", "pubkey", "created_at", "kind", "tags", "content", "sig")
    fields = F.struct(*[_field(v, f"$.{n}").alias(n) for n in names])
    # Anything but an object has no named fields, so it fails the test for missing ones.
    return let(let(fields, read), complete)


def _with_event(df: DataFrame, keep: list[str], v: str, kind: Column, json_col: str) -> DataFrame:
    """``keep`` plus ``event``: the event struct of the variant ``v`` of type ``kind``, found in the JSON text ``json_col``.

    Events of the plain types are read in one go; a text without "null" has no null in it. All others are read field by field.
    """
    plain = kind.isin(*_PLAIN_TYPES) & ~F.contains(F.col(json_col), F.lit("null"))
    read = staged(df, [*keep, v], [F.when(plain, F.try_variant_get(v, "$", _PLAIN_EVENT)).alias("_plain")])
    e = F.col("_plain")
    # A kind beyond its range was read as null.
    event = F.when(e["kind"].isNotNull(), e.withField("sig", F.nullif(e["sig"], F.lit("")))).when(
        F.col(v).isNotNull(), _event_struct(F.col(v)))
    return staged(read, keep, [event.alias("event")])


def read_events(df: DataFrame, json_col: str = "json", keep: list[str] = ()) -> DataFrame:
    """Adds ``event``: the event struct of a JSON text, or null when it is no well-formed event."""
    read = staged(df, [*keep, json_col], [F.try_parse_json(json_col).alias("_v")])
    return _with_event(read, [*keep, json_col], "_v", _type(F.col("_v")), json_col)


def parse_events(df: DataFrame, json_col: str = "json", keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine): rows that are no well-formed event keep their text in quarantine.

    Each result reads its input on its own; to store both from a large dump, write
    :func:`read_events` once and split that.
    """
    both = read_events(df, json_col, keep)
    return (
        both.filter("event is not null").select(*keep, "event.*"),
        both.filter("event is null").select(*keep, json_col),
    )


def events_to_json(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Compact JSON in fixed field order, one ``json`` column; write it with ``df.write.text``."""
    return df.select(*keep, event_json().alias("json"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """A dump of frames, one JSON array per line."""
    return spark.read.text(path)


def typed_frames(lines: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Reads every frame (``value``) once into typed columns; write it partitioned by ``verb`` for later use.

    Columns: verb, sub_id, event (struct), message_id, ack_ok, ack_text, text, and ``problem``: too
    large, not JSON, malformed event, malformed answer. Lines that are no known frame, or too
    short for their verb, are left out.
    """
    big = F.octet_length("value") > MAX_FRAME_BYTES
    read = staged(lines, [*keep, "value"], [big.alias("big"), F.when(~big, F.try_parse_json("value")).alias("v")])
    items = staged(read, [*keep, "value"], [
        F.when(F.col("big"), "too large").when(F.col("v").isNull(), "not JSON").alias("problem"),
        F.try_variant_get("v", "$", "array<variant>").alias("items")])
    # An item is present only if the value is an array that reaches it.
    item = lambda i: F.get("items", F.lit(i))
    # A verb of another type is written as no known verb.
    split = staged(items, [*keep, "value", "problem"], [
        F.when(item(1).isNotNull(), F.try_variant_get(item(0), "$", "string")).alias("verb"),
        item(1).alias("a"), item(2).alias("b"), item(3).alias("c"),
        *[_type(item(i)).alias(f"{name}_type") for i, name in ((1, "a"), (2, "b"), (3, "c"))]])

    verb = F.col("verb")
    three = F.col("b").isNotNull()
    text = lambda name: _typed_text(F.col(name), F.col(f"{name}_type"))
    optional = lambda name: F.when(F.col(name).isNull(), "").otherwise(text(name))
    flag = F.when(F.col("b_type") == "BOOLEAN", F.try_variant_get("b", "$", "boolean"))
    parts = staged(split, [*keep, "value", "problem", "verb"], [
        F.when(verb.isin("EVENT", "EOSE", "CLOSED"), text("a")).alias("sub_id"),
        F.when(verb == "EVENT", F.col("b")).alias("_v"), F.when(verb == "EVENT", F.col("b_type")).alias("_type"),
        F.when(verb == "OK", text("a")).alias("message_id"),
        F.when(verb == "OK", flag).alias("ack_ok"), F.when(verb == "OK", optional("c")).alias("ack_text"),
        F.when(verb == "CLOSED", optional("b")).when(verb.isin("AUTH", "NOTICE"), text("a")).alias("text"),
        three.alias("three"),
    ])
    names = [*keep, "value", "problem", "verb", "sub_id", "message_id", "ack_ok", "ack_text", "text", "three"]
    typed = _with_event(parts, names, "_v", F.col("_type"), "value")
    three = F.col("three")
    bad_event = (verb == "EVENT") & three & (F.col("event").isNull() | F.col("sub_id").isNull())
    bad_answer = (verb == "OK") & three & (
        F.col("message_id").isNull() | F.col("ack_ok").isNull() | F.col("ack_text").isNull())
    complete = (
        (verb.isin("EVENT", "OK") & three) | ((verb == "EOSE") & F.col("sub_id").isNotNull())
        | ((verb == "CLOSED") & F.col("sub_id").isNotNull() & F.col("text").isNotNull())
        | (verb.isin("AUTH", "NOTICE") & F.col("text").isNotNull())
    )
    problem = F.coalesce("problem", F.when(bad_event, "malformed event"), F.when(bad_answer, "malformed answer"))
    return (
        typed.filter(problem.isNotNull() | F.coalesce(complete, F.lit(False)))
        .select(*keep, "value", problem.alias("problem"), "verb", "sub_id", "event", "message_id", "ack_ok", "ack_text", "text")
    )


def parse_frames(lines: DataFrame, keep: list[str] = ()) -> dict[str, DataFrame]:
    """The tables in a dump of frames: events, eose, acks, closed, challenges, notices, quarantine.

    When several of them are needed from a large dump, write :func:`typed_frames` once and
    pass that table to :func:`split_frames` instead.
    """
    return split_frames(typed_frames(lines, keep), keep)


def split_frames(typed: DataFrame, keep: list[str] = ()) -> dict[str, DataFrame]:
    good = lambda verb: typed.filter((F.col("verb") == verb) & F.col("problem").isNull())
    return {
        "events": good("EVENT").select(*keep, "sub_id", "event.*"),
        "eose": good("EOSE").select(*keep, "sub_id"),
        "acks": good("OK").select(*keep, "message_id", "ack_ok", "ack_text"),
        "closed": good("CLOSED").select(*keep, "sub_id", "text"),
        "challenges": good("AUTH").select(*keep, F.col("text").alias("challenge")),
        "notices": good("NOTICE").select(*keep, "text"),
        "quarantine": typed.filter("problem is not null").select(*keep, "value", F.col("problem").alias("reason")),
    }


def typed_subscriptions(lines: DataFrame) -> DataFrame:
    """REQ frames (``value``) to one row per filter with ``problem``: null, or the first part that is malformed.

    A part of the wrong type never reads as "no constraint", which would widen the filter: such a filter has no place among
    the others. An absent or JSON-null part is no constraint.
    """
    read = lines.select(F.try_parse_json("value").alias("v"))
    frames = read.select(
        _text(_field(F.col("v"), "$[0]")).alias("verb"), _text(_field(F.col("v"), "$[1]")).alias("sub_id"),
        F.try_variant_get("v", "$", "array<variant>").alias("items"),
    ).filter("verb = 'REQ' and sub_id is not null")
    filters = frames.select(
        "sub_id", F.posexplode(F.slice("items", F.lit(3), F.greatest(F.size("items") - 2, F.lit(0)))).alias("filter_no", "f"))
    keys = F.try_variant_get("f", "$", "map<string,variant>")
    tag_parts = F.map_filter(keys, lambda k, v: k.startswith("#") & ~F.is_variant_null(v))
    part = lambda name: _field(F.col("f"), f"$.{name}")
    given = lambda name: part(name).isNotNull() & ~F.is_variant_null(part(name))

    def listing(v: Column, item: str) -> Column:
        return _type(v).isin(f"ARRAY<{item}>", "ARRAY<VOID>") & F.coalesce(~F.exists(
            F.try_variant_get(v, "$", "array<variant>"), F.is_variant_null), F.lit(False))

    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    kinds_fit = ~F.exists(F.try_variant_get(part("kinds"), "$", "array<bigint>"), lambda k: ~k.between(-2**31, 2**31 - 1))
    problem = F.when(bad(_type(F.col("f")).startswith("OBJECT")), "filter")
    for name in ("ids", "authors"):
        problem = problem.when(given(name) & bad(listing(part(name), "STRING")), name)
    problem = problem.when(given("kinds") & bad(listing(part("kinds"), "BIGINT") & kinds_fit), "kinds")
    problem = problem.when(F.exists(F.map_values(tag_parts), lambda v: bad(listing(v, "STRING"))), "tags")
    for name, kind in (("since", "bigint"), ("until", "bigint"), ("limit", "int")):
        problem = problem.when(given(name) & _whole(part(name), kind).isNull(), name)
    tags = F.transform_values(
        F.transform_keys(tag_parts, lambda k, _: F.substring(k, F.lit(2), F.length(k))),
        lambda _, v: F.try_variant_get(v, "$", "array<string>"))
    get = lambda name, kind: F.try_variant_get("f", f"$.{name}", kind)
    return filters.withColumn("tags", tags).select(
        "sub_id", "filter_no", get("ids", "array<string>").alias("ids"), get("authors", "array<string>").alias("authors"),
        get("kinds", "array<int>").alias("kinds"), F.when(F.size("tags") > 0, F.col("tags")).alias("tags"),
        get("since", "bigint").alias("since"), get("until", "bigint").alias("until"), get("limit", "int").alias("lim"),
        problem.alias("problem"), F.to_json("f").alias("source"))


def parse_subscriptions(lines: DataFrame) -> DataFrame:
    """REQ frames (``value``) to one row per well-formed (sub_id, filter_no); an absent part is null (no constraint)."""
    return typed_subscriptions(lines).filter("problem is null").drop("problem", "source")


def quarantined_subscriptions(lines: DataFrame) -> DataFrame:
    """The filters that :func:`parse_subscriptions` leaves out, with the malformed part as ``problem`` and their JSON as ``source``."""
    return typed_subscriptions(lines).filter("problem is not null").select("sub_id", "filter_no", "problem", "source")


def subscription_json(sub_id: str | Column = "sub_id") -> Column:
    """REQ frame of one filter row (ids, authors, kinds, tags, since, until, lim), fixed key order."""

    def part(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), value)

    texts = lambda c: json_string_array(F.col(c))
    numbers = F.concat(F.lit("["), F.array_join(F.transform("kinds", lambda k: k.cast("string")), ","), F.lit("]"))
    tag_parts = F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat(
        json_string(F.concat(F.lit("#"), e["key"])), F.lit(":"), json_string_array(e["value"]))), ",")
    body = F.concat_ws(
        ",", part("ids", texts("ids")), part("authors", texts("authors")), part("kinds", numbers),
        F.when(F.size("tags") > 0, tag_parts), part("since", F.col("since").cast("string")),
        part("until", F.col("until").cast("string")), part("limit", F.col("lim").cast("string")))
    return F.concat(F.lit('["REQ",'), json_string(as_col(sub_id)), F.lit(",{"), body, F.lit("}]"))
