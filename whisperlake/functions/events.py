"""Event-level expressions: tags, canonical form, content-addressed id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.functions.text import as_col, is_lower_hex, lower_escapes, quoted


def tag_values(tags: str | Column, name: str | Column) -> Column:
    """Second element of every tag called ``name`` that has one, in order."""
    hits = F.filter(as_col(tags), lambda t: (F.size(t) >= 2) & (F.get(t, F.lit(0)) == name))
    return F.transform(hits, lambda t: F.get(t, F.lit(1)))


def first_tag(tags: str | Column, name: str) -> Column:
    return F.get(tag_values(tags, name), F.lit(0))


def canonical_json(pubkey, created_at, kind, tags, content) -> Column:
    """The array text an event id is hashed over."""
    return lower_escapes(F.concat(
        F.lit("[0,"), quoted(pubkey), F.lit(","), as_col(created_at).cast("string"), F.lit(","),
        as_col(kind).cast("string"), F.lit(","), F.to_json(as_col(tags)), F.lit(","), quoted(content), F.lit("]"),
    ))


def event_id(pubkey="pubkey", created_at="created_at", kind="kind", tags="tags", content="content") -> Column:
    return F.sha2(canonical_json(pubkey, created_at, kind, tags, content).cast("binary"), 256)


def with_event_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", event_id())


def has_valid_id() -> Column:
    """Shape tests first: they are far cheaper than hashing, and AND stops early."""
    return is_lower_hex("id", 32) & is_lower_hex("pubkey", 32) & (F.col("id") == event_id())


def event_json(sig: bool = True) -> Column:
    """Compact JSON object in fixed field order; ``sig`` only where present."""
    parts = [
        F.lit('{"id":'), quoted("id"), F.lit(',"pubkey":'), quoted("pubkey"),
        F.lit(',"created_at":'), F.col("created_at").cast("string"),
        F.lit(',"kind":'), F.col("kind").cast("string"),
        F.lit(',"tags":'), F.to_json("tags"), F.lit(',"content":'), quoted("content"),
    ]
    if sig:
        parts.append(F.coalesce(F.concat(F.lit(',"sig":'), quoted("sig")), F.lit("")))
    return lower_escapes(F.concat(*parts, F.lit("}")))


def participants(tags: str | Column, pubkey: str | Column, me: str | Column) -> Column:
    """Everyone named in ``p`` tags plus the author, without ``me``, distinct and sorted."""
    me, everyone = as_col(me), F.array_append(tag_values(tags, "p"), as_col(pubkey))
    return F.array_sort(F.array_distinct(F.filter(everyone, lambda p: p != me)))
