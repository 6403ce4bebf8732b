"""Bulk construction of unsigned events from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.functions.events import event_id
from whisperlake.operators.attachments import attachment_to_tags
from whisperlake.schemas import KIND_CHAT, KIND_FILE, KIND_INBOX_LIST


def _p_tags(recipients: str) -> Column:
    return F.transform(recipients, lambda r: F.array(F.lit("p"), r))


def _event(df: DataFrame, pubkey: str, kind: int, tags: Column, content: Column, keep: list[str]) -> DataFrame:
    parts = df.select(
        *keep, F.col(pubkey).alias("pubkey"), "created_at", F.lit(kind).alias("kind"),
        tags.alias("tags"), content.alias("content"))
    return parts.select(
        *keep, event_id().alias("id"), "pubkey", "created_at", "kind", "tags", "content",
        F.lit(None).cast("string").alias("sig"))


def build_chat_events(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Chat messages from author, recipients, text, reply_to (may be null), created_at."""
    reply = F.when(F.col("reply_to").isNotNull(), F.array(
        F.array(F.lit("e"), F.col("reply_to"), F.lit(""), F.lit("reply")))).otherwise(
        F.array().cast("array<array<string>>"))
    return _event(df, "author", KIND_CHAT, F.concat(_p_tags("recipients"), reply), F.col("text"), list(keep))


def build_file_events(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """File messages from author, recipients, attachment, created_at."""
    tags = F.concat(_p_tags("recipients"), attachment_to_tags("attachment"))
    return _event(df, "author", KIND_FILE, tags, F.col("attachment.url"), list(keep))


def build_inbox_lists(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Inbox relay lists from pubkey, relays, created_at."""
    tags = F.transform("relays", lambda u: F.array(F.lit("relay"), u))
    return _event(df, "pubkey", KIND_INBOX_LIST, tags, F.lit(""), list(keep))
