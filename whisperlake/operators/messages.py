"""The message table: fold of the change log, uploads, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.functions.events import first_tag
from whisperlake.functions.text import packed, unpacked
from whisperlake.operators.build import build_file_events
from whisperlake.schemas import FAILED
from whisperlake.session import work_dir


def apply_message_changes(state: DataFrame, log: DataFrame) -> DataFrame:
    """Folds an ordered change log into the message table.

    state: id, peer, status; log: seq (>= 0), op, id, old_id, peer, status. Ops: add (if absent),
    update (if present), replace (``old_id`` becomes ``id``; adds it if neither exists; nothing
    if only the new one exists), remove (all messages of the peer). A placeholder id is replaced
    once and not used again.

    The row of an id is its first add or replacement after the last removal, overwritten by
    later updates. That is a plain aggregation by id. Peers that are hex travel in half the bytes.
    """
    cols = ["seq", "op", "id", "old_id", "peer", "status"]
    stored = state.select(
        F.lit(-1).cast("bigint").alias("seq"), F.lit("add").alias("op"), "id",
        F.lit(None).cast("string").alias("old_id"), "peer", "status")
    # Removals are few; they are stored first, so that Spark knows their size before it plans how the log meets them.
    removed = log.filter("op = 'remove'").groupBy("peer").agg(F.max("seq").alias("removed_at"))
    path = work_dir(log.sparkSession, "removals")
    removed.write.parquet(path)
    removed = log.sparkSession.read.schema("peer string, removed_at long").parquet(path)
    live = stored.unionByName(log.filter("op <> 'remove'").select(*cols)).join(removed, "peer", "left").filter(
        F.col("seq") > F.coalesce("removed_at", F.lit(-2))).select(*cols)

    seq, op = F.col("seq"), F.col("op")
    # A replacement concerns two ids: for the old one it is the moment it goes away.
    sides = F.array_compact(F.array(
        F.struct("id", op.alias("op"), F.lit(None).cast("string").alias("new_id")),
        F.when(op == "replace", F.struct(F.col("old_id").alias("id"), F.lit("gone").alias("op"), F.col("id").alias("new_id"))),
    ))
    by_id = live.select("seq", packed("peer").alias("peer"), "status", F.explode(sides).alias("s")).select("seq", "peer", "status", "s.*")
    value = F.struct("seq", "peer", "status")
    per_id = by_id.groupBy("id").agg(
        F.min(F.when(op.isin("add", "replace"), value)).alias("first"),
        F.max(F.when(op == "update", value)).alias("updated"),
        F.min(F.when(op == "add", seq)).alias("add_seq"),
        F.min(F.when(op == "gone", F.struct("seq", "peer", "status", "new_id"))).alias("gone"),
    )
    # A placeholder that existed hands its place to the new id, even if that id exists already.
    handed = F.coalesce(F.col("add_seq") < F.col("gone.seq"), F.lit(False))
    own = F.when(~handed & F.col("first").isNotNull(), F.struct(
        "id", F.greatest("first", F.when(F.col("updated.seq") > F.col("first.seq"), F.col("updated"))).alias("value")))
    placed = F.when(handed, F.struct(
        F.col("gone.new_id").alias("id"), F.struct("gone.seq", "gone.peer", "gone.status").alias("value")))
    rows = per_id.select(F.explode(F.array_compact(F.array(own, placed))).alias("r"))
    return rows.groupBy("r.id").agg(F.max("r.value").alias("v")).select("id", unpacked("v.peer").alias("peer"), "v.status")


def pending_uploads(files: DataFrame, uploads: DataFrame) -> DataFrame:
    """File messages before and after upload: placeholder id, then the id of the finished event.

    files: author, recipients, created_at, attachment (url empty); uploads: file_id (the
    encrypted hash), primary_url, fallbacks. Without any accepted copy the placeholder stays
    and the message is Failed.
    """
    sha = F.col("attachment.encrypted_sha256")
    done = files.withColumn("file_id", sha).join(
        uploads.select("file_id", "primary_url", F.col("fallbacks").alias("mirrors")), "file_id", "left")
    with_url = done.withColumn("attachment", F.when(
        F.col("primary_url").isNotNull(),
        F.col("attachment").withField("url", F.col("primary_url")).withField("fallbacks", F.col("mirrors")),
    ).otherwise(F.col("attachment")))
    built = build_file_events(with_url, keep=["file_id", "primary_url"])
    uploaded = F.col("primary_url").isNotNull()
    return built.select(
        F.concat(F.lit("upload-"), F.col("file_id")).alias("old_id"),
        F.when(uploaded, F.col("id")).otherwise(F.concat(F.lit("upload-"), F.col("file_id"))).alias("id"),
        "created_at", F.when(uploaded, "Sending").otherwise(FAILED).alias("status"),
    )


def reply_target(tags: str | Column = "tags") -> Column:
    """Value of the first ``e`` tag, whatever its marker."""
    return first_tag(tags, "e")


def resolve_replies(messages: DataFrame) -> DataFrame:
    """Adds the parent's author and text where the parent is known. Messages without a parent each have a key of their own in the join, so they don't meet in one task."""
    parents = messages.select(
        F.col("id").alias("_parent"), F.col("author").alias("parent_author"), F.col("text").alias("parent_text"))
    replies = messages.withColumn("reply_to", reply_target())
    key = F.coalesce("reply_to", F.concat(F.lit("\0"), F.col("id")))
    found = replies.withColumn("_key", key).join(parents, F.col("_key") == F.col("_parent"), "left").drop("_key", "_parent")
    return found.select("reply_to", *[c for c in found.columns if c != "reply_to"])
