"""The message table as a stream of changes: kept row by row, with a feed of what each batch changed."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from whisperlake.functions.text import packed, unpacked
from whisperlake.operators.changes import row_changes
from whisperlake.operators.messages import apply_message_changes
from whisperlake.streaming import log

_ROW = "id string, peer string, status string, alive boolean"
_CLEARED = "peer string"


def _alive(rows: DataFrame, cleared: DataFrame) -> DataFrame:
    """The last row of each id, where it still stands; ``cleared`` (peer, batch): all messages of a peer went in that batch."""
    short = rows.select("id", packed("peer").alias("peer"), "status", "alive", "batch")
    last = short.groupBy("id").agg(F.max_by(F.struct("peer", "status", "alive"), "batch").alias("r"), F.max("batch").alias("batch")).select("id", "r.*", "batch")
    gone = cleared.groupBy(packed("peer").alias("peer")).agg(F.max("batch").alias("cleared_at"))
    return last.join(gone, "peer", "left").filter("alive and (cleared_at is null or batch >= cleared_at)").select("id", unpacked("peer").alias("peer"), "status")


def apply_batch(batch: DataFrame, batch_id: int, path: str, on_change: Callable[[DataFrame, int], None] | None = None) -> None:
    """One batch of :func:`stream_messages`."""
    spark = batch.sparkSession
    log.settle(spark, f"{path}/rows", batch_id, _ROW, ["id"], newest=True)
    log.settle(spark, f"{path}/cleared", batch_id, _CLEARED, ["peer"], newest=False)
    ids = batch.select(F.explode(F.array_compact(F.array("id", "old_id"))).alias("id")).distinct()
    rows = log.before(spark, f"{path}/rows", batch_id, _ROW, ids, ["id"]).withColumn("peer", packed("peer"))
    rows = rows.join(ids, "id", "left_semi").withColumn("peer", unpacked("peer"))
    cleared = log.before(spark, f"{path}/cleared", batch_id, _CLEARED, rows.select("peer"), ["peer"])
    old = _alive(rows, cleared)
    new = apply_message_changes(old, batch).select("id", packed("peer").alias("peer"), "status", F.lit(True).alias("alive"))
    # Ids that are gone leave a row that says so.
    found = ids.join(new, "id", "left").select("id", unpacked("peer").alias("peer"), "status", F.coalesce("alive", F.lit(False)).alias("alive"))
    now = log.append(found, f"{path}/rows", batch_id)
    went = log.append(batch.filter("op = 'remove'").select("peer").distinct(), f"{path}/cleared", batch_id)
    if on_change is not None:
        moved = batch.filter("op = 'replace'").select("old_id", "id")
        changes = row_changes(old, now.filter("alive").drop("alive"), ["id"], moved)
        whole = went.select(F.lit(None).cast("string").alias("id"), F.lit("removed").alias("change"), F.lit(None).cast("string").alias("old_id"),
                            "peer", F.lit(None).cast("string").alias("status"))
        on_change(changes.unionByName(whole), batch_id)


def stream_messages(
    changes: DataFrame, path: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Folds a stream of change-log rows (seq, op, id, old_id, peer, status; see ``apply_message_changes``) into the message table at ``path``.

    Batches follow each other in the order of ``seq``. A batch reads the rows of the ids that it names, and appends their new versions;
    a removal of all messages of a peer is one row. ``on_change`` receives what a batch changed among the ids that it names, as rows (id, change,
    old_id, peer, status) with change added, updated, replaced or removed, and one row without id and status for each peer whose other messages went. A batch that runs
    again replaces its rows and reports the same changes.
    """
    return changes.writeStream.foreachBatch(partial(apply_batch, path=path, on_change=on_change)).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stored_messages(spark: SparkSession, path: str) -> DataFrame:
    """Message table of :func:`stream_messages`: id, peer, status."""
    return _alive(log.everything(spark, f"{path}/rows", _ROW), log.everything(spark, f"{path}/cleared", _CLEARED))
