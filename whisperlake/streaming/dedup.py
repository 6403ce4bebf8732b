"""Removal of repeated events from a stream, exact over its whole life."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from whisperlake.streaming import log


def stream_dedup(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends every event whose id was not seen before to ``path``: each id exactly once, however late its first copy comes.

    A batch drops repeats within itself and those of earlier batches, whose ids are read from the parts that the batch
    touches. A batch that runs again after a failure replaces its own rows. ``trigger`` is passed to the stream
    (default: the stored part, then stop).
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in events.dtypes)

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log.settle(spark, path, batch_id, schema, ["id"])
        fresh = batch.dropDuplicates(["id"])
        seen = log.before(spark, path, batch_id, "id string", batch, ["id"])
        log.append(fresh.join(seen, "id", "left_anti").select(batch.columns), path, batch_id)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def deduplicated(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`stream_dedup` has let through so far."""
    return log.everything(spark, path).drop("batch")
