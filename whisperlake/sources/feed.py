"""The live inbox feed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from whisperlake.schemas import EVENT


def stream_events(
    spark: SparkSession, path: str, schema: T.StructType = EVENT, files_per_batch: int | None = None,
    glob: str = "*.parquet",
) -> DataFrame:
    """Event files as a stream: first what is stored, then what is added.

    Run it with ``trigger(availableNow=True)`` for the stored part only.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def since(events: DataFrame, bound: int | None) -> DataFrame:
    """Restart filter: skip what lies before the catch-up bound."""
    return events if bound is None else events.filter(F.col("created_at") >= bound)
