"""Tables that cut lineage, in the shared folder, and what Python workers need."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whisperlake.session import work_dir


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: later steps survive lost executors and reuse the work."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Bytes of rows that a Python worker gets at a time. Spark's default is eight times as much, several copies of which
# may be in use at once in each worker and its executor.
_BATCH_BYTES = 8 << 20


def share_package(spark: SparkSession) -> None:
    """Prepares a session for this package's Python workers: bounded batches, and a search path on which they find it.

    The path is the driver's own. On a cluster the package is installed, or shipped with ``--py-files``; there it changes nothing.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


@cache
def _set_aside() -> None:
    """Takes what is there when a process first hands memory back, nearly all of it modules, out of later collections: going through it takes
    some 50 ms, twice a task."""
    gc.collect()
    gc.freeze()


def give_back() -> None:
    """Hands memory that a Python worker no longer uses to the system: workers live on and serve the stages that follow."""
    _set_aside()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def tidy(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] = lambda: None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` (of ``mapInArrow``), with unused memory handed back at the end of each task, after ``forget``, and before it: functions on columns
    that the worker ran earlier hand back nothing themselves."""
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            forget()
            give_back()

    return held


def unused(name: str, df: DataFrame) -> str:
    """``name``, with marks behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drawn(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """At most ``most`` of ``rows``, those with the smallest hashes of the first of the columns ``key`` (ties by all of them).

    Their number is counted first, and only hashes under a bound that about a quarter more than ``most`` rows pass are sorted: all tasks
    together send little more than the result.
    """
    value = F.xxhash64(key[0])
    n = rows.count()
    enough = 5 * most // 4 + 100
    if n > 2 * enough:
        rows = rows.filter(value < F.lit((1 << 64) * enough // n - (1 << 63)))
    return rows.orderBy(value, *key).limit(most)


# Largest table, in bytes, that is sent to all executors instead of shuffling the other side of a join.
BROADCAST_BYTES = 32 << 20


def sent_if_small(table: DataFrame, row_bytes: Column | int) -> DataFrame:
    """``table`` (stored) with a broadcast hint if its measured size allows, else as it is: then the join shuffles both sides."""
    size = table.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table
