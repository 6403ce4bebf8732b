"""Session settings that every plan in this library relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings. Event keys are heavily skewed (one conversation, relay or
# source may hold a third of the log), so adaptive execution must be allowed to split
# a hot join partition even when that costs one more exchange of partial aggregates.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure_session(spark: SparkSession) -> SparkSession:
    """Applies the runtime settings above; safe to call many times."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; where it is unset, one beside the session's tables.

    Both are shared by the driver and all executors. There is no machine-local choice: on a cluster each executor
    would write to its own disk, and reading back would miss files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return root.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new path (never reused) for tables and stream checkpoints of one run."""
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
