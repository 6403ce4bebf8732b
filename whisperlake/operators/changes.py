"""Row-level differences between two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADDED, UPDATED, REMOVED, REPLACED = "added", "updated", "removed", "replaced"


def row_changes(before: DataFrame, after: DataFrame, keys: list[str], replaced: DataFrame | None = None) -> DataFrame:
    """The rows of ``after`` that are new or differ from ``before`` (same columns, unique keys), and the rows of ``before`` that are gone, with ``change``.

    ``replaced`` (old_id, id; for tables keyed by id) says which rows may have taken the place of which: where the old row is gone and
    the new one has come, this is one change ``replaced`` with its ``old_id`` (null in all others) instead of two.
    """
    names = [c for c in after.columns if c not in keys]
    old = before.select(*keys, F.struct(F.lit(True).alias("is"), *names).alias("_old"))
    new = after.select(*keys, F.struct(F.lit(True).alias("is"), *names).alias("_new"))
    both = old.join(new, keys, "full_outer")
    change = (F.when(F.col("_old").isNull(), ADDED).when(F.col("_new").isNull(), REMOVED)
              .when(F.col("_old") != F.col("_new"), UPDATED))
    found = both.select(*keys, change.alias("change"), F.coalesce("_new", "_old").alias("_row")).filter("change is not null")
    if replaced is None:
        return found.select(*keys, "change", F.lit(None).cast("string").alias("old_id"), *(F.col(f"_row.{c}") for c in names))
    gone, come = (found.filter(F.col("change") == c).select("id") for c in (REMOVED, ADDED))
    pairs = replaced.select("old_id", "id").distinct().join(gone.withColumnRenamed("id", "old_id"), "old_id", "left_semi").join(come, "id", "left_semi")
    # An old row has one successor, a new row one predecessor.
    pairs = pairs.groupBy("old_id").agg(F.min("id").alias("id")).groupBy("id").agg(F.min("old_id").alias("old_id"))
    marked = found.join(pairs, "id", "left").join(pairs.select(F.col("old_id").alias("id"), F.lit(True).alias("_left")), "id", "left")
    return marked.filter("not (change = 'removed' and _left is not null)").select(
        *keys, F.when(F.col("old_id").isNotNull() & (F.col("change") == ADDED), REPLACED).otherwise(F.col("change")).alias("change"), "old_id",
        *(F.col(f"_row.{c}") for c in names))
