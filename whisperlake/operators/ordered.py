"""Ordered neighbours and running sums that never put a whole hot key into one task.

A window over ``partitionBy(key)`` sorts all rows of a key in one task. Here rows are first
split by (key, bucket), where the bucket is a coarse, order-preserving part of the sort key: an
hour, or one of the ranges of about equal size that ``in_range_buckets`` makes. Only one small summary row per bucket is then ordered per key, and its
result is joined back on (key, bucket), which the large side is already partitioned by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(order: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def in_buckets(df: DataFrame, bucket: Column) -> DataFrame:
    """``df`` with the column ``_bucket``, which the functions here share: rows are then dealt by (keys, bucket) once for all of them."""
    return df.withColumn("_bucket", bucket)


# Rows of a key from which on it is split, and about the rows of each of its ranges.
BUCKET_ROWS = 1 << 18
_HOUR = 3600


def in_range_buckets(df: DataFrame, keys: list[str], time: str, tie: str, rows: int | None = None) -> DataFrame:
    """``df`` with ``_bucket``: 0 for keys of up to ``rows`` rows, else the number of a range of about ``rows`` rows in the order (``time``, ``tie``).

    The ranges come from a summary of counts that adds up over tasks and is exact, so it is the same whenever it is computed: rows of each (key, hour), and, for
    hours of split keys that hold more than half a range, of each (second, first two characters of ``tie``). Rows of one second and one such
    beginning stay together. Only hours of split keys are joined to the rows; whether there are any is asked first, by a count over keys and hours.
    """
    rows = rows or BUCKET_ROWS
    hour, fine = F.floor(F.col(time) / _HOUR), F.struct(F.col(time).alias("at"), F.substring(F.col(tie).cast("string"), 1, 2).alias("begin"))
    dealt = df.withColumn("_hour", hour)
    own = Window.partitionBy(*keys)
    hours = dealt.groupBy(*keys, "_hour").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(own)).filter(F.col("total") > rows)
    if hours.isEmpty():
        return df.withColumn("_bucket", F.lit(0).cast("bigint"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.withColumn("base", before(own.orderBy("_hour")))
    number = F.floor(F.col("base") / rows)
    dense = hours.filter(F.col("n") > rows / 2).select(*keys, "_hour", "base")
    whole = hours.filter(F.col("n") <= rows / 2).select(*keys, "_hour", F.array(F.struct(
        F.lit(None).cast(f"struct<at:{dict(df.dtypes)[time]},begin:string>").alias("since"), number.alias("no"))).alias("ranges"))
    cells = dealt.withColumn("_cell", fine).join(dense, [*keys, "_hour"]).groupBy(*keys, "_hour", "base", "_cell").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy(*keys, "_hour").orderBy("_cell")
    cells = cells.withColumn("no", F.floor((F.col("base") + before(inside)) / rows))
    cuts = cells.withColumn("last", F.lag("no").over(inside)).filter(F.col("last").isNull() | (F.col("no") != F.col("last")))
    # As many entries as the hour has ranges.
    split = cuts.groupBy(*keys, "_hour").agg(F.collect_list(F.struct(F.col("_cell").alias("since"), "no")).alias("ranges"))
    found = dealt.join(whole.unionByName(split), [*keys, "_hour"], "left")
    reached = F.filter("ranges", lambda r: r["since"].isNull() | (r["since"] <= fine))
    return found.withColumn("_bucket", F.coalesce(F.array_max(F.transform(reached, lambda r: r["no"])), F.lit(0))).select(*df.columns, "_bucket")


def with_last(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the last value of ``value`` that isn't null, in ``order`` within ``keys`` up to the row itself. ``_bucket`` stays."""
    near = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = df.withColumn("_near", F.last(value, ignorenulls=True).over(near.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_last", F.lead(F.lit(True)).over(near).isNull())
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = local.filter("_last").select(*keys, "_bucket", F.last("_near", ignorenulls=True).over(before).alias("_far"))
    joined = local.join(carried, [*keys, "_bucket"], "left")
    return joined.select(*df.columns, F.coalesce("_near", "_far").alias(name))


def with_neighbour(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], prefix: str, following: bool = False,
) -> DataFrame:
    """Adds ``<prefix><value>`` of the row before (or after) in ``order`` within ``keys``; null at the edge.

    The last row of each bucket, which the next bucket needs, is read off the same ordered rows. ``_bucket`` stays.
    """
    near = Window.partitionBy(*keys, "_bucket").orderBy(*_order(order, following))
    local = df.withColumn("_near", F.lag(F.struct(*values)).over(near)).withColumn("_last", F.lead(F.lit(True)).over(near).isNull())

    edges = local.filter("_last").select(*keys, "_bucket", F.struct(*values).alias("_edge"))
    far = Window.partitionBy(*keys).orderBy(*_order(["_bucket"], following))
    carried = edges.select(*keys, "_bucket", F.lag("_edge").over(far).alias("_far"))

    joined = local.join(carried, [*keys, "_bucket"], "left")
    found = F.coalesce("_near", "_far")
    return joined.select(*df.columns, *[found[v].alias(f"{prefix}{v}") for v in values])


def with_running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the running sum of ``value`` in ``order`` within ``keys``, the row itself included. ``_bucket`` stays."""
    near = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = df.withColumn("_near", F.sum(value.cast("bigint")).over(near.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_last", F.lead(F.lit(True)).over(near).isNull())

    # The last row of a bucket has the bucket's sum.
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.filter("_last").select(*keys, "_bucket", F.sum("_near").over(before).alias("_far"))

    joined = local.join(offsets, [*keys, "_bucket"], "left")
    return joined.select(*df.columns, (F.col("_near") + F.coalesce("_far", F.lit(0))).alias(name))
