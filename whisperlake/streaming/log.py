"""Keyed tables that a stream appends to.

Each batch writes one folder. Once ``FRESH`` batches have come together they are merged, with those older folders that are not much larger, into one
folder that is sorted and dealt into parts by a hash of the keys; parts are as many as keep ``PART_ROWS`` rows in each. A batch then reads the
fresh folders and, of the few merged ones, only the parts that its own keys fall into, however long the stream has run.

A manifest (one small file of rows) names the merged folders that count from some batch on. It is written last, so a merge that is cut off leaves a
folder that nobody reads, and its batches are read from their own folders as before.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Batches that are read one by one before they are merged.
FRESH = 8
# A merge takes in the newest merged folder while that has at most so many times the rows that have come together.
GROWTH = 4
PART_ROWS = 1 << 20
# More touched parts than this are read without naming them.
_NAMED_PARTS = 10_000
_MANIFEST = "at long, version string, folder string, last long, parts long, n long"


def _part(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts))


def _folders(spark: SparkSession, path: str, batch_id: int) -> list[Row]:
    """The merged folders that count for a batch, oldest first; a handful, as their sizes grow by a factor."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifests").filter(F.col("at") <= batch_id)
        top = rows.agg(F.max(F.struct("at", "version")).alias("m")).first().m
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    if top is None:
        return []
    found = rows.filter((F.col("at") == top.at) & (F.col("version") == top.version)).collect()
    return sorted(found, key=lambda r: r.last)


def _fresh(spark: SparkSession, path: str, schema: str, after: int, batch_id: int) -> DataFrame:
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/fresh")
    return rows.filter((F.col("batch") > after) & (F.col("batch") < batch_id))


def append(rows: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Writes a batch's rows and reads them again. A batch that runs again replaces what it wrote."""
    target = f"{path}/fresh/batch={batch_id}"
    rows.write.option("compression", "zstd").mode("overwrite").parquet(target)
    return rows.sparkSession.read.schema(rows.schema).parquet(target)


def settle(spark: SparkSession, path: str, batch_id: int, schema: str, keys: list[str], newest: bool = False) -> None:
    """Merges batches before ``batch_id`` if enough have come together. With ``newest`` only a key's row of its last batch is kept.

    Called at the beginning of a batch, when all earlier ones are complete; one that runs again merges again, or finds it done.
    """
    folders = _folders(spark, path, batch_id)
    after = folders[-1].last if folders else -1
    if batch_id - 1 - after < FRESH:
        return
    rows = _fresh(spark, path, schema, after, batch_id)
    n = rows.count()
    while folders and folders[-1].n <= GROWTH * max(n, 1):
        last = folders.pop()
        n += last.n
        rows = rows.unionByName(_merged(spark, path, last, schema))
    if newest:
        names = [c for c in rows.columns if c not in (*keys, "batch")]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("r"), F.max("batch").alias("batch")).select(*keys, "r.*", "batch")
    parts = 1 << max(0, (n // PART_ROWS)).bit_length()
    name = uuid.uuid4().hex
    dealt = rows.withColumn("part", _part(keys, parts)).repartition(min(parts, 200), "part").sortWithinPartitions("part", *keys)
    dealt.write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/merged/{name}")
    kept = [(r.folder, r.last, r.parts, r.n) for r in folders] + [(name, batch_id - 1, parts, n)]
    version = uuid.uuid4().hex
    spark.createDataFrame([(batch_id, version, *r) for r in kept], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifests")


def _merged(spark: SparkSession, path: str, folder: Row, schema: str, parts: list[int] | None = None) -> DataFrame:
    rows = spark.read.schema(f"{schema}, batch long, part long").parquet(f"{path}/merged/{folder.folder}")
    if parts is not None:
        rows = rows.filter(F.col("part").isin(parts))
    return rows.drop("part")


def before(spark: SparkSession, path: str, batch_id: int, schema: str, touched: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (columns ``schema``, and ``batch``) of earlier batches among which all rows with the keys of ``touched`` are."""
    if batch_id == 0:
        return spark.createDataFrame([], f"{schema}, batch long")
    folders = _folders(spark, path, batch_id)
    found = [_fresh(spark, path, schema, folders[-1].last if folders else -1, batch_id)]
    for f in folders:
        some = touched.select(_part(keys, f.parts).alias("part")).distinct().limit(_NAMED_PARTS + 1).collect()
        found.append(_merged(spark, path, f, schema, [r.part for r in some] if len(some) <= _NAMED_PARTS else None))
    return reduce(DataFrame.unionByName, found)


def everything(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All rows with their ``batch``; ``schema`` is needed where the fresh folders hold nothing to infer it from."""
    top = 1 << 62
    schema = schema or ", ".join(f"`{n}` {t}" for n, t in spark.read.parquet(f"{path}/fresh").drop("batch").dtypes)
    folders = _folders(spark, path, top)
    return reduce(DataFrame.unionByName, [
        _fresh(spark, path, schema, folders[-1].last if folders else -1, top), *(_merged(spark, path, f, schema) for f in folders)])
