"""Stored blobs as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whisperlake.operators.attachments import DOWNLOAD_SLACK_BYTES, address_blobs
from whisperlake.schemas import MAX_ATTACHMENT_BYTES


def read_blobs(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under ``path`` keyed by the SHA-256 of their bytes: url (file name), length, content, sha256.

    The length filter reaches the file listing, so oversized files are never read: they are rows with their length and neither content nor
    hash. Empty files give no row; they are never stored, because an empty file is refused when it is sent.
    """
    most = MAX_ATTACHMENT_BYTES + DOWNLOAD_SLACK_BYTES
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    fit = files.filter(F.col("length") <= most).select(F.col("path").alias("url"), "length", "content")
    large = files.filter(F.col("length") > most).select(F.col("path").alias("url"), "length", F.lit(None).cast("binary").alias("content"))
    return address_blobs(fit.unionByName(large))
