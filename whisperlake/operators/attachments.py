"""File messages: reading and writing their tags, fetching, verifying and opening blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.functions.events import first_tag, tag_values
from whisperlake.functions.text import as_col, is_hex, is_lower_hex, plain_decimal
from whisperlake.functions.urls import WEB_SCHEMES, canonical_web_url, is_absolute_url, url_host
from whisperlake.schemas import KIND_FILE, MAX_ATTACHMENT_BYTES

ALGORITHM = "aes-gcm"
# Encrypted files may exceed the limit on plain files by this much.
DOWNLOAD_SLACK_BYTES = 1024
_FLOAT = r"\A\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z"
_INTEGER = r"\A\s*[+-]?[0-9]+\s*\z"


def attachment_from_event(tags: str = "tags", content: str = "content", kind: str = "kind") -> Column:
    """Attachment struct of a file message, or null when it cannot be opened."""
    tag = lambda name: first_tag(tags, name)
    size, duration = tag("size"), tag("duration")
    readable = (
        (F.col(kind) == KIND_FILE)
        & is_absolute_url(content, WEB_SCHEMES)
        & F.coalesce(F.lower(tag("encryption-algorithm")) == ALGORITHM, F.lit(False))
        & is_hex(tag("decryption-key"))
        & is_hex(tag("decryption-nonce"))
        & is_lower_hex(F.lower(tag("x")), 32)
    )
    mime = tag("file-type")
    return F.when(readable, F.struct(
        canonical_web_url(content).alias("url"),
        F.filter(tag_values(tags, "fallback"), lambda u: is_absolute_url(u, WEB_SCHEMES)).alias("fallbacks"),
        F.when(mime != "", F.lower(mime)).otherwise(F.lit("application/octet-stream")).alias("mime"),
        F.lower(tag("decryption-key")).alias("key"),
        F.lower(tag("decryption-nonce")).alias("nonce"),
        F.lower(tag("x")).alias("encrypted_sha256"),
        F.lower(tag("ox")).alias("plain_sha256"),
        F.coalesce(F.when(size.rlike(_INTEGER), size.try_cast("bigint")), F.lit(0).cast("bigint")).alias("size"),
        tag("dim").alias("dimensions"),
        F.when(duration.rlike(_FLOAT), duration.try_cast("double")).alias("duration_seconds"),
    ))


def attachment_to_tags(attachment: str | Column) -> Column:
    """Tags of a file message in fixed order; optional ones left out when unknown."""
    a = as_col(attachment)
    pair = lambda name, value: F.array(F.lit(name), value)
    optional = lambda name, value, keep: F.when(keep, pair(name, value))
    fixed = F.array(
        pair("file-type", a["mime"]),
        pair("encryption-algorithm", F.lit(ALGORITHM)),
        pair("decryption-key", a["key"]),
        pair("decryption-nonce", a["nonce"]),
        pair("x", a["encrypted_sha256"]),
        optional("ox", a["plain_sha256"], a["plain_sha256"].isNotNull()),
        optional("size", a["size"].cast("string"), a["size"] > 0),
        optional("dim", a["dimensions"], a["dimensions"].isNotNull()),
        optional("duration", plain_decimal(a["duration_seconds"], 3), a["duration_seconds"].isNotNull()),
    )
    return F.concat(F.array_compact(fixed), F.transform(a["fallbacks"], lambda u: pair("fallback", u)))


def blob_locations(attachments: DataFrame, servers: str | Column) -> DataFrame:
    """Candidate urls per file in the order to try: url, fallbacks, then every configured server."""
    a = F.col("attachment")
    own = F.array_distinct(F.concat(F.array(a["url"]), a["fallbacks"]))
    mirrors = F.transform(as_col(servers), lambda s: F.concat(F.rtrim(s, F.lit("/")), F.lit("/"), a["encrypted_sha256"]))
    return attachments.select(
        "file_id", a["encrypted_sha256"].alias("expected_sha256"),
        F.posexplode(F.concat(own, mirrors)).alias("pos", "url"),
    )


def verify_blobs(blobs: DataFrame, max_bytes: int = MAX_ATTACHMENT_BYTES + DOWNLOAD_SLACK_BYTES) -> DataFrame:
    """Adds ``verdict``: ok, too large, or tampered. Oversized bytes are never hashed; of these a ``length`` is enough."""
    n = F.octet_length("content")
    if "length" in blobs.columns:
        n = F.coalesce("length", n)
    return blobs.withColumn(
        "verdict",
        F.when(n > max_bytes, "too large")
        .when(F.sha2("content", 256) == F.col("expected_sha256"), "ok")
        .otherwise("tampered"),
    )


def address_blobs(blobs: DataFrame) -> DataFrame:
    """Keys stored bytes by their SHA-256."""
    return blobs.withColumn("sha256", F.sha2("content", 256))


def fetch_blobs(
    locations: DataFrame, blobs: DataFrame, max_bytes: int = MAX_ATTACHMENT_BYTES + DOWNLOAD_SLACK_BYTES
) -> DataFrame:
    """First location of each file whose bytes fit and have the expected hash; null when none has.

    Bytes are hashed where they are stored, so only hashes are shuffled, never contents.
    """
    stored = blobs.filter(F.octet_length("content") <= max_bytes).select("url", F.sha2("content", 256).alias("sha256"))
    # One location per file is enough to know the file even when no server has it.
    tried = locations.join(stored, "url", "left").withColumn(
        "good", F.col("sha256").eqNullSafe(F.col("expected_sha256"))
    )
    return tried.groupBy("file_id").agg(
        F.min(F.when(F.col("good"), F.struct("pos", "url"))).alias("hit")
    ).select("file_id", F.col("hit.pos").alias("pos"), F.col("hit.url").alias("url"))


def decrypt_blobs(blobs: DataFrame) -> DataFrame:
    """Opens AES-GCM bytes (``content``, hex ``key`` and ``nonce``); adds ``plain`` and ``failure``.

    Spark's cipher takes a 12-byte nonce in front of data and tag; longer nonces are reported.
    """
    key, nonce = F.unhex("key"), F.unhex("nonce")
    key_ok = F.octet_length(key).isin(16, 24, 32)
    opened = F.when(
        F.coalesce(key_ok & (F.octet_length(nonce) == 12), F.lit(False)),
        F.try_aes_decrypt(F.concat(nonce, F.col("content")), key, F.lit("GCM")),
    )
    return blobs.withColumn("plain", opened).withColumn(
        "failure",
        F.when(~F.coalesce(key_ok, F.lit(False)), "bad key length")
        .when(~F.coalesce(F.octet_length(nonce).between(12, 32), F.lit(False)), "bad nonce length")
        .when(F.octet_length(nonce) != 12, "nonce not supported")
        .when(F.col("plain").isNull(), "failed authentication"),
    )


def upload_results(uploads: DataFrame) -> DataFrame:
    """Outcome per file: accepted urls and refusals in server order, primary url, fallbacks, status.

    ``uploads`` has one row per try: file_id, sent_sha, server_pos, server, label_pos, status,
    reason, reported_sha, url. Only a refused label (400 or 415) leads to another try, so the
    deciding try is the first one with any other answer, else the last one.
    """
    changed = F.col("reported_sha").isNotNull() & (F.lower("reported_sha") != F.lower("sent_sha"))
    success = F.col("status").between(200, 299)
    bare = F.rtrim("server", F.lit("/"))
    result = F.struct(
        F.when(success & ~changed, F.coalesce(
            F.when(is_absolute_url("url", ("http", "https")), canonical_web_url("url")),
            F.concat(bare, F.lit("/"), F.col("sent_sha")))).alias("url"),
        F.when(success & changed, F.concat(url_host("server"), F.lit(": changed the file")))
        .when(~success, F.concat(
            url_host("server"), F.lit(": "), F.rtrim(F.concat_ws(" ", F.col("status").cast("string"), "reason"))
        )).alias("error"),
    )
    final = ~F.col("status").isin(400, 415)
    per_server = (
        uploads.select("file_id", "server_pos", "label_pos", final.alias("final"), result.alias("result"))
        .groupBy("file_id", "server_pos")
        .agg(
            F.min_by(F.when(F.col("final"), F.col("result")), F.when(F.col("final"), F.col("label_pos"))).alias("decided"),
            F.max_by("result", "label_pos").alias("last"),
        )
        .select("file_id", "server_pos", F.coalesce("decided", "last").alias("r"))
    )
    # One row per configured server is left here, so the list is as long as the settings list.
    ordered = F.array_sort(F.collect_list(F.struct("server_pos", "r.url", "r.error")))
    pick = lambda field: F.array_compact(F.transform("tries", lambda t: t[field]))
    return (
        per_server.groupBy("file_id").agg(ordered.alias("tries"))
        .select("file_id", pick("url").alias("urls"), pick("error").alias("errors"))
        .select(
            "*", F.get("urls", F.lit(0)).alias("primary_url"),
            F.slice("urls", F.lit(2), F.greatest(F.size("urls") - 1, F.lit(0))).alias("fallbacks"),
            F.when(F.size("urls") > 0, "Uploaded").otherwise("Failed").alias("status"),
        )
    )
