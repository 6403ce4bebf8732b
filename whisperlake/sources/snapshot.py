"""History snapshots: JSON files in, versioned Parquet tables out."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whisperlake.schemas import DEFAULT_MEDIA_SERVERS, DEFAULT_RELAYS

_TEXTS = "array<string>"
_CONTACT = (
    f"struct<PubKey:string,Name:string,InboxRelays:{_TEXTS},InboxRelaysFetchedAt:bigint,"
    "IsRequest:boolean,LastReadAt:bigint,IsBlocked:boolean>"
)
_ATTACHMENT = (
    f"struct<Url:string,Fallbacks:{_TEXTS},MimeType:string,Key:string,Nonce:string,EncryptedSha256:string,"
    "PlainSha256:string,Size:bigint,Dimensions:string,DurationSeconds:double>"
)
_MESSAGE = (
    "struct<Id:string,PeerPubKey:string,AuthorPubKey:string,Text:string,CreatedAt:bigint,Status:string,"
    f"ReplyToId:string,Attachment:{_ATTACHMENT},RelaysAccepted:int>"
)
_SNAPSHOT = (
    f"Contacts map<string,{_CONTACT}>, Messages array<{_MESSAGE}>, ProcessedWrapIds {_TEXTS}, LastSyncAt bigint, "
    f"Settings struct<Relays:{_TEXTS},ProxyUrl:string,MediaServers:{_TEXTS}>"
)
TABLES = ("contacts", "messages", "processed", "settings", "last_sync")


def _or_default(c: str, default: list[str]) -> Column:
    listing = F.col(c)
    return F.when(F.size(listing) > 0, listing).otherwise(F.array(*map(F.lit, default)))


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of decrypted snapshot files, one JSON object per file; ``owner`` is the file name."""
    raw = spark.read.schema(_SNAPSHOT).json(path, multiLine=True)
    owner = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.json)?\z", 1)
    return snapshot_tables(raw.withColumn("owner", owner))


def read_snapshot_lines(spark: SparkSession, path: str) -> DataFrame:
    """Many snapshots in one file, one JSON object per line; splits like any text file."""
    return spark.read.schema(f"Owner string, {_SNAPSHOT}").json(path).withColumnRenamed("Owner", "owner")


def snapshot_tables(files: DataFrame) -> dict[str, DataFrame]:
    """Tables of snapshot rows (``owner`` plus the sections).

    Missing or null sections are empty; empty relay and server lists become the defaults.
    """
    contacts = files.select("owner", F.explode("Contacts").alias("key", "c")).select(
        "owner", F.col("key").alias("pubkey"), F.col("c.Name").alias("name"),
        F.coalesce("c.InboxRelays", F.array().cast(_TEXTS)).alias("inbox_relays"),
        F.coalesce("c.InboxRelaysFetchedAt", F.lit(0)).alias("fetched_at"),
        F.coalesce("c.IsRequest", F.lit(False)).alias("is_request"),
        F.coalesce("c.LastReadAt", F.lit(0)).alias("last_read_at"),
        F.coalesce("c.IsBlocked", F.lit(False)).alias("is_blocked"))
    a = F.col("m.Attachment")
    attachment = F.when(a.isNotNull(), F.struct(
        a["Url"].alias("url"), F.coalesce(a["Fallbacks"], F.array().cast(_TEXTS)).alias("fallbacks"),
        a["MimeType"].alias("mime"), a["Key"].alias("key"), a["Nonce"].alias("nonce"),
        a["EncryptedSha256"].alias("encrypted_sha256"), a["PlainSha256"].alias("plain_sha256"),
        F.coalesce(a["Size"], F.lit(0)).alias("size"), a["Dimensions"].alias("dimensions"),
        a["DurationSeconds"].alias("duration_seconds")))
    messages = files.select("owner", F.posexplode("Messages").alias("seq", "m")).select(
        "owner", F.col("seq").cast("bigint").alias("seq"), F.col("m.Id").alias("id"),
        F.col("m.PeerPubKey").alias("peer"), F.col("m.AuthorPubKey").alias("author"), F.col("m.Text").alias("text"),
        F.col("m.CreatedAt").alias("created_at"), F.col("m.Status").alias("status"),
        F.col("m.ReplyToId").alias("reply_to"), attachment.alias("attachment"),
        F.coalesce("m.RelaysAccepted", F.lit(0)).alias("relays_accepted"))
    settings = files.select(
        "owner", _or_default("Settings.Relays", DEFAULT_RELAYS).alias("relays"),
        F.col("Settings.ProxyUrl").alias("proxy_url"),
        _or_default("Settings.MediaServers", DEFAULT_MEDIA_SERVERS).alias("media_servers"))
    return {
        "contacts": contacts,
        "messages": messages,
        "processed": files.select("owner", F.explode("ProcessedWrapIds").alias("id")),
        "settings": settings,
        "last_sync": files.select("owner", F.coalesce("LastSyncAt", F.lit(0)).alias("last_sync_at")),
    }


def write_snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> int:
    """Writes all tables as one new version; readers take it from the moment its manifest is there.

    A version has folders of its own, never written again. Its manifest, the last thing written, is a one-row table whose success marker
    appears when it is complete; nothing is renamed or replaced. Writers may run side by side: each claims its version once its tables are
    written, by making a file that must not exist; who comes second takes the next number. So no version is lost, and the newest claim is what readers get.
    """
    name = uuid.uuid4().hex
    for table, df in tables.items():
        df.write.parquet(f"{path}/versions/{name}/{table}")
    version = max(_versions(spark, path), default=0) + 1
    while not _claimed(spark, f"{path}/claims/{version}"):
        version += 1
    manifest = spark.createDataFrame([(version, name, sorted(tables))], "version long, folder string, tables array<string>")
    manifest.coalesce(1).write.mode("append").parquet(f"{path}/manifests")
    return version


def _claimed(spark: SparkSession, file: str) -> bool:
    """Makes an empty file, unless it exists: of several writers one succeeds."""
    place = spark._jvm.org.apache.hadoop.fs.Path(file)
    try:
        place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False).close()
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("version long, folder string, tables array<string>").parquet(f"{path}/manifests")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The newest version, or nothing before the first one."""
    try:
        top = _manifests(spark, path).agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return [] if top is None else [top]


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest version."""
    pointer = _manifests(spark, path).orderBy(F.desc("version")).first()
    return {name: spark.read.parquet(f"{path}/versions/{pointer.folder}/{name}") for name in pointer.tables}
