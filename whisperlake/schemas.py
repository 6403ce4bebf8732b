"""Schemas of the event log and of the tables folded from it."""

from pyspark.sql import types as T

TAGS = T.ArrayType(T.ArrayType(T.StringType()))

EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("pubkey", T.StringType()),
    T.StructField("created_at", T.LongType()),
    T.StructField("kind", T.IntegerType()),
    T.StructField("tags", TAGS),
    T.StructField("content", T.StringType()),
    T.StructField("sig", T.StringType()),
])

ATTACHMENT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("fallbacks", T.ArrayType(T.StringType())),
    T.StructField("mime", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("nonce", T.StringType()),
    T.StructField("encrypted_sha256", T.StringType()),
    T.StructField("plain_sha256", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("dimensions", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()),
])

# Event kinds.
KIND_SEAL = 13
KIND_CHAT = 14
KIND_FILE = 15
KIND_GIFT_WRAP = 1059
KIND_INBOX_LIST = 10050

# Message states.
SENDING, SENT, FAILED, RECEIVED = "Sending", "Sent", "Failed", "Received"

# Limits and time budgets, in bytes and seconds.
MAX_FRAME_BYTES = 512 * 1024
MAX_PLAINTEXT_BYTES = 65_535
MAX_ATTACHMENT_BYTES = 64 * 1024 * 1024
WRAP_JITTER_SECONDS = 2 * 86_400
CATCH_UP_SECONDS = WRAP_JITTER_SECONDS + 3_600
PUBLISH_TIMEOUT_SECONDS = 30
QUERY_TIMEOUT_SECONDS = 8
INBOX_CACHE_SECONDS = 6 * 3_600
GROUP_GAP_SECONDS = 5 * 60
INBOX_RELAY_COUNT = 3

# Defaults used when a settings list is empty.
DEFAULT_RELAYS = [
    "wss://relay.damus.io",
    "wss://nos.lol",
    "wss://relay.primal.net",
    "wss://nostr.mom",
    "wss://offchain.pub",
]
DEFAULT_MEDIA_SERVERS = ["https://blossom.primal.net", "https://24242.io"]
