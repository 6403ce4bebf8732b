"""Known answers and edge cases of the column functions."""

import json

import pytest
from pyspark.sql import functions as F

from whisperlake.functions import keys, labels, media, padding, text, urls
from whisperlake.functions.events import event_id, first_tag, has_valid_id, participants, tag_values
from whisperlake.operators import attachments, contacts
from whisperlake.operators.filters import EventFilter, filter_events
from whisperlake.schemas import EVENT

AUTHOR = "611df01bfcf85c26ae65453b772d8f1dfd25c264621c0277e1fc1518686faef9"
HARD = 'é "q" \\ \n\t\u0007 🦄 </script>'
TAGS = "array<array<string>>"


def column(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in values], f"x {kind}").select(expr).collect()]


def test_pinned_ids(spark):
    rows = [
        (AUTHOR, 1700000000, 14, [["p", "x"]], HARD),
        (AUTHOR, 1691518405, 1, [], "Are you going to the party tonight?"),
    ]
    df = spark.createDataFrame(rows, f"pubkey string, created_at long, kind int, tags {TAGS}, content string")
    assert [r[0] for r in df.select(event_id()).collect()] == [
        "38d8b85a3ed01544bbb82138d359f992f154f6bef209ffff0df2d4c50c4c705e",
        "9dd003c6d3b73b74a85a9ab099469ce251653a7af76f523671ab828acd2a0ef9",
    ]
    again = df.withColumn("id", event_id())
    assert again.filter(has_valid_id()).count() == 2
    assert again.withColumn("created_at", F.col("created_at") + 1).filter(has_valid_id()).count() == 0
    assert again.withColumn("id", F.upper("id")).filter(has_valid_id()).count() == 0


def test_escaping_matches_javascript_for_every_character(spark):
    singles = [chr(i) for i in [*range(0x400), 0x2028, 0x2029, 0xFFFD, 0x1F984]]
    texts = [*singles, *[c + "x\x1f" for c in singles], "\\u001F", "a\\\\u000b", "", '["]']
    got = column(spark, texts, text.json_string("x"))
    # Python spells control characters like JavaScript and leaves the rest alone.
    assert got == [json.dumps(t, ensure_ascii=False) for t in texts]
    nested = [[["p", t], [t]] for t in texts]
    got = column(spark, nested, text.tags_json("x"), TAGS)
    assert got == [json.dumps(t, ensure_ascii=False, separators=(",", ":")) for t in nested]


def test_hex_shape(spark):
    got = column(spark, ["ab" * 32, "AB" * 32, "ab" * 31, "ab" * 32 + "\n", None, "zz" * 32], text.is_lower_hex("x", 32))
    assert got == [True, False, False, False, False, False]


def test_tags(spark):
    tags = [[["p", "a"], ["p"], ["e", "1", "", "reply"], ["p", "b", "more"], []]]
    assert column(spark, tags, tag_values("x", "p"), TAGS) == [["a", "b"]]
    assert column(spark, tags, first_tag("x", "q"), TAGS) == [None]
    assert column(spark, tags, participants("x", F.lit("me"), F.lit("a")), TAGS) == [["b", "me"]]


NPUBS = {
    "npub180cvv07tjdrrgpa0j7j7tmnyl2yr6yr7l8j4s3evf6u64th6gkwsyjh6w6":
        "3bf0c63fcb93463407af97a5e5ee64fa883d107ef9e558472c4eb9aaaefa459d",
    "npub10elfcs4fr0l0r8af98jlmgdh9c8tcxjvz9qkw038js35mp4dma8qzvjptg":
        "7e7e9c42a91bfef19fa929e5fda1b72e0ebc1a4c1141673e2794234d86addf4e",
}


def test_public_keys(spark):
    for npub, key in NPUBS.items():
        assert column(spark, [key], keys.npub("x")) == [npub]
        forms = [npub, "nostr:" + npub, " " + npub.upper() + "\t", key.upper(), key]
        assert column(spark, forms, keys.parse_public_key("x")) == [key] * 5
    profile = (
        "nostr:nprofile1qqsrhuxx8l9ex335q7he0f09aej04zpazpl0ne2cgukyawd24mayt8gpp4mhxue69uhhytnc9e3k7mgpz4mhxue69uhkg6nzv9ejuumpv34kytnrdaksjlyr9p"
    )
    assert column(spark, [profile], keys.parse_public_key("x")) == ["3bf0c63fcb93463407af97a5e5ee64fa883d107ef9e558472c4eb9aaaefa459d"]
    bad = ["", "npub1", "npub180cvv07tjdrrgpa0j7j7tmnyl2yr6yr7l8j4s3evf6u64th6gkwsyjh6w7", "nPub1" + "q" * 58,
           "nsec1vl029mgpspedva04g90vltkh6fvh240zqtv9k0t9af8935ke9laqsnlfe5", "zz", None, "nprofile1", "npub1" + "b" * 58]
    assert column(spark, bad, keys.parse_public_key("x")) == [None] * len(bad)


def test_names(spark):
    key, npub = next(iter((k, n) for n, k in NPUBS.items()))
    df = spark.createDataFrame([(None, key), (" \n", key), (" ann ", key)], "name string, pubkey string")
    rows = df.select(keys.display_name("name", "pubkey"), keys.initial("name"), keys.avatar_bucket("pubkey")).collect()
    short = npub[:12] + "…" + npub[-6:]
    assert [tuple(r) for r in rows] == [(short, "?", 0x3B % 10), (short, "?", 0x3B % 10), (" ann ", "A", 0x3B % 10)]


def test_urls(spark):
    good = {
        "wss://Relay.Example.com/": "wss://relay.example.com", " WS://u@h.ONION:80/a/b//?q=1#f": "ws://h.onion/a/b?q=1",
        "ws://[::1]:8080": "ws://[::1]:8080", "wss://h:80": "wss://h:80",
    }
    assert column(spark, good, urls.normalize_relay_url("x")) == list(good.values())
    assert column(spark, good, urls.relay_url_valid("x")) == [True] * 4
    bad = ["https://not-a-relay", "wss://", "relay.example.com", "wss://h:99999", None, "wss://a b"]
    assert column(spark, bad, urls.relay_url_valid("x")) == [False] * 6
    assert column(spark, ["wss://x.ONION/p", "wss://onion.example"], urls.is_onion("x")) == [True, False]
    proxies = ["socks5://127.0.0.1:9050", "http://host", "socks5://host", "ftp://h:1", "http://h:0", None]
    assert column(spark, proxies, urls.proxy_url_valid("x")) == [True, True, False, False, False, False]
    servers = [[" https://a.example/ ", "https://a.example", "ftp://b", "http://c"]]
    assert column(spark, servers, urls.media_server_list("x"), "array<string>") == [["https://a.example", "http://c"]]
    assert column(spark, ["relay.example.com", " ws://x "], urls.with_default_scheme("x", "wss")) == ["wss://relay.example.com", "ws://x"]
    with pytest.raises(Exception, match="at least one media server"):
        column(spark, [["nope"]], urls.require_servers(urls.media_server_list("x")), "array<string>")


def test_inbox_list_round_trip(spark):
    tags = [[["relay", u] for u in ("wss://Relay.Example.com/", "wss://relay.example.com", "https://not-a-relay")]]
    assert column(spark, tags, contacts.parse_inbox_list("x"), TAGS) == [["wss://relay.example.com"]]


def test_padding(spark):
    # One value on each side of every step.
    want = {16: 32, 32: 32, 33: 64, 37: 64, 45: 64, 49: 64, 64: 64, 65: 96, 100: 128, 111: 128, 200: 224, 250: 256, 320: 320,
            383: 384, 384: 384, 400: 448, 500: 512, 512: 512, 515: 640, 700: 768, 800: 896, 900: 1024, 1020: 1024, 65535: 65536}
    assert column(spark, want, padding.padded_length("x"), "long") == list(want.values())


def test_labels(spark):
    now = 1_706_659_200  # 2024-01-31, a Wednesday
    stamps = [now + 60, now - 1, now - 3 * 86_400, now - 7 * 86_400, now + 2 * 86_400]
    assert column(spark, stamps, labels.day_label("x", F.lit(now)), "long") == [
        "Today", "Yesterday", "Sunday", "Wednesday, 24 January 2024", "Friday"]
    assert column(spark, stamps, labels.time_label("x", F.lit(now)), "long")[:4] == ["00:01", "Yesterday", "Sunday", "01/24/2024"]
    assert column(spark, [-1.0, 65.9, 3725.0], labels.duration_label("x"), "double") == ["0:00", "1:05", "1:02:05"]
    sizes = [0, 2000, 1024 * 1024 - 1, 1024 * 1024, 1024 * 1024 * 3 // 2]
    assert column(spark, sizes, labels.size_label("x"), "long") == ["1 KB", "1 KB", "1023 KB", "1 MB", "1.5 MB"]


def test_media_types(spark):
    assert column(spark, ["a.JPG", "x.tar.opus", "n", "d.x/y", "z."], media.mime_from_name("x")) == [
        "image/jpeg", "audio/ogg", None, None, None]
    assert column(spark, ["image/png", "video/x", "audio/aac", "weird", "image"], media.extension_for("x")) == [
        ".png", ".mp4", ".m4a", ".bin", ".bin"]
    assert column(spark, ["audio/aac", "audio/mpeg", "application/octet-stream", "", "image/png"], media.upload_labels("x")) == [
        ["application/octet-stream", "audio/aac", "audio/mpeg", "video/mp4"], ["application/octet-stream", "audio/mpeg"],
        ["application/octet-stream"], ["application/octet-stream"], ["application/octet-stream", "image/png"]]


def file_event(spark, tags, content="https://blossom.example/abc", kind=15):
    return spark.createDataFrame([(kind, tags, content)], f"kind int, tags {TAGS}, content string")


FILE_TAGS = [
    ["file-type", "image/jpeg"], ["encryption-algorithm", "aes-gcm"], ["decryption-key", "a" * 64],
    ["decryption-nonce", "b" * 24], ["x", "c" * 64], ["ox", "d" * 64], ["size", "1234"], ["dim", "800x600"],
    ["duration", "3.5"], ["fallback", "https://mirror.example/abc"],
]


def test_file_message_round_trip(spark):
    read = file_event(spark, FILE_TAGS).select(attachments.attachment_from_event().alias("a"))
    a = read.first().a
    assert (a.url, a.fallbacks, a.size, a.duration_seconds) == (
        "https://blossom.example/abc", ["https://mirror.example/abc"], 1234, 3.5)
    assert read.select(attachments.attachment_to_tags("a")).first()[0] == FILE_TAGS


@pytest.mark.parametrize("name, value", [
    ("encryption-algorithm", "rot13"), ("decryption-key", "abc"), ("decryption-nonce", ""), ("x", "c" * 63), ("x", None)])
def test_unreadable_files(spark, name, value):
    tags = [t if t[0] != name else [name, value] for t in FILE_TAGS if t[0] != name or value is not None]
    assert file_event(spark, tags).select(attachments.attachment_from_event()).first()[0] is None
    assert file_event(spark, FILE_TAGS, "not a url").select(attachments.attachment_from_event()).first()[0] is None


def test_filters(spark):
    flt = EventFilter(kinds=[1059], tags={"p": ["ab"]}, since=10, limit=5)
    assert flt.to_json() == '{"kinds":[1059],"#p":["ab"],"since":10,"limit":5}'
    rows = [("1", "00", t, 1059, [["p", p]], "", None) for t, p in ((11, "ab"), (11, "cd"), (9, "ab"), (10, "ab"))]
    df = spark.createDataFrame(rows, EVENT)
    found = lambda f: [r.created_at for r in filter_events(df, f).collect()]
    assert found(flt) == [11, 10]
    assert len(found(EventFilter())) == 4
    for nothing in (EventFilter(ids=[]), EventFilter(kinds=[]), EventFilter(authors=[]), EventFilter(tags={"p": []})):
        assert found(nothing) == []
    assert found(EventFilter(until=10)) == [9, 10]
