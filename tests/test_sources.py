"""Frames, events and requests as text; snapshots; blobs."""

import hashlib
import json
import os
import re
import tempfile

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from whisperlake.operators.attachments import decrypt_blobs
from whisperlake.operators.filters import EventFilter
from whisperlake.plans.catalog import QUERIES
from whisperlake.schemas import DEFAULT_MEDIA_SERVERS, DEFAULT_RELAYS, EVENT, MAX_FRAME_BYTES
from whisperlake.sources import blobs, frames, snapshot
from whisperlake.session import work_dir

GOOD = {"id": "a", "pubkey": "b", "created_at": 5, "kind": 1, "tags": [["p", "x"], []], "content": "c"}


def lines(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def event(**changes):
    return json.dumps({k: v for k, v in (GOOD | changes).items() if v is not ...})


@pytest.mark.parametrize("text, expected", [
    (event(), {}),
    (event(extra=[1, {"a": 2}]), {}),
    (event(sig="s"), {"sig": "s"}),
    (event(sig=""), {}),
    (event(sig=7), {}),
    (event(content=None, id=None), {"content": "", "id": ""}),
    (event(tags=[["p", None], [None]]), {"tags": [["p", ""], [""]]}),
    (event(tags=[]), {"tags": []}),
    (event(tags=[[]]), {"tags": [[]]}),
    (event(created_at=2**62), {"created_at": 2**62}),
    (event(created_at=-3), {"created_at": -3}),
    *[(bad, None) for bad in (
        event(created_at=1.5), event(created_at="5"), event(created_at=None), event(created_at=2**70), event(kind=2**31), event(kind=...),
        event(tags=[["p", 5]]), event(tags=[["p"], "x"]), event(tags=None), event(tags=[None]), event(tags=[[], None]), event(tags={}),
        event(tags=...), event(content=3), event(pubkey=...), "[]", "1", "null", "{", "", '{"id":"a"',
    )],
])
def test_event_text(spark, text, expected):
    good, bad = frames.parse_events(spark.createDataFrame([(text,)], "json string"))
    rows = [r.asDict() for r in good.collect()]
    if expected is None:
        assert rows == [] and [r.json for r in bad.collect()] == [text]
    else:
        assert rows == [GOOD | {"sig": None} | expected] and bad.count() == 0


def test_frames(spark):
    texts = [
        f'["EVENT","s",{event()}]', f'["EVENT",null,{event()}]', '["EVENT","s"]', '["EVENT","s",{}]', '["EOSE","s"]', '["EOSE"]',
        '["OK","id",true]', '["OK","id",false,"blocked: x"]', '["OK","id"]', '["OK","id","yes"]', '["CLOSED","s"]',
        '["CLOSED","s","auth-required: x"]', '["AUTH","ch"]', '["NOTICE","n"]', '["NOTICE",null]', '{"a":1}', '["WHAT","x"]', "junk",
        '["NOTICE","' + "x" * MAX_FRAME_BYTES + '"]', "[]",
    ]
    t = {k: df.collect() for k, df in frames.parse_frames(lines(spark, texts)).items()}
    assert [(r.sub_id, r.id) for r in t["events"]] == [("s", "a"), ("", "a")]
    assert [r.sub_id for r in t["eose"]] == ["s"]
    assert [(r.message_id, r.ack_ok, r.ack_text) for r in t["acks"]] == [("id", True, ""), ("id", False, "blocked: x")]
    assert [(r.sub_id, r.text) for r in t["closed"]] == [("s", ""), ("s", "auth-required: x")]
    assert [r.challenge for r in t["challenges"]] == ["ch"]
    assert [r.text for r in t["notices"]] == ["n", ""]
    assert sorted(r.reason for r in t["quarantine"]) == ["malformed answer", "malformed event", "not JSON", "too large"]


def test_frames_are_read_by_compiled_code(spark):
    """The JVM leaves methods of over 8,000 bytes of bytecode uncompiled, and they take most of the time of a large dump."""
    plan = QUERIES["s1_parse_frames"](spark, SMALL)._jdf.queryExecution()
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(plan, "codegen"))
    assert sizes and max(map(int, sizes)) < 8000


@pytest.mark.parametrize("text, expected", [
    (event(content="null"), {"content": "null"}),
    (event(tags=[], sig="s"), {"tags": [], "sig": "s"}),
    (event(tags=[[]], sig=""), {"tags": [[]]}),
    (event(tags=[["p", None]], sig="s"), {"tags": [["p", ""]], "sig": "s"}),
    (json.dumps(dict(reversed(GOOD.items()))), {}),
    (event(kind=2**31), None), (event(kind=-2**31 - 1, sig="s"), None), (event(tags=[["p"], None], sig="s"), None),
])
def test_plain_and_other_events_in_frames(spark, text, expected):
    t = frames.parse_frames(lines(spark, [f'["EVENT","s",{text}]']))
    found = [r.asDict() for r in t["events"].collect()]
    assert found == ([] if expected is None else [{"sub_id": "s"} | GOOD | {"sig": None} | expected])
    assert [r.reason for r in t["quarantine"].collect()] == (["malformed event"] if expected is None else [])


def test_escapes_in_every_part_of_an_event(spark):
    odd = {"id": "[\x1f]", "pubkey": "\\", "tags": [["\x0b", "\\u001F"], []], "content": "\\\x1e]", "sig": '"\x1a['}
    row = spark.createDataFrame([(odd | {"created_at": 1, "kind": 2})], EVENT)
    e = {"id": odd["id"], "pubkey": odd["pubkey"], "created_at": 1, "kind": 2} | {k: odd[k] for k in ("tags", "content", "sig")}
    assert frames.events_to_json(row).first().json == json.dumps(e, separators=(",", ":"))


def test_event_json_round_trip(spark):
    good, _ = frames.parse_events(spark.createDataFrame([(event(sig="s", content='é"\x07'),)], "json string"))
    assert frames.events_to_json(good).first().json == (
        '{"id":"a","pubkey":"b","created_at":5,"kind":1,"tags":[["p","x"],[]],"content":"é\\"\\u0007","sig":"s"}')


def test_requests(spark):
    flt = EventFilter(kinds=[1059], tags={"p": ["ab"], "t": []}, since=10, limit=5)
    text = f'["REQ","s",{flt.to_json()},{{}},{{"ids":[],"authors":["x"],"until":7}}]'
    rows = [tuple(r)[1:] for r in frames.parse_subscriptions(lines(spark, [text, '["CLOSE","s"]', "x"])).collect()]
    none = [None] * 7
    assert rows == [
        (0, None, None, [1059], {"p": ["ab"], "t": []}, 10, None, 5), (1, *none), (2, [], ["x"], None, None, None, 7, None)]
    first = frames.parse_subscriptions(lines(spark, [f'["REQ","s",{flt.to_json()}]']))
    assert first.select(frames.subscription_json()).first()[0] == f'["REQ","s",{flt.to_json()}]'


def test_malformed_requests_never_widen(spark):
    bad = {"kinds": ['{"kinds":"14"}', '{"kinds":[1.7]}', '{"kinds":[99999999999]}'], "ids": ['{"ids":[1]}'], "authors": ['{"authors":{}}'],
           "tags": ['{"#e":"z"}', '{"#e":["z",null]}'], "filter": ["7", '"x"'], "since": ['{"since":"1"}'], "until": ['{"until":1.5}'], "limit": ['{"limit":[]}']}
    text = [f'["REQ","s",{{"kinds":[1]}},{x}]' for xs in bad.values() for x in xs]
    assert frames.parse_subscriptions(lines(spark, text)).count() == len(text)
    got = frames.quarantined_subscriptions(lines(spark, text)).collect()
    assert [(r.filter_no, r.problem) for r in got] == [(1, k) for k, xs in bad.items() for _ in xs]


@pytest.mark.parametrize("body", [
    '{"Settings":{"Relays":["wss://relay.example"],"ProxyUrl":null}}', '{"Settings":{"Relays":null,"MediaServers":null}}',
    '{"Settings":null}', "{}"])
def test_old_snapshots(spark, body):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{folder}/ann.json", "w") as f:
        f.write(body)
    t = snapshot.read_snapshot(spark, folder)
    s = t["settings"].first()
    assert s.owner == "ann" and s.media_servers == DEFAULT_MEDIA_SERVERS
    assert s.relays == (["wss://relay.example"] if "wss" in body else DEFAULT_RELAYS)
    assert t["contacts"].count() == t["messages"].count() == t["processed"].count() == 0
    assert t["last_sync"].first().last_sync_at == 0


def test_full_snapshot(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    body = {
        "Contacts": {"k": {"PubKey": "k", "Name": "n", "InboxRelays": ["wss://x"], "IsBlocked": True}},
        "Messages": [{"Id": "m", "PeerPubKey": "k", "AuthorPubKey": "k", "Text": "t", "CreatedAt": 4, "Status": "Received",
                      "Attachment": {"Url": "u", "MimeType": "image/png", "Size": 3}, "RelaysAccepted": 2}],
        "ProcessedWrapIds": ["w1", "w2"], "LastSyncAt": 9,
    }
    with open(f"{folder}/bob.json", "w") as f:
        json.dump(body, f, indent=1)
    t = snapshot.read_snapshot(spark, folder)
    c, m = t["contacts"].first(), t["messages"].first()
    assert (c.pubkey, c.name, c.inbox_relays, c.is_blocked, c.is_request, c.last_read_at) == ("k", "n", ["wss://x"], True, False, 0)
    assert (m.id, m.status, m.attachment.size, m.attachment.fallbacks, m.relays_accepted) == ("m", "Received", 3, [], 2)
    assert sorted(r.id for r in t["processed"].collect()) == ["w1", "w2"] and t["last_sync"].first().last_sync_at == 9


def test_snapshot_versions(spark):
    path = work_dir(spark, "versions")
    one, two = spark.range(3), spark.range(5)
    snapshot.write_snapshot(spark, {"a": one}, path)
    old = snapshot.load_snapshot(spark, path)["a"]
    snapshot.write_snapshot(spark, {"a": two}, path)
    # A reader of the old version is not disturbed by the new one.
    assert old.count() == 3 and snapshot.load_snapshot(spark, path)["a"].count() == 5


def test_writers_side_by_side(spark, monkeypatch):
    """A second writer takes its number after both have seen the same newest version: neither is lost, and the later number is read."""
    path = work_dir(spark, "writers")
    snapshot.write_snapshot(spark, {"a": spark.range(1)}, path)
    seen = snapshot._versions
    inner = []

    def interleaved(*args):
        found = seen(*args)
        if not inner:
            inner.append(None)
            inner[0] = snapshot.write_snapshot(spark, {"a": spark.range(7)}, path)
        return found

    monkeypatch.setattr(snapshot, "_versions", interleaved)
    outer = snapshot.write_snapshot(spark, {"a": spark.range(9)}, path)
    assert (inner[0], outer) == (2, 3)
    rows = snapshot._manifests(spark, path).collect()
    assert sorted(r.version for r in rows) == [1, 2, 3] and snapshot.load_snapshot(spark, path)["a"].count() == 9
    sizes = {r.version: spark.read.parquet(f"{path}/versions/{r.folder}/a").count() for r in rows}
    assert sizes == {1: 1, 2: 7, 3: 9}


def test_blob_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.makedirs(f"{folder}/deep")
    data = {"one.bin": b"\x00\xff" * 10, "deep/two.bin": b"two", "skip.txt": b"x"}
    for name, body in data.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(body)
    rows = blobs.read_blobs(spark, folder, "*.bin").collect()
    assert {r.sha256 for r in rows} == {hashlib.sha256(data[n]).hexdigest() for n in ("one.bin", "deep/two.bin")}


def test_opening_blobs(spark):
    key, nonce = "11" * 32, "22" * 12
    sealed = spark.range(1).select(F.aes_encrypt(
        F.lit("hello"), F.unhex(F.lit(key)), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.lit(nonce)))).first()[0]
    body = bytes(sealed[12:])
    cases = [(body, key, nonce), (body[:-1] + b"\x00", key, nonce), (body, key, "22" * 16), (body, key, "22" * 8), (body, "11" * 31, nonce),
             (body, "33" * 32, nonce), (body, "zz", nonce)]
    rows = decrypt_blobs(spark.createDataFrame(cases, "content binary, key string, nonce string")).collect()
    assert [(r.plain and bytes(r.plain), r.failure) for r in rows] == [
        (b"hello", None), (None, "failed authentication"), (None, "nonce not supported"), (None, "bad nonce length"),
        (None, "bad key length"), (None, "failed authentication"), (None, "bad key length")]
