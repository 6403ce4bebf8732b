"""Streams give what the batch form gives, whatever the split and however often rows are delivered."""

import glob
import os
import random
import time

import pytest

from conftest import SMALL
from pyspark.sql import functions as F

from whisperlake.functions.events import event_id
from whisperlake.operators import delivery, inbox
from whisperlake.plans import views
from whisperlake.session import work_dir
from whisperlake.sources import feed
from whisperlake.streaming import dedup
from whisperlake.streaming import delivery as stream_delivery
from whisperlake.streaming import inbox as stream_inbox
from whisperlake.streaming import log as table
from whisperlake.streaming import messages as stream_messages

COPY = "id string, arrival long"
DAY = 86_400
AUTHOR = "ab" * 32


def write(spark, rows, schema, path):
    """Adds one file; files are read in the order of their times, so each gets a later one."""
    old = set(glob.glob(f"{path}/*.parquet"))
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    at = time.time() - 10_000 + 60 * len(old)
    for name in set(glob.glob(f"{path}/*.parquet")) - old:
        os.utime(name, (at, at))


def run(df, path):
    df.writeStream.format("parquet").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start(
        f"{path}/out").awaitTermination()


def test_dedup_over_batches(spark):
    """Repeats go however late they are; a first copy stays, even one far behind all others."""
    path = work_dir(spark, "dedup")
    for rows in ([("a", 0), ("b", 10), ("a", 0)], [("a", DAY), ("c", DAY)], [("d", 50 * DAY)], [("f", 50 * DAY)], [("e", 1), ("a", 60 * DAY)]):
        write(spark, [(i, views.EPOCH + t) for i, t in rows], COPY, f"{path}/in")
    source = lambda: feed.stream_events(spark, f"{path}/in", spark.read.parquet(f"{path}/in").schema, files_per_batch=1)
    dedup.stream_dedup(source(), f"{path}/out", f"{path}/cp").awaitTermination()
    ids = lambda: sorted((r.id, r.arrival - views.EPOCH) for r in dedup.deduplicated(spark, f"{path}/out").collect())
    first = [("a", 0), ("b", 10), ("c", DAY), ("d", 50 * DAY), ("e", 1), ("f", 50 * DAY)]
    assert ids() == first
    # The stream goes on where it stopped.
    write(spark, [("c", views.EPOCH), ("g", views.EPOCH)], COPY, f"{path}/in")
    dedup.stream_dedup(source(), f"{path}/out", f"{path}/cp").awaitTermination()
    assert ids() == first + [("g", 0)]


def test_feed_continues_where_it_stopped(spark):
    path = work_dir(spark, "feed")
    write(spark, [("a", 1)], COPY, f"{path}/in")
    source = lambda: feed.stream_events(spark, f"{path}/in", spark.read.parquet(f"{path}/in").schema)
    run(source(), path)
    write(spark, [("b", 2)], COPY, f"{path}/in")
    run(feed.since(source(), None), path)
    assert sorted(r.id for r in spark.read.parquet(f"{path}/out").collect()) == ["a", "b"]


def test_inbox_stream_equals_batch_and_ignores_repeats(spark):
    path = work_dir(spark, "inbox")
    wraps, seals, rumors = views.layers(spark, SMALL)
    processed = spark.createDataFrame([], "id string")
    log = views.owner_block_log(spark, SMALL)
    early = wraps.filter("event_id < 600")
    for part in (early, early.filter("event_id % 2 = 0"), wraps.filter("event_id >= 500"), views.repeated(wraps)):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    changes = []
    source = feed.stream_events(spark, f"{path}/in", spark.read.parquet(f"{path}/in").schema, files_per_batch=1)
    stream_inbox.stream_inbox(
        source, lambda _: (seals, rumors), processed, log, f"{path}/store", f"{path}/cp",
        on_change=lambda df, n: changes.append((n, df.count()))).awaitTermination()
    batch = inbox.fold_inbox(wraps, seals, rumors, processed, log)
    pick = lambda df: sorted(map(tuple, df.select("owner", "id", "peer", "status", "text").collect()))
    assert pick(stream_inbox.current_messages(spark, f"{path}/store")) == pick(batch.messages)
    people = lambda df: sorted((r.owner, r.pubkey) for r in df.collect())
    assert people(stream_inbox.current_contacts(spark, f"{path}/store")) == people(inbox.implied_contacts(batch.messages))
    assert [n for n, _ in changes] == [0, 1, 2, 3] and changes[1][1] == changes[3][1] == 0
    assert table.everything(spark, f"{path}/store/handled").count() == batch.handled.count() == wraps.count()


def chain(spark, wraps):
    """Wraps (id, owner, arrival), all of one author and sealing one rumor each, with what they hold."""
    rows = [(w, "p", 1059, True, f"s{w}", o, t) for w, o, t in wraps]
    w = spark.createDataFrame(rows, "id string, pubkey string, kind int, wrap_ok boolean, seal_id string, owner string, arrival long")
    inner = w.select("seal_id", "owner").distinct()
    rumors = inner.select(
        "seal_id", F.lit(AUTHOR).alias("pubkey"), F.lit(5).cast("long").alias("created_at"), F.lit(14).alias("kind"),
        F.array(F.array(F.lit("p"), F.col("owner"))).alias("tags"), F.concat(F.lit("hi "), "seal_id").alias("content"))
    seals = inner.select(F.col("seal_id").alias("id"), F.lit(13).alias("kind"), F.lit(AUTHOR).alias("pubkey"),
                         F.lit(0).alias("n_tags"), F.lit(True).alias("seal_ok"))
    return w, seals, rumors.withColumn("id", event_id())


def test_what_arrives_while_blocked_is_lost(spark):
    log = spark.createDataFrame([("o", AUTHOR, 10, True), ("o", AUTHOR, 20, False)], "owner string, peer string, changed_at long, blocked boolean")
    none = spark.createDataFrame([], "id string")
    # The same wrap again after unblocking brings nothing; another owner's inbox knows no block.
    got = inbox.fold_inbox(*chain(spark, [("w1", "o", 15), ("w1", "o", 25), ("w2", "q", 15), ("w3", "o", 9)]), none, log)
    assert {(r.owner, r.text) for r in got.messages.collect()} == {("q", "hi sw2"), ("o", "hi sw3")}
    assert {(r.owner, r.id) for r in got.handled.collect()} == {("o", "w1"), ("q", "w2"), ("o", "w3")}
    stored = got.messages.filter("owner = 'o'").select("owner", "id")
    again = inbox.fold_inbox(*chain(spark, [("w2", "q", 15), ("w3", "o", 9)]), none, log, stored)
    assert {r.owner for r in again.messages.collect()} == {"q"}
    done = spark.createDataFrame([("q", "w2")], "owner string, id string")
    left = inbox.fold_inbox(*chain(spark, [("w2", "q", 15), ("w2", "o", 30)]), none, log).handled
    assert left.count() == 2
    assert {r.owner for r in inbox.fold_inbox(*chain(spark, [("w2", "q", 15), ("w2", "o", 30)]), done, log).handled.collect()} == {"o"}


def test_delivery_stream_equals_batch(spark):
    """Sends and answers in any order, the oldest send last, two attempts of some messages."""
    path = work_dir(spark, "delivery")
    sent = [(m, r, 1, 1000 * m) for m in range(1, 20) for r in range(3)] + [(m, r, 2, 1000 * m + 300) for m in (3, 8) for r in range(2)]
    acks = [(m, r, (m + r) % 3 == 0, "auth-required: x" if r == 1 else "blocked", 1000 * m + d)
            for m in range(1, 20) for r, d in ((0, 5), (1, 1), (1, 29), (2, 31), (0, 305))]
    publishes = spark.createDataFrame(sent, "message_id long, relay long, attempt int, sent_at long")
    answers = spark.createDataFrame(acks, "message_id long, relay long, ack_ok boolean, ack_text string, acked_at long")
    rows = [tuple(r) for r in stream_delivery.delivery_log(publishes, answers).collect()]
    rows.reverse()
    for i in range(5):
        write(spark, rows[i::5], stream_delivery._LOG, f"{path}/in")
    source = feed.stream_events(spark, f"{path}/in", spark.read.parquet(f"{path}/in").schema, files_per_batch=1)
    stream_delivery.stream_delivery(source, f"{path}/store", f"{path}/cp").awaitTermination()
    matched = delivery.match_acks(publishes, answers)
    outcome = F.when(F.col("accepted"), "accepted").when(F.col("acked_at").isNotNull(), "rejected").otherwise("pending")
    attempts = matched.withColumn("outcome", outcome)
    messages = publishes.select("message_id").distinct()
    for as_of in (0, 10_010, 1_000_000):
        got = {r.message_id: (r.relays_accepted, r.status) for r in stream_delivery.delivery_states(spark, f"{path}/store", as_of).collect()}
        want = delivery.delivery_status(messages, attempts, as_of).collect()
        assert got == {r.message_id: (r.relays_accepted, r.status) for r in want}


class Cut:
    """A session that fails when the manifest is about to be written."""

    def __init__(self, spark):
        self.spark = spark

    def __getattr__(self, name):
        return getattr(self.spark, name)

    def createDataFrame(self, *_):  # noqa: N802
        raise RuntimeError("lost")


def test_fifty_batches_read_about_as_many_rows_each(spark, monkeypatch):
    """Each batch brings new keys and asks for a few: what it reads doesn't follow what is stored. A merge that is cut off loses nothing."""
    monkeypatch.setattr(table, "PART_ROWS", 4)
    path, schema, keys = work_dir(spark, "keyed"), "id long, v long", ["id"]
    read, size, asked = [], 30, 4
    for n in range(50):
        if n in (9, 30):
            with pytest.raises(RuntimeError):
                for k in range(n, n + 9):  # one of them is due
                    table.settle(Cut(spark), path, k, schema, keys)
        table.settle(spark, path, n, schema, keys)
        old = [(7 * n + i) % (size * n) for i in range(asked)] if n else []
        touched = spark.createDataFrame([(i,) for i in old + [size * n]], "id long")
        found = table.before(spark, path, n, schema, touched, keys).collect()
        assert set(old) <= {r.id for r in found} <= set(range(size * n))
        assert len({r.id for r in found}) == len(found)
        read.append(len(found))
        rows = spark.createDataFrame([(size * n + i, i) for i in range(size)], schema).coalesce(1)
        table.append(rows, path, n)
        if n == 25:  # a batch that runs again
            table.append(rows, path, n)
    fresh = size * (table.FRESH + 1)
    assert max(read[40:]) <= fresh + 120 and max(read[10:20]) > fresh // 2
    everything = table.everything(spark, path).collect()
    assert sorted(r.id for r in everything) == list(range(50 * size))
    assert {r.id: r.batch for r in everything} == {i: i // size for i in range(50 * size)}


def test_merges_keep_the_newest_row(spark):
    path, schema = work_dir(spark, "newest"), "id long, v long"
    for n in range(20):
        table.settle(spark, path, n, schema, ["id"], newest=True)
        table.append(spark.createDataFrame([(i, n) for i in range(n % 3, 30, 3)], schema).coalesce(1), path, n)
    rows = table.everything(spark, path).collect()
    assert len(rows) < 30 + 10 * 2 * table.FRESH
    newest = {}
    for r in sorted(rows, key=lambda r: r.batch):
        newest[r.id] = r.v
    assert newest == {i: max(n for n in range(20) if n % 3 == i % 3) for i in range(30)}


MESSAGE = "seq long, op string, id string, old_id string, peer string, status string"


def message_batches(rng, n, size):
    seq, live = 0, 0
    for _ in range(n):
        rows = []
        for _ in range(size):
            i, peer = rng.randrange(40), f"p{rng.randrange(4)}"
            op = rng.choice(["add", "add", "add", "update", "update", "replace", "remove"] if rng.random() < 0.6 else ["add", "update", "replace"])
            # A message belongs to one peer for good.
            peer = f"p{i % 4}"
            ident, old = (f"m{i}", None) if op != "replace" else (f"m{i}", f"u{i}")
            if op == "add" and rng.random() < 0.5:
                ident = f"u{i}"
            rows.append((seq, op, None if op == "remove" else ident, old, peer, f"s{seq}"))
            seq += 1
        live += len(rows)
        yield rows


def test_message_stream_equals_the_fold(spark, monkeypatch):
    from whisperlake.operators.messages import apply_message_changes

    monkeypatch.setattr(table, "FRESH", 3)
    rng = random.Random(21)
    path, done, feed_rows = work_dir(spark, "messages"), [], {}
    collect = lambda df, n: feed_rows.setdefault(n, []).append(sorted(map(tuple, df.collect()), key=str))
    state = {}
    for n, rows in enumerate(message_batches(rng, 9, 14)):
        batch = spark.createDataFrame(rows, MESSAGE)
        for _ in range(2 if n in (4, 7) else 1):  # a batch that runs again
            stream_messages.apply_batch(batch, n, f"{path}/store", collect)
        old = spark.createDataFrame([(i, p, s) for i, (p, s) in state.items()], "id string, peer string, status string")
        after = {r.id: (r.peer, r.status) for r in apply_message_changes(old, batch).collect()}
        got = {r.id: (r.peer, r.status) for r in stream_messages.stored_messages(spark, f"{path}/store").collect()}
        assert got == after, n
        # The feed brings a copy of the table up to date.
        copy = dict(state)
        for i, change, old_id, peer, status in sorted(feed_rows[n][0], key=lambda r: r[0] is not None):
            if i is None:
                copy = {k: v for k, v in copy.items() if v[0] != peer}
            elif change == "removed":
                copy.pop(i, None)
            else:
                copy.pop(old_id, None)
                copy[i] = (peer, status)
        assert copy == after, n
        state = after
        done += rows
    assert all(a == b for rows in feed_rows.values() for a in rows for b in rows)
    kinds = {c for rows in feed_rows.values() for _, c, *_ in rows[0]}
    assert kinds == {"added", "updated", "replaced", "removed"}
    assert [len(feed_rows[n]) for n in (3, 4, 7)] == [1, 2, 2]


def test_new_wrap_of_a_stored_message_still_implies_its_contact(spark):
    log = spark.createDataFrame([], "owner string, peer string, changed_at long, blocked boolean")
    none = spark.createDataFrame([], "id string")
    first = inbox.fold_inbox(*chain(spark, [("w1", "o", 15)]), none, log)
    stored = first.messages.select("owner", "id")
    again = inbox.fold_inbox(*chain(spark, [("w1", "o", 25)]), none, log, stored)
    assert again.messages.count() == 0 and [(r.owner, r.pubkey) for r in again.contacts.collect()] == [("o", AUTHOR)]


def test_delivery_feed(spark):
    path, seen = work_dir(spark, "delivery-feed"), []
    for rows in ([(1, 0, 1, 100, None, None, None), (2, 0, 1, 100, None, None, None)], [(1, 0, None, None, True, "", 105)], [(2, 0, 1, 100, None, None, None)]):
        write(spark, rows, stream_delivery._LOG, f"{path}/in")
    source = feed.stream_events(spark, f"{path}/in", spark.read.parquet(f"{path}/in").schema, files_per_batch=1)
    stream_delivery.stream_delivery(
        source, f"{path}/store", f"{path}/cp", on_change=lambda df, n: seen.append(sorted((r.message_id, r.change, r.n_accepted) for r in df.collect()))
    ).awaitTermination()
    assert seen == [[(1, "added", 0), (2, "added", 0)], [(1, "updated", 1)], []]
