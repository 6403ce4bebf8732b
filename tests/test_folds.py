"""Folds and ordered operators against plain Python on random logs, one hot key included."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from whisperlake.functions.events import with_event_id
from whisperlake.operators import attachments, audit, conversations, delivery, filters, inbox, merge, validation
from whisperlake.operators.contacts import apply_contact_changes, latest_inbox_list
from whisperlake.operators.filters import EventFilter, filter_events, match_all_subscriptions, match_subscriptions
from whisperlake.operators.messages import apply_message_changes


def pick_key(rng, n):
    """A third of all draws hit one key."""
    return "hot" if rng.random() < 0.34 else f"k{rng.randrange(n)}"


@pytest.mark.parametrize("seed", [1, 2])
def test_contact_log(spark, seed):
    rng = random.Random(seed)
    state = [(f"k{i}", f"n{i}", bool(i % 2), bool(i % 3 == 0), i) for i in range(0, 60, 2)]
    ops = ["upsert", "add", "block", "unblock", "mark_read", "ensure", "remove"]
    log = [
        (seq, pick_key(rng, 60), rng.choices(ops, [1, 3, 2, 3, 4, 4, 1])[0], rng.choice([None, "", "  ", " ann ", "bob"]),
         rng.random() < 0.5, rng.random() < 0.5, seq * 10)
        for seq in range(600)
    ]
    want = {k: [n, r, b, t] for k, n, r, b, t in state}
    for _, key, op, name, request, blocked, at in log:
        here = want.get(key)
        blank = name is None or not name.strip()
        if op == "remove":
            want.pop(key, None)
        elif op == "upsert":
            want[key] = [name, request, blocked, at]
        elif op == "add" and key != "k5":
            old = here or [None, False, False, 0]
            want[key] = [old[0] if blank else name.strip(), False, old[2], old[3]]
        elif op == "block":
            old = here or [None, False, False, 0]
            want[key] = [old[0], False, True, old[3]]
        elif op == "unblock" and here:
            here[2] = False
        elif op == "mark_read" and here:
            here[3] = at
        elif op == "ensure" and not here:
            want[key] = [None, request, False, 0]
    s = spark.createDataFrame(state, "pubkey string, name string, is_request boolean, is_blocked boolean, last_read_at long")
    d = spark.createDataFrame(
        log, "seq long, pubkey string, op string, name string, is_request boolean, is_blocked boolean, last_read_at long")
    rows = apply_contact_changes(s, d, "k5").collect()
    assert {r.pubkey: [r.name, r.is_request, r.is_blocked, r.last_read_at] for r in rows} == want
    assert len(rows) == len(want)


@pytest.mark.parametrize("seed", [3, 4])
def test_message_log(spark, seed):
    rng = random.Random(seed)
    state = [(f"m{i}", f"p{i % 5}", "Received") for i in range(0, 40, 3)]
    log, gone = [], set()
    for seq in range(800):
        i = rng.randrange(40)
        peer = f"p{i % 5}"
        op = rng.choices(["add", "update", "replace", "remove"], [4, 4, 3, 0.2])[0]
        ident, old = rng.choice([f"m{i}", f"u{i}"]), None
        if op == "replace":
            ident, old = f"m{i}", f"u{i}"
            if old in gone and rng.random() < 0.5:
                op, old = "update", None
            else:
                gone.add(old)
        elif op == "add" and ident in gone:
            ident = f"m{i}"
        log.append((seq, op, ident if op != "remove" else None, old, peer, f"s{seq}"))
    want = {i: (p, s) for i, p, s in state}
    for _, op, ident, old, peer, status in log:
        if op == "remove":
            want = {k: v for k, v in want.items() if v[0] != peer}
        elif op == "add":
            want.setdefault(ident, (peer, status))
        elif op == "update" and ident in want:
            want[ident] = (peer, status)
        elif op == "replace":
            if old in want:
                del want[old]
                want[ident] = (peer, status)
            else:
                want.setdefault(ident, (peer, status))
    s = spark.createDataFrame(state, "id string, peer string, status string")
    d = spark.createDataFrame(log, "seq long, op string, id string, old_id string, peer string, status string")
    rows = apply_message_changes(s, d).collect()
    assert {r.id: (r.peer, r.status) for r in rows} == want
    assert len(rows) == len(want)


def random_messages(rng, n):
    out = []
    for i in range(n):
        at = 1_704_067_200 + rng.randrange(4 * 86_400) // 60 * 60
        out.append((f"m{rng.randrange(10**6)}-{i}", i, pick_key(rng, 6), at, rng.choice(["Received", "Sent", "Failed"]), f"t{i}"))
    return out


MESSAGE = "id string, seq long, peer string, created_at long, status string, text string"


def expected_timeline(rows, gap):
    out = {}
    by_peer = defaultdict(list)
    for r in rows:
        by_peer[r[2]].append(r)
    for peer, group in by_peer.items():
        previous, number = None, 0
        for r in sorted(group, key=lambda r: (r[3], r[0])):
            new_day = previous is None or previous[3] // 86_400 != r[3] // 86_400
            starts = new_day or (previous[4] == "Received") != (r[4] == "Received") or r[3] - previous[3] > gap
            number += starts
            out[r[0]] = (new_day, starts, number)
            previous = r
    return out


def test_timeline_and_groups(spark):
    rows = random_messages(random.Random(5), 900)
    want = expected_timeline(rows, 300)
    marked = conversations.timeline(spark.createDataFrame(rows, MESSAGE))
    got = conversations.with_group_numbers(marked).collect()
    assert {r.id: (r.new_day, r.starts_group, r.group_no) for r in got} == want
    one = conversations.timeline(spark.createDataFrame(rows, MESSAGE), peer="hot").collect()
    assert {r.id for r in one} == {r[0] for r in rows if r[2] == "hot"}


def test_late_messages_rebuild_only_their_peers(spark):
    rows = random_messages(random.Random(6), 400)
    late = [r for r in rows if r[1] % 37 == 0]
    stored = [r for r in rows if r[1] % 37 or r[1] % 2]
    got = conversations.rebuild_on_late(spark.createDataFrame(stored, MESSAGE), spark.createDataFrame(late, MESSAGE)).collect()
    touched = {r[2] for r in late}
    want = {k: v[:2] for k, v in expected_timeline([r for r in rows if r[2] in touched], 300).items()}
    assert {r.id: (r.new_day, r.starts_group) for r in got} == want


def test_last_message_keeps_the_first_stored_of_equals(spark):
    rows = [("b", 2, "p", 10, "Sent", "x"), ("a", 3, "p", 10, "Sent", "y"), ("c", 1, "p", 9, "Sent", "z")]
    assert conversations.last_message(spark.createDataFrame(rows, MESSAGE)).first().last.id == "b"


def test_unread_is_strictly_newer(spark):
    rows = [(f"m{t}", t, "p", t, s, "") for t in (9, 10, 11, 12) for s in ("Received",)] + [("o", 99, "p", 99, "Sent", "")]
    contacts = spark.createDataFrame([("p", 10)], "pubkey string, last_read_at long")
    assert conversations.unread_counts(spark.createDataFrame(rows, MESSAGE), contacts).first().unread_count == 2


def test_blocking_is_temporal(spark):
    rng = random.Random(7)
    rows = random_messages(rng, 300)
    log = [(pick_key(rng, 6), 1_704_067_200 + rng.randrange(90) * 3600 * 24, rng.random() < 0.5) for _ in range(80)]
    log = list({(p, t): (p, t, b) for p, t, b in log}.values())
    rows = [(r[0], r[1], r[2], 1_704_067_200 + rng.randrange(95 * 86_400), *r[4:]) for r in rows]

    def blocked(peer, at):
        before = [(t, b) for p, t, b in log if p == peer and t <= at]
        return bool(before) and max(before)[1]

    want = {r[0] for r in rows if r[4] != "Received" or not blocked(r[2], r[3])}
    got = inbox.drop_blocked(
        spark.createDataFrame(rows, MESSAGE), spark.createDataFrame(log, "peer string, changed_at long, blocked boolean")).collect()
    assert {r.id for r in got} == want


def test_acknowledgements(spark):
    rng = random.Random(8)
    publishes = [(i, f"r{j}", 1, 1000) for i in range(60) for j in range(3)]
    texts = ["", "auth-required: x", "duplicate: y", "blocked: z"]
    acks = [(rng.randrange(60), f"r{rng.randrange(3)}", rng.random() < 0.3, rng.choice(texts), 1000 + rng.randrange(45))
            for _ in range(500)]
    acks = list({(m, r, t): (m, r, ok, x, t) for m, r, ok, x, t in acks}.values())
    want = {}
    for m, r, _, sent in publishes:
        heard = sorted((t, x, ok) for mm, rr, ok, x, t in acks if (mm, rr) == (m, r) and sent <= t <= sent + 30)
        if heard and not heard[0][2] and heard[0][1].startswith("auth-required:"):
            heard = heard[1:]
        want[m, r] = (heard[0][2] or heard[0][1].startswith("duplicate:"), heard[0][1]) if heard else (False, "timed out")
    got = delivery.match_acks(
        spark.createDataFrame(publishes, "message_id long, relay string, attempt int, sent_at long"),
        spark.createDataFrame(acks, "message_id long, relay string, ack_ok boolean, ack_text string, acked_at long")).collect()
    assert {(r.message_id, r.relay): (r.accepted, r.answer) for r in got} == want


def test_delivery_states(spark):
    attempts = [
        (1, 1, "rejected"), (1, 1, "accepted"), (2, 1, "rejected"), (2, 1, "pending"), (3, 1, "rejected"), (4, 1, "accepted"),
        (4, 2, "rejected"), (5, 1, "rejected"), (5, 2, "accepted"), (5, 2, "accepted"),
    ]
    a = spark.createDataFrame([(m, f"r{i}", n, o, 100) for i, (m, n, o) in enumerate(attempts)],
                              "message_id long, relay string, attempt int, outcome string, sent_at long")
    messages = spark.range(1, 7).withColumnRenamed("id", "message_id")
    states = lambda **kw: {r.message_id: (r.status, r.relays_accepted) for r in delivery.delivery_status(messages, a, **kw).collect()}
    want = {1: ("Sent", 1), 2: ("Sending", 0), 3: ("Failed", 0), 4: ("Failed", 0), 5: ("Sent", 2), 6: ("Failed", 0)}
    assert states() == want
    assert states(as_of=129) == want
    assert states(as_of=130) == want | {2: ("Failed", 0)}


def test_first_answer(spark):
    rng = random.Random(9)
    results = [(f"q{rng.randrange(30)}", rng.randrange(3), f"e{rng.randrange(400)}", rng.randrange(120)) for _ in range(400)]
    finishes = [(f"q{q}", s, rng.choice([None, rng.randrange(120)])) for q in range(30) for s in range(3)]
    end = {(q, s): min(f if f is not None else 100, 100) for q, s, f in finishes}
    want = {}
    for q in {r[0] for r in results}:
        heard = [r for r in results if r[0] == q and r[3] <= end[q, r[1]]]
        if not heard:
            continue
        first = min(r[3] for r in heard)
        cut = min([e for (qq, _), e in end.items() if qq == q and e >= first], default=100)
        for r in heard:
            if r[3] <= cut:
                want[q, r[2]] = min(want.get((q, r[2]), 10**9), r[3])
    got = merge.first_answer(
        spark.createDataFrame(results, "query_id string, source int, id string, arrival int"),
        spark.createDataFrame(finishes, "query_id string, source int, finished_at int"), 100).collect()
    assert {(r.query_id, r.id): r.arrival for r in got} == want


def test_empty_newest_list_hides_the_older_one(spark):
    rows = [("a", "r1", 10, "i1", [["relay", "wss://x"]]), ("a", "r1", 20, "i2", []), ("a", "r2", 5, "i3", [["relay", "wss://y"]]),
            ("b", "r1", 9, "i4", [["relay", "https://no"]])]
    df = spark.createDataFrame(rows, "pubkey string, relay string, created_at long, id string, tags array<array<string>>")
    got = latest_inbox_list(df.withColumn("kind", F.lit(10050))).collect()
    assert [(r.pubkey, r.relays) for r in got] == [("a", ["wss://y"])]


def test_subscription_matching_equals_single_filters(spark):
    rng = random.Random(10)
    events = [(f"{i:04x}", pick_key(rng, 5), rng.randrange(100), rng.choice([1, 14, 1059]),
               [["p", f"x{rng.randrange(4)}"], ["t", f"y{rng.randrange(3)}"]], "", None) for i in range(200)]
    filters = [
        EventFilter(), EventFilter(kinds=[]), EventFilter(ids=["0001", "0002", "0001"]), EventFilter(authors=["hot"], since=50),
        EventFilter(kinds=[14, 1059], until=40), EventFilter(tags={"p": ["x1", "x2"], "t": ["y0"]}), EventFilter(tags={"t": []}),
        EventFilter(ids=[]), EventFilter(kinds=[1], tags={"p": ["x0"]}, authors=["k1", "hot"]),
    ]
    subs = [(f"s{n // 2}", n % 2, f.ids, f.authors, f.kinds, f.tags, f.since, f.until, f.limit) for n, f in enumerate(filters)]
    e = spark.createDataFrame(events, "id string, pubkey string, created_at long, kind int, tags array<array<string>>, content string, sig string")
    s = spark.createDataFrame(subs, "sub_id string, filter_no int, ids array<string>, authors array<string>, kinds array<int>, "
                                    "tags map<string,array<string>>, since long, until long, lim int")
    want = {(f"s{n // 2}", r.id) for n, f in enumerate(filters) if f != EventFilter() for r in filter_events(e, f).select("id").collect()}
    got = match_subscriptions(e, s).collect()
    assert {(r.sub_id, r.id) for r in got} == want and len(got) == len(want)
    assert [r.sub_id for r in match_all_subscriptions(s).collect()] == ["s0"]
    assert match_subscriptions(e.limit(0), s).count() == 0


def test_unknown_tag_values_match_nothing(spark):
    e = spark.createDataFrame([("e", "k", 5, 1, [["a", "x"], ["b", "y"]])], "id string, pubkey string, created_at long, kind int, tags array<array<string>>")
    none = [None] * 3
    subs = [("null in list", *none, {"a": ["x"], "b": ["z", None]}, None, None), ("null list", *none, {"a": ["x"], "b": None}, None, None),
            ("hit", *none, {"a": ["x"], "b": ["y", None]}, None, None), ("old", *none, None, None, 3), ("open", *none, None, 4, None)]
    s = spark.createDataFrame(subs, "sub_id string, ids array<string>, authors array<string>, kinds array<int>, "
                                    "tags map<string,array<string>>, since long, until long")
    assert {r.sub_id for r in match_subscriptions(e, s).collect()} == {"hit", "open"}


def test_long_times_are_few_stretches(spark):
    rng = random.Random(5)
    pairs = [(19_000, 19_000 + 20 * 365), (0, 0), (5, 4), (7, 8), (19_716, 19_746), (1, 32_766)]
    pairs += [(a, a + rng.choice([0, 1, 2, 5, 30, 400])) for a in (rng.randrange(25_000) for _ in range(80))]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", filters.dyadic_days(F.col("a"), F.col("b")).alias("s")).collect()
    for r in rows:
        days = [d for level, key in r.s for d in range(key << level, (key + 1) << level)]
        assert sorted(days) == list(range(r.a, r.b + 1)), (r.a, r.b)
        assert len(r.s) <= 30
    assert max(len(r.s) for r in rows) > 5


def test_hot_kinds_are_salted_and_times_matched(spark):
    """One kind holds most events; filters by kind alone, by time alone, and of kinds that don't occur."""
    i = F.col("n")
    e = spark.range(3000).toDF("n").select(
        F.concat(F.lit("e"), i.cast("string")).alias("id"), F.lit("p").alias("pubkey"), (1_700_000_000 + i * 40_000).alias("created_at"),
        F.when(i % 10 == 0, (i % 7).cast("int")).otherwise(42).alias("kind"), F.array().cast("array<array<string>>").alias("tags"))
    part = "sub_id string, ids array<string>, authors array<string>, kinds array<int>, tags map<string,array<string>>, since long, until long"
    subs = [("hot", None, None, [42], None, None, None), ("rare", None, None, [3, 99], None, None, None), ("never", None, None, [99], None, None, None),
            ("from", None, None, None, None, 1_750_000_000, None), ("to", None, None, None, None, None, 1_700_100_000),
            ("both", None, None, None, None, 1_710_000_000, 1_760_000_001), ("none", None, None, None, None, 5, 6)]
    got = match_subscriptions(e, spark.createDataFrame(subs, part), salts=8).collect()
    rows = e.collect()
    want = {(s[0], r.id) for s in subs for r in rows if (s[3] is None or r.kind in s[3]) and (s[5] or 0) <= r.created_at <= (s[6] or 1 << 60)}
    assert {(r.sub_id, r.id) for r in got} == want and len(got) == len(want)


def test_acceptance_by_table_equals_the_literal_form(spark):
    e = with_event_id(spark.range(60).select(
        F.sha2((F.col("id") % 3).cast("string"), 256).alias("pubkey"), (F.col("id") * 10).alias("created_at"), (F.col("id") % 4).cast("int").alias("kind"),
        F.array(F.array(F.lit("p"), (F.col("id") % 5).cast("string"))).alias("tags"), F.lit("x").alias("content"),
        F.element_at(F.array(*map(F.lit, ["a", "b", "c", "d"])), (F.col("id") % 4 + 1).cast("int")).alias("sub_id"),
        F.when(F.col("id") % 7 != 0, F.repeat(F.lit("ab"), 64)).alias("sig"), (F.col("id") % 5 != 0).alias("sig_ok")))
    e = e.withColumn("id", F.when(F.col("created_at") % 110 == 0, F.lit("00" * 32)).otherwise(F.col("id")))
    wanted = {"a": [EventFilter(kinds=[0], since=100), EventFilter(tags={"p": ["1"]})], "b": [EventFilter(until=300)], "c": [EventFilter(kinds=[])]}
    rows = [(s, f.ids, f.authors, f.kinds, f.tags, f.since, f.until) for s, fs in wanted.items() for f in fs]
    table = spark.createDataFrame(rows + [(None, None, None, None, None, None, None)],
                                  "sub_id string, ids array<string>, authors array<string>, kinds array<int>, tags map<string,array<string>>, since long, until long")
    both = [sorted((r.created_at, r.reason) for r in validation.accept_events(e, s).collect()) for s in (wanted, table)]
    assert both[0] == both[1] and len({r for _, r in both[0]}) == 5


def test_plain_text_search_equals_contains(spark):
    rng = random.Random(11)
    words = ["ab", "abc", "b", "ca", "cab", "ba  c", "x\ny"]
    contents = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(120)]
    known = []
    for i in range(60):
        text = rng.choice(contents)[1]
        a = rng.randrange(len(text))
        known.append((i, text[a:a + rng.choice([1, 2, 3, 5, 9, 30, 60])] if i % 5 else "zzz" + text[:3]))
    known.append((99, ""))
    want = {(i, k) for i, c in contents for k, t in known if t and t in c}
    got = audit.plaintext_leaks(
        spark.createDataFrame(contents, "id long, content string"), spark.createDataFrame(known, "item_id long, plaintext string")).collect()
    assert {(r.id, r.item_id) for r in got} == want and len(got) == len(want)


def test_plain_text_search_at_all_lengths(spark):
    """Texts just below, at and above each size class, cut out of contents of one letter, of few letters and beyond the basic plane."""
    rng = random.Random(12)
    contents = [(0, "a" * 90), (1, "".join(rng.choice("ab") for _ in range(300))), (2, "".join(rng.choice("é𝒳x\n") for _ in range(200))), (3, ""), (4, None)]
    known = [(1000 * i + 10 * n + k, contents[i][1][a:a + n]) for i in range(3) for n in (1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64)
             for k, a in enumerate((0, 5, 20))]
    known += [(9000 + n, "b" + "a" * n) for n in range(40)]
    want = {(i, k) for i, c in contents for k, t in known if t in (c or "")}
    got = audit.plaintext_leaks(
        spark.createDataFrame(contents, "id long, content string"), spark.createDataFrame(known, "item_id long, plaintext string")).collect()
    assert {(r.id, r.item_id) for r in got} == want and len(got) == len(want)


def test_contents_are_looked_up_by_few_keys(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    long = spark.createDataFrame([("x" * 40,), ("y" * 500,)], "plaintext string")
    characters = docs.agg(F.sum(F.length("content"))).first()[0]
    keys = audit.content_keys(docs, long)
    assert 0.1 * characters < keys.count() < 0.25 * characters
    # A short text adds keys of its own class and leaves the others as they are.
    both = audit.content_keys(docs, long.union(spark.createDataFrame([("ab",)], "plaintext string")))
    assert keys.exceptAll(both).isEmpty()
    pairs = docs.select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("(?s)(?=(..))"), F.lit(1)))))
    assert both.count() - keys.count() == pairs.count()


def test_long_texts_of_words_are_looked_up_by_words(spark):
    """Texts cut anywhere out of contents with repeated, leading and trailing spaces; contents give a key for each word at most."""
    rng = random.Random(13)
    parts = ["", "a", "bb", "x\ny", "é𝒳", "longer-word"]
    contents = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 80)))) for i in range(60)] + [(60, " " * 100), (61, ""), (62, None)]
    known = [(1, " " * 40), (2, "a " * 30)]
    for i in range(10, 60):
        text = contents[i][1]
        a = rng.randrange(len(text) + 1)
        known.append((i, text[a:a + rng.choice([32, 40, 70])] + ("!" if i % 9 == 0 else "")))
    want = {(i, k) for i, c in contents for k, t in known if t and t in (c or "")}
    docs = spark.createDataFrame(contents, "id long, content string")
    got = audit.plaintext_leaks(docs, spark.createDataFrame(known, "item_id long, plaintext string")).collect()
    assert {(r.id, r.item_id) for r in got} == want and len(got) == len(want)
    long = spark.createDataFrame([("some words of a long text that is known",)], "plaintext string")
    assert audit.content_keys(docs, long).count() <= sum(len(c.split(" ")) for _, c in contents if c)


def test_merge_keeps_the_earliest_copy(spark):
    rows = [("a", 1, 5), ("a", 2, 3), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "id string, relay int, arrival int")
    got = merge.merge_relays(df.filter("relay = 1"), df.filter("relay = 2"), arrival=["arrival", "relay"]).collect()
    assert {(r.id, r.relay) for r in got} == {("a", 2), ("b", 1)}
    assert merge.merge_relays(df, df).count() == 2


def test_relay_changes_need_one_relay(spark):
    old = spark.createDataFrame([("wss://a/",), ("wss://b",)], "url string")
    new = spark.createDataFrame([("wss://A",), ("wss://c",), ("junk",)], "url string")
    assert {(r.url, r.change) for r in merge.relay_changes(old, new).collect()} == {
        ("wss://a", "kept"), ("wss://b", "removed"), ("wss://c", "added")}
    with pytest.raises(Exception, match="at least one relay"):
        merge.relay_changes(old, new.filter("url = 'junk'")).collect()
    with pytest.raises(Exception, match="at least one relay"):
        merge.relay_changes(new.filter("url = 'junk'"), new.filter("url = 'junk'")).collect()


def test_upload_outcomes(spark):
    sha = "ab" * 32
    rows = [
        ("f", sha, 0, "https://One.example/", 0, 415, "no", None, None), ("f", sha, 0, "https://One.example/", 1, 200, "OK", sha.upper(), None),
        ("f", sha, 1, "https://two.example", 0, 503, "", None, None), ("f", sha, 2, "https://three.example", 0, 200, "OK", "00" * 32, None),
        ("f", sha, 3, "https://four.example", 0, 200, "OK", None, "https://CDN.example/x"), ("g", sha, 0, "https://one.example", 0, 400, "bad", None, None),
    ]
    df = spark.createDataFrame(rows, "file_id string, sent_sha string, server_pos int, server string, label_pos int, status int, "
                                     "reason string, reported_sha string, url string")
    got = {r.file_id: r for r in attachments.upload_results(df).collect()}
    assert got["f"].urls == [f"https://One.example/{sha}", "https://cdn.example/x"]
    assert got["f"].errors == ["two.example: 503", "three.example: changed the file"]
    assert (got["f"].primary_url, got["f"].fallbacks, got["f"].status) == (got["f"].urls[0], got["f"].urls[1:], "Uploaded")
    assert (got["g"].urls, got["g"].errors, got["g"].status) == ([], ["one.example: 400 bad"], "Failed")
