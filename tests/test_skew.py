"""One key holding a third of all rows must not end up in one task."""

import pytest
from pyspark.sql import functions as F

from whisperlake.operators import conversations, inbox, ordered
from whisperlake.session import work_dir

N = 300_000


@pytest.fixture(scope="module")
def tables(spark):
    """Messages of which a third belong to one peer, spread over a month."""
    path = work_dir(spark, "skew")
    i = F.col("id")
    peer = F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (i % 1000).cast("string")))
    spark.range(N).select(
        F.concat(F.lit("m"), i.cast("string")).alias("id"), i.alias("seq"), peer.alias("peer"),
        (F.lit(1_704_067_200) + i * 9 % (30 * 86_400)).alias("created_at"),
        F.when(i % 4 == 0, "Sent").otherwise("Received").alias("status"), F.sha2(i.cast("string"), 256).alias("text"),
    ).repartition(8).write.parquet(f"{path}/messages")
    messages = spark.read.parquet(f"{path}/messages")
    contacts = messages.select(F.col("peer").alias("pubkey")).distinct().withColumn("last_read_at", F.lit(1_704_067_200 + 86_400))
    contacts.write.parquet(f"{path}/contacts")
    return messages, spark.read.parquet(f"{path}/contacts")


@pytest.fixture
def small_thresholds(spark):
    """Makes a few megabytes count as skewed, and forbids broadcasts that would avoid the shuffle."""
    values = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_peer_is_split_in_the_unread_join(spark, tables, small_thresholds):
    unread = conversations.unread_counts(*tables)
    plan = final_plan(unread)
    assert "skew=true" in plan, plan[:3000]
    n = {r.peer: r.unread_count for r in unread.collect()}
    m = tables[0].filter("status = 'Received' and created_at > 1704153600").groupBy("peer").count().collect()
    assert n == {r.peer: r["count"] for r in m}


def test_hot_peer_is_split_in_the_block_log_join(spark, tables, small_thresholds):
    log = spark.createDataFrame([("hot", 1_704_067_200 + 86_400, True), ("hot", 1_704_067_200 + 2 * 86_400, False)],
                                "peer string, changed_at long, blocked boolean")
    kept = inbox.drop_blocked(tables[0], log)
    plan = final_plan(kept.select("id"))
    assert "skew=true" in plan, plan[:3000]
    lost = tables[0].filter(
        "peer = 'hot' and status = 'Received' and created_at >= 1704153600 and created_at < 1704240000").count()
    assert kept.count() == N - lost


def test_timeline_spreads_a_hot_peer(spark, tables, monkeypatch):
    """Window partitions are (peer, range), so the largest holds a small part of the hot peer."""
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 2000)
    marked = conversations.timeline(tables[0])
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan
    sizes = ordered.in_range_buckets(tables[0], ["peer"], "created_at", "id").groupBy("peer", "_bucket").count().collect()
    assert max(r["count"] for r in sizes) < 4000 and sum(r.peer == "hot" for r in sizes) > 40
    assert {r._bucket for r in sizes if r.peer != "hot"} == {0}
    groups = conversations.with_group_numbers(marked)
    top = groups.filter("peer = 'hot'").agg(F.max("group_no"), F.sum(F.col("starts_group").cast("int"))).first()
    assert top[0] == top[1]


def test_hot_hour_is_split_by_rows(spark, monkeypatch):
    """Half of a peer's rows lie within one hour, many of them within one second; the result is that of one window over the whole peer."""
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 1000)
    i = F.col("id")
    at = F.when(i % 2 == 0, 1_704_067_200 + F.when(i % 6 == 0, 77).otherwise(i * 13 % 3600)).otherwise(1_704_067_200 + i * 9973 % (30 * 86_400))
    rows = spark.range(40_000).select(
        F.sha2(i.cast("string"), 256).alias("id"), F.when(i % 4 == 3, "q").otherwise("hot").alias("peer"), at.alias("created_at"),
        F.when(F.xxhash64(i) % 4 == 0, "Sent").otherwise("Received").alias("status"))
    path = work_dir(spark, "hour")
    rows.unionByName(spark.createDataFrame([("x", "hot", None, "Sent")], "id string, peer string, created_at long, status string")).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = ordered.in_range_buckets(rows, ["peer"], "created_at", "id").filter("peer = 'hot'").groupBy("_bucket").count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) <= 2 * sum(r["count"] for r in sizes) / len(sizes)
    got = {r.id: (r.new_day, r.starts_group, r.group_no) for r in conversations.with_group_numbers(conversations.timeline(rows)).collect()}
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 1 << 30)
    whole = conversations.with_group_numbers(conversations.timeline(rows))
    assert got == {r.id: (r.new_day, r.starts_group, r.group_no) for r in whole.collect()}


def test_restless_block_log_is_swept(spark, monkeypatch):
    """A key with thousands of changes: no message is compared with its stretches, and the result is the same."""
    i = F.col("id")
    log = spark.range(9000).select(
        F.when(i % 3 == 0, "calm").otherwise("hot").alias("peer"), F.when(i % 3 == 0, i % 7 * 1000).otherwise(i * 7 % 20_000 + i % 2).alias("changed_at"),
        (F.xxhash64(i) % 2 == 0).alias("blocked"))
    messages = spark.range(20_000).select(
        i, F.element_at(F.array(*map(F.lit, ("calm", "hot", "none"))), (i % 3 + 1).cast("int")).alias("peer"), (i * 31 % 21_000).alias("created_at"),
        F.when(i % 5 == 0, "Sent").otherwise("Received").alias("status"))
    messages = messages.unionByName(spark.createDataFrame(
        [(-1, None, 5, "Received"), (-2, "hot", None, "Received")], "id long, peer string, created_at long, status string"))
    compared = []
    outside = inbox._outside
    monkeypatch.setattr(inbox, "_outside", lambda m, spans, *a: compared.append(spans) or outside(m, spans, *a))
    got = sorted(r.id for r in inbox.drop_blocked(messages, log).collect())
    assert {r.peer for r in compared[0].collect()} == {"calm"}
    monkeypatch.setattr(inbox, "MOST_CHANGES", 1 << 30)
    assert got == sorted(r.id for r in inbox.drop_blocked(messages, log).collect())
    assert {-1, -2} < set(got) and len(got) < 20_000
