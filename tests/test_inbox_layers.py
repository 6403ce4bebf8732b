"""The inbox fold authenticates as the operator for single reasons does, and opens layers only for what is new."""

from conftest import SMALL
from pyspark.sql import functions as F
from test_streams import AUTHOR, chain, write

from whisperlake.functions.text import packed, unpacked
from whisperlake.operators import inbox
from whisperlake.plans import views
from whisperlake.session import work_dir
from whisperlake.sources import feed
from whisperlake.streaming import inbox as stream_inbox


def test_authentic_rumors_are_those_without_a_reason(spark):
    wraps, seals, rumors = views.layers(spark, SMALL)
    n = F.col("event_id") % 41
    wraps = wraps.withColumn("kind", F.when(n == 1, 1).when(n != 2, F.col("kind"))).withColumn("wrap_ok", F.when(n == 3, False).when(n != 4, True)).withColumn(
        "seal_id", F.when(n == 5, "x").when(n != 6, F.col("seal_id")))
    seals = seals.withColumn("pubkey", F.when(F.col("id") > "1", F.col("pubkey"))).union(seals.limit(20))
    flat = lambda df: sorted(map(str, df.select("wrap_id", "wrap_kind", "owner", "arrival", "rumor").collect()))
    want = flat(inbox.authenticate_layers(wraps, seals, rumors).filter("reason is null"))
    assert flat(inbox.authentic_rumors(wraps, seals, rumors)) == want and 500 < len(want) < 1000


def test_packed_texts(spark):
    texts = ["ab" * 32, "AB" * 32, "", None, "\1" + "x" * 32, "é", "ab", "\0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed("t").alias("p"))
    rows = df.select("t", "p", unpacked("p").alias("u")).collect()
    assert [r.u for r in rows] == texts and len({bytes(r.p) for r in rows if r.p is not None}) == len(texts) - 1
    assert [len(r.p) for r in rows if r.t == "ab" * 32] == [33]


def test_a_batch_without_news_opens_no_layers(spark):
    """Repeats are handled without a look at their layers, which fail to be read here."""
    path, read = work_dir(spark, "news"), []
    schema = "id string, pubkey string, kind int, wrap_ok boolean, seal_id string, owner string, arrival long"
    wraps, seals, rumors = chain(spark, [("w1", "o", 5), ("w2", "q", 6)])
    broken = rumors.withColumn("content", F.raise_error(F.lit("read")))
    rows = [tuple(r) for r in wraps.collect()]
    none, log = spark.createDataFrame([], "id string"), spark.createDataFrame([], "owner string, peer string, changed_at long, blocked boolean")
    for again in range(2):
        write(spark, rows, schema, f"{path}/in")
        stream_inbox.stream_inbox(
            feed.stream_events(spark, f"{path}/in", wraps.schema), lambda _: (seals, broken if again else rumors), none, log, f"{path}/store", f"{path}/cp",
            on_change=lambda df, n: read.append(df.count())).awaitTermination()
    assert read == [2, 0]


def test_removals_are_sent_to_the_log(spark):
    """Few removals are known to be few, so the log is not dealt by peer for them."""
    from whisperlake.operators.messages import apply_message_changes

    schema = "seq long, op string, id string, old_id string, peer string, status string"
    log = spark.createDataFrame([(0, "add", "a", None, AUTHOR, "x"), (1, "remove", None, None, AUTHOR, None), (2, "add", "b", None, AUTHOR, "y"), (3, "add", "c", None, "P", "z")], schema)
    state = spark.createDataFrame([("d", AUTHOR, "s")], "id string, peer string, status string")
    folded = apply_message_changes(state, log)
    assert sorted(map(tuple, folded.collect())) == [("b", AUTHOR, "y"), ("c", "P", "z")]
    plan = folded._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
