"""Events whose number is also that of their author: the key that seals every 31st event is then the author's own."""

import datetime

import duckdb

import __spark_entry__ as entry
from whisperlake.plans.views import H
from whisperlake.session import work_dir


def test_a_seal_of_the_author_is_no_impersonation(spark):
    folder, at = work_dir(spark, "own-numbers"), datetime.datetime(2024, 1, 2)
    rows = [(n, at, u, "view", 1.0, '{"k": 5}') for n, u in ((31, 31), (62, 5), (31 * 37, 31 * 37), (7, 7))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet/*.parquet')")
    ours = entry.queries()["j2_authenticate_layers"](spark, folder).select("wrap_id", "reason", "rumor_id").collect()
    theirs = con.execute(f"select wrap_id, reason, rumor_id from ({entry.oracle_sql()['j2_authenticate_layers']})").fetchall()
    assert sorted(map(tuple, ours)) == sorted(theirs)
    wraps = {r.h: r.n for r in spark.range(3_000_000, 3_002_000).select("id", H("id").alias("h")).withColumnRenamed("id", "n").collect()}
    reasons = {wraps[r.wrap_id] - 3_000_000: r.reason for r in ours}
    assert reasons == {31: "ok", 62: "impersonation", 31 * 37: "bad rumor id", 7: "ok"}
