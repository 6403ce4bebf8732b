"""A batch of the delivery stream deals its rows by message only, however they are grouped and joined after that."""

import re

from whisperlake.streaming import delivery


def test_rows_are_dealt_by_message_only(spark):
    own = spark.newSession()
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        own.conf.set(name, "-1")
    rows = own.createDataFrame([(1, 0, 1, 100, None, None, None), (1, 0, None, None, True, "", 105), (2, 0, 1, 100, None, None, None)], delivery._LOG)
    found = delivery._summary(delivery._dealt(rows), 30)
    assert sorted((r.message_id, r.n_accepted, r.n_targets) for r in found.collect()) == [(1, 1, 1), (2, 0, 1)]
    dealt = re.findall(r"hashpartitioning\(([^)]*), \d+\)", found._jdf.queryExecution().executedPlan().toString())
    assert dealt and all(re.fullmatch(r"message_id#\d+L", k) for k in dealt)
