"""Every query against its SQL on the smallest tables, and a look at every plan."""

import re

import pytest
from check_oracles import compare, connect
from conftest import SMALL

import __spark_entry__ as entry
from whisperlake.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


# Queries of the optional package are tested beside it.
OWN = list(QUERIES)


@pytest.mark.parametrize("name", OWN)
def test_same_rows_as_sql(spark, con, name):
    assert name in entry.oracle_sql()
    ok, note = compare(spark, con, SMALL, name)
    assert ok, note


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    stamps = [r.last_at for r in rows]
    assert rows and stamps == sorted(stamps, reverse=True)


@pytest.mark.parametrize("name", [n for n in OWN if n[0] in "fjawxc"])
def test_plans_stay_distributed(spark, name):
    """No cross product, no nested loop and no Python worker, even when nothing may be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoop|Python|Window .*\[\], ", plan)


def test_filters_and_columns_reach_the_scan(spark):
    from whisperlake.operators.filters import EventFilter, filter_events
    from whisperlake.session import work_dir

    from whisperlake.plans import views

    path = work_dir(spark, "events")
    views.events(spark, SMALL).write.parquet(path)
    wanted = EventFilter(kinds=[14], since=1_704_100_000)
    found = filter_events(spark.read.parquet(path), wanted).select("id")
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "EqualTo(kind,14)" in pushed or "In(kind" in pushed
    assert "GreaterThanOrEqual(created_at" in pushed
    assert "content" not in re.search(r"ReadSchema: (.*)", plan).group(1)
