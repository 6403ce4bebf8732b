"""Merging copies of the log from many relays, and comparing sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.functions.urls import RELAY_SCHEMES, normalize_relay_url, relay_url_valid
from whisperlake.schemas import CATCH_UP_SECONDS


def merge_relays(*sources: DataFrame, arrival: list[str] | None = None) -> DataFrame:
    """One row per event id over all sources.

    Validate ids first (:func:`valid_event_ids`): otherwise a forged copy could hide the real
    event. With ``arrival`` (ordering columns) the earliest copy wins, else any copy. Both
    forms reduce repeats inside every task before the shuffle.
    """
    copies = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    if arrival is None:
        return copies.dropDuplicates(["id"])
    first = F.min_by(F.struct(*[F.col(c) for c in copies.columns]), F.struct(*[F.col(c) for c in arrival]))
    return copies.groupBy("id").agg(first.alias("copy")).select("copy.*")


def unprocessed(events: DataFrame, processed: DataFrame) -> DataFrame:
    """Events whose id was not handled before."""
    return events.join(processed.select("id"), "id", "left_anti")


def relay_changes(old: DataFrame, wanted: DataFrame, schemes: tuple[str, ...] = RELAY_SCHEMES) -> DataFrame:
    """Per normalised relay: removed, added or kept. Fails when nothing valid is wanted."""

    def clean(df: DataFrame) -> DataFrame:
        return df.filter(relay_url_valid("url", schemes)).select(normalize_relay_url("url").alias("url")).distinct()

    new = clean(wanted)
    sides = clean(old).withColumn("was", F.lit(True)).join(new.withColumn("is", F.lit(True)), "url", "full_outer")
    changes = sides.select(
        "url",
        F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("kept").alias("change"),
    )
    # The one row of the count is tested even if there are no relays at all; it never becomes a result.
    none = F.lit(None).cast("string")
    check = new.agg(F.count(F.lit(1)).alias("n")).filter(
        F.when(F.col("n") == 0, F.raise_error(F.lit("at least one relay is required")).cast("boolean")).otherwise(F.lit(False)))
    return changes.union(check.select(none, none))


def sync_high_water(eose: DataFrame, previous: DataFrame) -> DataFrame:
    """Per subscription, the latest time the stored part was complete; never moves back.

    ``eose`` has sub_id and seen_at, ``previous`` has sub_id and last_sync_at.
    """
    seen = eose.groupBy("sub_id").agg(F.max("seen_at").alias("seen_at"))
    return seen.join(previous, "sub_id", "full_outer").select(
        "sub_id", F.greatest("seen_at", "last_sync_at").alias("last_sync_at")
    )


def catch_up_bound(last_sync_at: Column) -> Column:
    """Lower time bound for the next catch-up; null (no bound) when never synced."""
    return F.when(last_sync_at > 0, last_sync_at - CATCH_UP_SECONDS)


def first_answer(results: DataFrame, finishes: DataFrame, timeout: int) -> DataFrame:
    """Replays "stop at the first finished source once anything has arrived".

    ``results``: query_id, source, id, arrival; ``finishes``: query_id, source, finished_at
    (null = never); all times relative to the start of the query, in the unit of ``timeout``.
    A source is no longer heard after it finished. The source whose end stops the query need
    not be the one that delivered.
    """
    ends = finishes.select("query_id", "source", F.least(
        F.coalesce("finished_at", F.lit(timeout)), F.lit(timeout)).alias("end"))
    heard = results.join(ends, ["query_id", "source"], "left").filter(
        F.col("arrival") <= F.coalesce("end", F.lit(timeout)))
    first = heard.groupBy("query_id").agg(F.min("arrival").alias("first_arrival"))
    stops = (
        first.join(ends, "query_id", "left")
        .groupBy("query_id")
        .agg(F.min(F.when(F.col("end") >= F.col("first_arrival"), F.col("end"))).alias("answered"))
        .select("query_id", F.coalesce("answered", F.lit(timeout)).alias("cut_off"))
    )
    kept = heard.join(stops, "query_id").filter(F.col("arrival") <= F.col("cut_off"))
    return kept.groupBy("query_id", "id").agg(F.min("arrival").alias("arrival"), F.min("cut_off").alias("cut_off"))
