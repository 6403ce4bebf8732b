"""Declarative event filters, bounded fetches, visibility and subscription matching."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.functions.events import tag_values
from whisperlake.schemas import KIND_GIFT_WRAP

_DAY = 86_400


@dataclass(frozen=True)
class EventFilter:
    """All given parts must hold. ``None`` is no constraint; an empty list matches nothing."""

    ids: list[str] | None = None
    authors: list[str] | None = None
    kinds: list[int] | None = None
    tags: dict[str, list[str]] | None = None
    since: int | None = None
    until: int | None = None
    limit: int | None = None

    def matches(self) -> Column:
        """The filter as one predicate; ``limit`` is not part of matching."""
        tests = [F.lit(True)]
        for column, allowed in (("kind", self.kinds), ("id", self.ids), ("pubkey", self.authors)):
            if allowed is not None:
                tests.append(F.col(column).isin(list(allowed)) if allowed else F.lit(False))
        if self.since is not None:
            tests.append(F.col("created_at") >= self.since)
        if self.until is not None:
            tests.append(F.col("created_at") <= self.until)
        for name, values in (self.tags or {}).items():
            wanted = F.array(*map(F.lit, values)).cast("array<string>")
            tests.append(F.arrays_overlap(tag_values("tags", name), wanted) if values else F.lit(False))
        return reduce(Column.__and__, tests)

    def to_json(self) -> str:
        """Request form, fixed key order, absent parts left out."""
        parts = {"ids": self.ids, "authors": self.authors, "kinds": self.kinds}
        parts |= {f"#{name}": values for name, values in (self.tags or {}).items()}
        parts |= {"since": self.since, "until": self.until, "limit": self.limit}
        given = {k: v for k, v in parts.items() if v is not None}
        return json.dumps(given, separators=(",", ":"), ensure_ascii=False)


def any_matches(filters: list[EventFilter]) -> Column:
    return reduce(Column.__or__, [f.matches() for f in filters], F.lit(False))


def filter_events(events: DataFrame, flt: EventFilter) -> DataFrame:
    return events.filter(flt.matches())


def fetch_events(events: DataFrame, filters: list[EventFilter]) -> DataFrame:
    """Newest matches of each filter up to its own limit, without repeats, newest first."""
    newest = [F.col("created_at").desc(), F.col("id")]

    def branch(flt: EventFilter) -> DataFrame:
        hits = filter_events(events, flt)
        return hits if flt.limit is None else hits.orderBy(*newest).limit(flt.limit)

    if not filters:
        return events.limit(0)
    found = reduce(DataFrame.unionByName, map(branch, filters))
    return found.dropDuplicates(["id"]).orderBy(*newest)


def readable_by(events: DataFrame, reader: str | Column) -> DataFrame:
    """Gift wraps only for a reader named in a ``p`` tag; everything else for anyone."""
    return events.filter((F.col("kind") != KIND_GIFT_WRAP) | F.array_contains(tag_values("tags", "p"), reader))


def wraps_for_readers(events: DataFrame, readers: DataFrame) -> DataFrame:
    """Table form: one row per (reader, gift wrap) the reader may see; ``readers`` has one ``reader`` column."""
    wraps = events.filter(F.col("kind") == KIND_GIFT_WRAP)
    named = wraps.withColumn("reader", F.explode(F.array_distinct(tag_values("tags", "p"))))
    return named.join(readers.select("reader"), "reader", "left_semi")


def find_by_key(df: DataFrame, column: str, value: str) -> DataFrame:
    """None or one row; the comparison reaches the Parquet scan."""
    return df.filter(F.col(column) == value)


def lookup_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Bulk form of :func:`find_by_key`; ``keys`` has a column of the same name."""
    return df.join(keys.select(column), column, "left_semi")


def _day(at: Column | str) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / _DAY).cast("bigint")


# Levels of dyadic stretches of days: one of level k is 2^k days long and begins at a multiple of that. Together they reach over 89 years.
_LEVELS = 15


def dyadic_days(low: Column, high: Column) -> Column:
    """The days from ``low`` to ``high`` as few stretches (level, key): at most two of each level, whatever the length.

    Going up, an odd first stretch and an even last one are taken; what is left between them is made of whole stretches of the next level.
    """
    def stretch(level: Column, key: Column) -> Column:
        return F.struct(level.alias("level"), key.cast("bigint").alias("key"))

    def step(s: Column, level: Column) -> Column:
        low, high = s["low"], s["high"]
        top = level == _LEVELS - 1
        left = F.when((low <= high) & ~top & (low % 2 != 0), stretch(level, low))
        right = F.when((low <= high) & ~top & (high % 2 == 0) & ((low % 2 == 0) | (low < high)), stretch(level, high))
        rest = F.when((low <= high) & top, F.transform(F.sequence(low, high), lambda k: stretch(level, k)))
        found = F.concat(s["found"], F.array_compact(F.array(left, right)), F.coalesce(rest, F.array().cast(_STRETCHES)))
        after = low + F.when(left.isNotNull(), 1).otherwise(0)
        ahead = high - F.when(right.isNotNull(), 1).otherwise(0)
        # Nothing left stays nothing: halving 5 to 4 would make it 2 to 2.
        return F.struct(
            F.when(after <= ahead, F.floor(after / 2)).otherwise(1).cast("bigint").alias("low"),
            F.when(after <= ahead, F.floor(ahead / 2)).otherwise(0).cast("bigint").alias("high"), found.alias("found"))

    start = F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), F.array().cast(_STRETCHES).alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(_LEVELS - 1)), start, step, lambda s: s["found"])


_STRETCHES = "array<struct<level:int,key:bigint>>"


def _routes(salts: Column, first_day: Column, last_day: Column) -> Column:
    """The join keys of one subscription filter, taken from its most selective part; none for a filter without any part."""

    def keys(route: Column | str, values: Column) -> Column:
        name = F.lit(route) if isinstance(route, str) else route
        return F.transform(F.array_distinct(values), lambda v: F.struct(
            name.alias("route"), v.cast("string").alias("key"), F.lit(0).alias("salt")))

    def salted(route: str, values: Column) -> Column:
        return F.flatten(F.transform(F.array_distinct(values), lambda v: F.transform(
            F.sequence(F.lit(0), _salts_of(salts, v) - 1),
            lambda s: F.struct(F.lit(route).alias("route"), v.cast("string").alias("key"), s.alias("salt")))))

    tag = F.array_min(F.map_keys("tags"))
    low = F.greatest(_day(F.coalesce("since", first_day * _DAY)), first_day)
    high = F.least(_day(F.coalesce("until", last_day * _DAY)), last_day)
    return (
        F.when(F.col("ids").isNotNull(), keys("id", F.col("ids")))
        .when(F.coalesce(F.size("tags"), F.lit(0)) > 0,
              keys(F.concat(F.lit("#"), tag), F.element_at(F.col("tags"), tag)))
        .when(F.col("authors").isNotNull(), keys("author", F.col("authors")))
        .when(F.col("kinds").isNotNull(), salted("kind", F.col("kinds")))
        .when((F.col("since").isNotNull() | F.col("until").isNotNull()) & (low <= high), F.transform(
            dyadic_days(low, high), lambda d: F.struct(
                F.concat(F.lit("day"), d["level"].cast("string")).alias("route"), d["key"].cast("string").alias("key"), F.lit(0).alias("salt"))))
    )


def _salts_of(salts: Column, kind: Column) -> Column:
    return F.coalesce(F.try_element_at(salts, kind.cast("int")), F.lit(1))


def row_matches(part: Callable[[str], Column]) -> Column:
    """Whether an event matches a filter that is a row: ``part`` gives its ids, authors, kinds, tags, since and until (null: no constraint)."""
    def allowed(listing: str, value: str) -> Column:
        return part(listing).isNull() | F.array_contains(part(listing), F.col(value))

    return (
        allowed("ids", "id") & allowed("authors", "pubkey") & allowed("kinds", "kind")
        & (F.col("created_at") >= F.coalesce(part("since"), F.col("created_at")))
        & (F.col("created_at") <= F.coalesce(part("until"), F.col("created_at")))
        # An unknown overlap (a null list, or nulls in it) is no match.
        & (part("tags").isNull() | F.forall(F.map_entries(part("tags")), lambda e: F.coalesce(F.arrays_overlap(
            tag_values("tags", e["key"]), e["value"]), F.lit(False))))
    )


def match_all_subscriptions(subs: DataFrame) -> DataFrame:
    """Subscriptions with a filter without any part: they match every event, so no pairs are made for such a filter."""
    free = F.coalesce(F.size("tags"), F.lit(0)) <= 0
    for c in ("ids", "authors", "kinds", "since", "until"):
        free = free & F.col(c).isNull()
    return subs.filter(free).select("sub_id").distinct()


def match_subscriptions(events: DataFrame, subs: DataFrame, salts: int | None = None) -> DataFrame:
    """One row (sub_id, id) for every event that some filter of a subscription matches.

    Each filter is joined on exactly one of its parts: ids, a tag, authors, kinds, or the time that it is open; the rest is
    tested on the pair. Filters without any part are left to :func:`match_all_subscriptions`. Times are dyadic stretches of days, so a filter that is
    open for years has no more keys than some dozen, and an event one for each level in use. Kinds that hold more than their share of the log are salted, each
    by its measured part of ``salts`` (default: the session's shuffle partitions); subscriptions to others stay one row.
    """
    salts = salts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    days = events.agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"), F.count(F.lit(1)).alias("n"))
    bounds = [_day(days.select(c).scalar()).alias(f"day_{c}") for c in ("a", "b")]
    # Fewer than ``salts`` kinds can have more than that part of all events.
    share = F.col("n") * salts / days.select("n").scalar()
    hot = events.groupBy(F.col("kind").cast("int").alias("kind")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("kind").isNotNull() & (share > 1)).agg(
        F.map_from_entries(F.collect_list(F.struct("kind", F.ceil(share).cast("int").alias("salts")))).alias("m")).scalar()
    bounds.append(hot.alias("hot"))
    sides = subs.select("*", *bounds).select(
        "sub_id", *[F.col(c).alias(f"f_{c}") for c in ("ids", "authors", "kinds", "tags", "since", "until")],
        F.explode(_routes(F.col("hot"), F.col("day_a"), F.col("day_b"))).alias("k"),
    ).select("*", "k.route", "k.key", "k.salt").drop("k")
    # Only of the fixed routes is it asked whether they are in use; tag names come from users and are joined.
    fixed_names = ("id", "author", "kind", *(f"day{k}" for k in range(_LEVELS)))
    used = sides.filter(F.col("route").isin(*fixed_names)).agg(F.collect_set("route").alias("used")).scalar()

    salt = F.pmod(F.xxhash64("id"), _salts_of(F.col("hot"), F.col("kind"))).cast("int")
    fixed = F.array(*[
        F.struct(F.lit(r).alias("route"), v.cast("string").alias("key"), s.alias("salt"))
        for r, v, s in (
            ("id", F.col("id"), F.lit(0)), ("author", F.col("pubkey"), F.lit(0)),
            ("kind", F.col("kind"), salt), *((f"day{k}", F.floor(_day("created_at") / (1 << k)), F.lit(0)) for k in range(_LEVELS)),
        )
    ])
    tagged = F.transform(F.filter("tags", lambda t: F.size(t) >= 2), lambda t: F.struct(
        F.concat(F.lit("#"), F.get(t, F.lit(0))).alias("route"), F.get(t, F.lit(1)).alias("key"), F.lit(0).alias("salt")))
    wanted = F.array_distinct(F.concat(F.filter(fixed, lambda k: F.array_contains(F.col("used"), k["route"])), tagged))
    keyed = (
        events.select("id", "pubkey", "created_at", "kind", "tags", used.alias("used"), hot.alias("hot"))
        .withColumn("k", F.explode(wanted))
        .select("id", "pubkey", "created_at", "kind", "tags", "k.route", "k.key", "k.salt")
    )

    pairs = keyed.join(sides, ["route", "key", "salt"]).filter(row_matches(lambda part: F.col(f"f_{part}")))
    return pairs.select("sub_id", "id").distinct()
