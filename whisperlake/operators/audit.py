"""Privacy audit: what a relay could learn from stored wraps. All counts should be zero."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.functions.text import let
from whisperlake.schemas import WRAP_JITTER_SECONDS


class SizeClass(NamedTuple):
    """Texts of at least ``least`` characters are looked up by a run of ``run`` characters out of ``window`` neighbouring ones."""

    least: int
    run: int
    window: int


# One class for each power of two up to the longest; within it a run and its neighbours fit into the shortest text.
SIZE_CLASSES = [SizeClass(32, 25, 8), SizeClass(16, 9, 8), SizeClass(8, 5, 4), SizeClass(4, 3, 2), SizeClass(3, 3, 1), SizeClass(2, 2, 1), SizeClass(1, 1, 1)]
# Long texts with so many whole words inside are looked up by runs of that many words instead, and are a class of their own.
RUN_WORDS = 5
_WORDED = 0


def known_signers(wraps: DataFrame, identities: DataFrame) -> DataFrame:
    """Wraps signed by a real identity instead of a throwaway key."""
    return wraps.join(identities.select("pubkey"), "pubkey", "left_semi")


def time_leaks(wraps: DataFrame, rumors: DataFrame, jitter: int = WRAP_JITTER_SECONDS) -> DataFrame:
    """Wraps whose time lies outside [rumor time - jitter, rumor time]."""
    inner = rumors.select("seal_id", F.col("created_at").alias("rumor_at"))
    inside = F.col("created_at").between(F.col("rumor_at") - jitter, F.col("rumor_at"))
    return wraps.join(inner, "seal_id").filter(~inside)


def _minima(text: Column, c: SizeClass) -> Column:
    """Hashes of the runs that are smallest in some window of neighbouring runs of a text."""
    # A look-ahead finds runs that overlap, in one pass over the text.
    runs = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{c.run}}}))"), F.lit(1))
    hashes = F.transform(runs, lambda run: F.xxhash64(F.lit(c.least), run))
    if c.window == 1:
        return F.array_distinct(hashes)

    def smallest(h: Column) -> Column:
        # Beyond the end there is null, which ``least`` skips; windows that are cut off there are left out.
        near = F.transform(h, lambda x, i: F.least(x, *(F.get(h, i + j) for j in range(1, c.window))))
        return F.slice(near, F.lit(1), F.greatest(F.size(h) - c.window + 1, F.lit(0)))

    return F.array_distinct(let(hashes, smallest))


def _word_runs(text: Column, inner: bool = False) -> Column:
    """Hashes of all runs of words between spaces of a text; ``inner``: without its first and last word, which may be cut."""
    parts = F.split(text, " ", -1)
    if inner:
        parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))

    def runs(p: Column) -> Column:
        whole = F.slice(p, F.lit(1), F.greatest(F.size(p) - RUN_WORDS + 1, F.lit(0)))
        return F.transform(whole, lambda x, i: F.xxhash64(F.lit(_WORDED), x, *(F.get(p, i + j) for j in range(1, RUN_WORDS))))

    return F.array_distinct(let(parts, runs))


def _class_of(text: Column) -> Column:
    length = F.length(text)
    spaces = length - F.length(F.replace(text, F.lit(" "), F.lit("")))
    worded = (length >= SIZE_CLASSES[0].least) & (spaces > RUN_WORDS)
    return F.when(worded, _WORDED).otherwise(F.coalesce(*(F.when(length >= c.least, c.least) for c in SIZE_CLASSES)))


def content_keys(contents: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (id, key): what ``contents`` (id, content) are looked up by, in the size classes that occur in ``known`` (plaintext).

    Words give one key each. In each window of neighbouring runs of characters only the smallest hash counts, so that a long content gives about two
    keys for nine characters.
    """
    # At most one row for each size class.
    used = known.filter(F.length("plaintext") > 0).agg(F.collect_set(_class_of(F.col("plaintext"))).alias("used")).scalar()
    found = {_WORDED: _word_runs(F.col("content")), **{c.least: _minima(F.col("content"), c) for c in SIZE_CLASSES}}
    keys = F.flatten(F.array(*(F.when(F.array_contains("used", c), k).otherwise(F.array().cast("array<bigint>")) for c, k in found.items())))
    return contents.select("id", "content", used.alias("used")).select("id", F.explode(keys).alias("key"))


def plaintext_leaks(contents: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (id, item_id) where a content holds a known plain text as a substring.

    Whatever holds a text holds the words between its spaces, and all windows of neighbouring runs of its characters, and thus the smallest run of
    each: one that the text has chosen is among those that the content has chosen. Each text is looked up by one of its own: the one that the fewest known texts
    share. Only (id, key) pairs take part in that equi-join, whose other side Spark sends around if it is small; whole texts
    are fetched by id for the pairs that met, and compared. No pair is formed without a shared key.

    contents: id, content; known: item_id, plaintext. Empty plain texts are left out.
    """
    known = known.filter(F.length("plaintext") > 0).select("item_id", "plaintext")
    size, text = _class_of(F.col("plaintext")), F.col("plaintext")
    chosen = F.when(size == _WORDED, _word_runs(text, inner=True)).otherwise(F.coalesce(*(F.when(size == c.least, _minima(text, c)) for c in SIZE_CLASSES)))
    own = known.select("item_id", F.explode(chosen).alias("key"))
    shared = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    anchors = own.join(shared, "key").groupBy("item_id").agg(F.min(F.struct("n", "key")).alias("a")).select("item_id", "a.key")
    met = content_keys(contents, known).join(anchors, "key").select("id", "item_id").distinct()
    pairs = met.join(known, "item_id")
    held = pairs.join(contents.select("id", "content"), "id").filter(F.col("content").contains(F.col("plaintext")))
    return held.select("id", "item_id").distinct()


def leak_audit(
    wraps: DataFrame, rumors: DataFrame, identities: DataFrame, contents: DataFrame, known: DataFrame
) -> DataFrame:
    """One row per check with the number of findings."""
    checks = {
        "signed by a known identity": known_signers(wraps, identities),
        "time outside the allowed range": time_leaks(wraps, rumors),
        "known plain text in content": plaintext_leaks(contents, known).select("id").distinct(),
    }
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()
    ])
