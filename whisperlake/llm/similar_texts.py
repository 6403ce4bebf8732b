"""Near-duplicate documents by the Jaccard similarity of their word shingles, for the pipeline's stage.

Two texts are linked if the sets of their five-word shingles (A-Z lower-cased) have a similarity of ``4 / 5`` or more. Candidates are
texts whose SimHash fingerprints are equal or linked (:mod:`whisperlake.llm.simhash`), which most pairs of similarity 0.95 are and few of 0.8, and
texts that share one of ``BANDS`` keys, each made of ``ROWS`` minima of the set: a pair of similarity 0.8 shares none with a
probability of 0.00005, one of 0.9 practically never. All candidates are verified on the whole sets.

A text is named by its hash, so rows with equal ids and different texts stay apart, and equal texts are one node. Within a key all texts
are compared with the first one; texts that are still in different components after that are compared with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.llm import simhash
from whisperlake.llm.arrays import chained, hashes, mixed, ragged, slices, texts_of, words
from whisperlake.llm.components import components
from whisperlake.llm.store import sent_if_small, share_package, tidy, unused, written

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 25, 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SALTS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _BASE)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text (with repeats), and where each text begins. A shorter text with a word is one shingle."""
    w = words(pc.ascii_lower(texts))
    token, n = hashes(w.vocab)[w.codes], np.diff(w.starts)
    number = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    at, end = ragged(w.starts[:-1], number), np.repeat(w.starts[1:], number)
    out = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        inside = at + k < end
        out[inside] = mixed(out[inside] * _BASE + token[at[inside] + k])
    return out, np.concatenate(([0], np.cumsum(number)))


def band_keys(texts: pa.Array) -> np.ndarray:
    """``BANDS`` keys of each text, as rows. Texts without words share all of theirs."""
    value, starts = shingles(texts)
    filled = np.flatnonzero(np.diff(starts))
    out = np.zeros((len(texts), BANDS), np.uint64)
    for band in range(BANDS):
        least = [np.full(len(texts), band, np.uint64)]
        for salt in _SALTS[band * ROWS:(band + 1) * ROWS]:
            low = np.zeros(len(texts), np.uint64)
            if len(filled):
                low[filled] = np.minimum.reduceat((value ^ salt) * (salt | np.uint64(1)), starts[:-1][filled])
            least.append(low)
        out[:, band] = chained(least)
    return out.view(np.int64)


def similar(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether the shingle sets of each two texts are similar enough; two empty sets are."""
    sets = []
    for texts in (a, b):
        value, starts = shingles(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (np.diff(value) != 0) | (np.diff(owner) != 0)
        sets.append((value[new], owner[new]))
    value, owner = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
    order = np.lexsort((value, owner))
    # A shingle that both sets have stands twice.
    twice = (np.diff(value[order]) == 0) & (np.diff(owner[order]) == 0)
    shared = np.bincount(owner[order][1:][twice], minlength=len(a))
    total = np.bincount(owner, minlength=len(a))
    return shared * (NUMERATOR + DENOMINATOR) >= total * NUMERATOR


def _bands(text: Column) -> Column:
    def run(column: pa.Array) -> pa.Array:
        parts = [band_keys(t) for _, t in slices(texts_of(column))]
        keys = np.concatenate(parts) if parts else np.zeros((0, BANDS), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))

    return F.arrow_udf(run, "array<long>")(text)


def _verify(batches):
    for batch in batches:
        left, right = texts_of(batch.column(2)), texts_of(batch.column(3))
        for at, part in slices(left):
            keep = pa.array(similar(part, right.slice(at, len(part))))
            yield pa.RecordBatch.from_arrays([batch.column(k).slice(at, len(part)).filter(keep) for k in (0, 1)], names=["a", "b"])


def _name(docs: DataFrame) -> Column:
    return F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")))


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The similar ones of ``pairs`` (a, b)."""
    asked = written(pairs.select("a").union(pairs.select("b")).distinct().toDF("node"), "asked")
    texts = docs.select(_name(docs).alias("node"), docs["text"].cast("string").alias("text"))
    texts = written(texts.join(sent_if_small(asked, 48), "node", "left_semi").dropDuplicates(["node"]), "asked-texts")
    both = pairs.join(texts.toDF("a", "one"), "a").join(texts.toDF("b", "two"), "b").select("a", "b", "one", "two")
    return written(both.mapInArrow(tidy(_verify), "a binary, b binary"), "similar-texts")


def close_fingerprints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts of ``nodes`` (node, fp) with linked fingerprints; the smallest text of a fingerprint stands for all that share it."""
    named = written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    near = written(simhash.links(named.select("fp")), "fingerprint-links")
    return near.toDF("one", "two").join(named.toDF("one", "a"), "one").join(named.toDF("two", "b"), "two").select("a", "b")


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different texts of ``docs`` whose components are those of all similar candidates; ``nodes``: node, fp, bands."""
    # A fingerprint is one more key.
    keyed = nodes.select(F.explode(F.array_append("bands", F.xxhash64(F.lit("fp"), "fp"))).alias("band"), "node")
    # Most keys are of one text: those of several are counted first, so that names are shuffled and sorted for these alone.
    shared = written(keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-keys")
    several = written(keyed.join(sent_if_small(shared, 24), "band"), "several")
    least = several.groupBy("band").agg(F.min("node").alias("a"))
    met = written(several.join(least, "band").select("band", "a", F.col("node").alias("b"), "n"), "met")
    close = close_fingerprints(nodes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = written(met.filter("a != b").select("a", "b").union(close).distinct(), "first-pairs")
    found = _verified(first, docs)
    roots = components(found)
    # Keys of two texts are done.
    open_keys = met.filter("n > 2").select("band", F.col("b").alias("node")).join(roots, "node", "left").select(
        "band", "node", F.coalesce("root", "node").alias("root"))
    mixed_keys = open_keys.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("band")
    rest = written(open_keys.join(mixed_keys, "band"), "open-keys")
    more = rest.toDF("band", "a", "ra").join(rest.toDF("band", "b", "rb"), "band").filter("a < b and ra != rb").select("a", "b").distinct()
    more = written(more.join(first, ["a", "b"], "left_anti"), "further-pairs")
    return found if more.isEmpty() else found.union(_verified(more, docs))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) with one row of each component of similar texts: the one with the smallest doc_id.

    Of equal ids the text with the smaller hash stays, and one of equal rows. Rows without a doc_id come after all others. Null texts
    are empty; texts without words are all similar.
    """
    share_package(docs.sparkSession)
    text = docs["text"].cast("string")
    # Of one column: the text goes to Python once for both.
    marked = written(docs.select(F.col("doc_id").cast("long"), _name(docs).alias("node"), simhash.fingerprint(text).alias("fp"), _bands(text).alias("bands")), "bands")
    nodes = written(marked.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    roots = components(links(nodes, docs))
    named = marked.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n")).join(roots, "node", "left").select(
        "doc_id", "node", "n", F.coalesce("root", "node").alias("root"))
    named = written(named, "named")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "node")
    best = named.groupBy("root").agg(F.min(order).alias("best"))
    ranked = named.join(best, "root").select("doc_id", "node", "n", (order == F.col("best")).alias("stays"))
    other = unused("other", docs)
    names = F.struct("doc_id", "node").alias(other)
    out = written(ranked.filter("not stays").select(names), "near-copies")
    again = written(ranked.filter("stays and n > 1").select(names), "repeated")
    out, again = sent_if_small(out, 56), sent_if_small(again, 56)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(other)["doc_id"]) & (_name(docs) == F.col(other)["node"])
    kept = docs.join(out, same, "left_anti")
    repeated = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").unionByName(repeated).select(docs.columns)
