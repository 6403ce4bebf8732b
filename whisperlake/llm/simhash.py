"""Near-duplicate documents by SimHash fingerprints, found with deletion-variant signatures.

Fingerprints that differ in at most ``distance`` bits are cut into distance // 2 + 1 segments, so one of them differs by one bit
at most. Each segment is indexed once for each of its bits with that bit as a wildcard: 64 signatures for a fingerprint, however
large the distance. Fingerprints that share a signature are compared in full.

All documents with one fingerprint are one node. Among nodes that share a signature, links to a pivot stand for all links between
those that the pivot reaches, so a large group of near copies gives links in proportion to its size, with the same components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.arrays import slices, strings, texts_of
from whisperlake.llm.components import components
from whisperlake.llm.store import sent_if_small, share_package, unused, written

SHINGLE = 4
SEED = 42
DISTANCE = 4
# Groups up to this size are compared pair by pair, larger ones by pivots. Both give the same components.
_SMALL = 8


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The 64-bit fingerprint of each text (no nulls); 0 for a text without words."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    number = np.zeros(len(texts), np.int64)
    for i, text in enumerate(strings(texts)):
        # On bytes, lower() changes A-Z only and split() cuts at \\x20 and \\x09-\\x0D only.
        parts = text.encode().lower().split()
        joined = b" ".join(parts)
        if len(parts) <= SHINGLE:
            found = [digest(joined, SEED)] if parts else []
        else:
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
            ends = np.cumsum(sizes)
            first = (ends - sizes)[:len(parts) - SHINGLE + 1].tolist()
            found = [digest(joined[a:b], SEED) for a, b in zip(first, (ends[SHINGLE - 1:] - 1).tolist())]
        hashes += found
        number[i] = len(found)
    h = np.array(hashes, np.uint64)
    out = np.zeros(len(texts), np.uint64)
    filled = np.flatnonzero(number)
    if len(filled):
        n = number[filled]
        starts = np.cumsum(n) - n
        for bit in range(64):
            ones = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(1), starts)
            out[filled] |= (2 * ones > n.astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed 64-bit number."""

    def run(column: pa.Array) -> pa.Array:
        parts = [fingerprints(t) for _, t in slices(texts_of(column))]
        return pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64))

    return F.arrow_udf(run, "long")(text.cast("string"))


def signatures(fp: Column, distance: int = DISTANCE) -> Column:
    """The 64 keys of a fingerprint: the wildcard bit above, the rest of its segment below."""
    segments = distance // 2 + 1
    edges = [64 * k // segments for k in range(segments + 1)]
    width = max(b - a for a, b in zip(edges, edges[1:]))
    keys = []
    for a, b in zip(edges, edges[1:]):
        part = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        keys += [part.bitwiseAND(F.lit(~(1 << (i - a)))).bitwiseOR(F.lit(i << width)) for i in range(a, b)]
    return F.array(*keys)


def group_links(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the full comparison of all pairs of ``fp`` would join."""
    heads: list[np.ndarray] = []
    clusters: list[np.ndarray] = []
    rest = fp
    while len(rest):
        near = np.bitwise_count(rest ^ rest[0]) <= distance
        clusters.append(rest[near])
        rest = rest[~near]
    pivots = np.array([c[0] for c in clusters])
    left, right = [np.repeat(pivots, [len(c) - 1 for c in clusters])], [np.concatenate([c[1:] for c in clusters])]
    for i in range(len(clusters) - 1):
        # Members lie within the distance of their pivots, so linked members have pivots within three times the distance.
        for j in i + 1 + np.flatnonzero(np.bitwise_count(pivots[i + 1:] ^ pivots[i]) <= 3 * distance):
            a, b = sorted((clusters[i], clusters[j]), key=len)
            for x in a:
                hit = b[np.bitwise_count(b ^ x) <= distance]
                if len(hit):
                    left.append(np.array([x])), right.append(hit[:1])
                    break
    return np.concatenate(left), np.concatenate(right)


def _links(distance: int):
    def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """Links within runs of equal keys; the runs are whole."""
        starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        size = np.diff(np.append(starts, len(key)))
        left, right = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        room = np.repeat(size, size)
        for lag in range(1, _SMALL):
            a = np.flatnonzero((key[lag:] == key[:-lag]) & (room[lag:] <= _SMALL))
            a = a[np.bitwise_count(fp[a] ^ fp[a + lag]) <= distance]
            left.append(fp[a]), right.append(fp[a + lag])
        for s, n in zip(starts[size > _SMALL], size[size > _SMALL]):
            a, b = group_links(fp[s:s + n], distance)
            left.append(a), right.append(b)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["a", "b"])

    def run(batches):
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            key = np.concatenate((key, batch.column(0).to_numpy()))
            fp = np.concatenate((fp, batch.column(1).to_numpy().view(np.uint64)))
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:  # the last run may go on in the next batch
                yield found(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(key):
            yield found(key, fp)

    return run


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of different fingerprints of ``nodes`` (column fp, distinct) whose components are those of all pairs within the distance."""
    share_package(nodes.sparkSession)
    keyed = nodes.select(F.explode(signatures(F.col("fp"), distance)).alias("signature"), "fp")
    runs = keyed.repartition("signature").sortWithinPartitions("signature", "fp")
    return runs.mapInArrow(_links(distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, ``fingerprint`` (16 hex digits) and ``component_id`` for every row of ``docs`` (doc_id, text; nothing else is read).

    ``component_id`` is the smallest doc_id reachable over links of at most ``distance`` differing bits. Null and empty texts have
    fingerprint zero and are linked like any other. Null doc_ids stay; they never name a component (a component of
    them alone has a null id). Repeated rows and equal texts share a fingerprint, hence a component. An empty table gives no rows.
    """
    return _rooted(docs, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(docs: DataFrame, distance: int) -> DataFrame:
    """doc_id, fp, the ``root`` of its component and ``component_id`` for every row of ``docs``."""
    share_package(docs.sparkSession)
    marked = written(docs.select(F.col("doc_id").cast("long"), fingerprint(F.col("text")).alias("fp")), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    roots = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "root", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.

    Rows that repeat a doc_id are told apart by their fingerprints; of rows with equal id and fingerprint one stays. Rows without
    a doc_id can't be told apart from others by name and stay.
    """
    found = written(_rooted(docs, distance).filter("doc_id is not null").groupBy("doc_id", "fp", "root").agg(
        F.count(F.lit(1)).alias("n")), "components")
    best = found.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("best"))
    name = unused("text_name", docs)
    ranked = found.join(best, "root").select("n", F.struct("doc_id", "fp").alias(name), (F.struct("doc_id", "fp") == F.col("best")).alias("stays"))
    out = written(ranked.filter("not stays").drop("n", "stays"), "near-copies")
    again = written(ranked.filter("stays and n > 1").drop("n", "stays"), "repeated-ids")
    out, again = sent_if_small(out, 24), sent_if_small(again, 24)
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text")).alias("fp"))
    kept = docs.withColumn(name, F.when(F.col("doc_id").isNotNull(), own)).join(out, name, "left_anti")
    repeated = kept.join(again, name, "left_semi").dropDuplicates([name])
    return kept.join(again, name, "left_anti").unionByName(repeated).select(docs.columns)
