"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

The documents are dealt into chunks of bounded size. A chunk asks for each distinct n-gram (of orders 0 to ``order``) once and says
how often it has it; these requests are the exploded n-grams, pre-aggregated. They are partitioned by hash: each bucket is one part
of the count table, made by summing the requests. Joined back, the counts return to the chunks, where the scores are summed per
document. As a chunk sends an n-gram once, a word that makes up a third of the corpus costs a bucket one row a chunk.

Plain rows (n-gram, document) would take about forty bytes for each word and order in two shuffles. A request is instead a sorted array of
hashes, sent as differences in byte planes, of which shuffle compression leaves about six bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.arrays import hashes, mixed, slices, texts_of, words
from whisperlake.llm.store import share_package

# Text of a chunk, which bounds a task's memory.
CHUNK_BYTES = 8 << 20
# Buckets of the count table for each shuffle partition of the session.
_BUCKETS = 4
_CHUNK_BITS = 24
_CORPUS = np.uint64(0x5851F42D4C957F2D)  # the n-gram of order 0, which counts all words


def grams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the hash of the n-gram that ends at each word (0 where a text has too few words before), and the texts' starts."""
    w = words(pc.ascii_lower(texts))
    token = mixed(hashes(w.vocab))[w.codes] if len(w.codes) else np.empty(0, np.uint64)
    depth = np.arange(len(token)) - np.repeat(w.starts[:-1], np.diff(w.starts))
    out = [np.full(len(token), _CORPUS)]
    for k in range(1, order + 1):
        before = np.zeros_like(token)
        before[1:] = out[k - 1][:-1] if k > 1 else np.uint64(0)
        h = mixed(before * np.uint64(0x9E3779B97F4A7C15) + token + np.uint64(k))
        out.append(np.where(depth >= k - 1, h, np.uint64(0)))
    return out, w.starts


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that zero bytes lie together and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(raw: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def distinct_grams(all_grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of a chunk, without the filler 0, and their numbers."""
    keys, n = np.unique(np.concatenate(all_grams), return_counts=True)
    keep = keys != 0
    return keys[keep], n[keep].astype(np.uint32)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes: sorted keys lie in ascending buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _chunks(batches):
    base, number = TaskContext.get().partitionId() << _CHUNK_BITS, 0
    for batch in batches:
        for at, part in slices(texts_of(batch.column(1)), CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(part), base + number)), batch.column(0).slice(at, len(part)), part.cast(pa.string())],
                names=["chunk", "doc_id", "text"])
            number += 1


_REQUEST = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])


def _requests(order: int, buckets: int):
    def run(batches):
        base, number = TaskContext.get().partitionId() << _CHUNK_BITS, 0
        for batch in batches:
            for _, part in slices(texts_of(batch.column(1)), CHUNK_BYTES):
                keys, n = distinct_grams(grams(part, order)[0])
                edges = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
                rows = {"bucket": [], "chunk": [], "keys": [], "n": []}
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    own = slice(edges[b], edges[b + 1])
                    rows["bucket"].append(b)
                    rows["chunk"].append(base + number)
                    rows["keys"].append(planes(np.diff(keys[own], prepend=np.uint64(0))))
                    rows["n"].append(planes(n[own]))
                number += 1
                yield pa.RecordBatch.from_pydict(rows, schema=_REQUEST)

    return run


_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.binary())])


def _count(t: pa.Table) -> pa.Table:
    """One part of the count table: sums all chunks' numbers and answers each chunk in the order it asked in."""
    asked = [np.cumsum(from_planes(x, np.uint64), dtype=np.uint64) for x in t.column("keys").to_pylist()]
    n = np.concatenate([from_planes(x, np.uint32) for x in t.column("n").to_pylist()])
    _, which = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(which, n).astype(np.uint64)[which]
    ends = np.cumsum([len(a) for a in asked])
    answers = [planes(total[e - len(a):e]) for a, e in zip(asked, ends.tolist())]
    return pa.Table.from_arrays([t.column("chunk"), t.column("bucket"), pa.array(answers, pa.binary())], schema=_ANSWER)


def log_probabilities(counts: list[np.ndarray], known: list[np.ndarray], backoff: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the log of its score, and whether a longer n-gram was given up for a shorter one.

    ``counts`` has the corpus counts of the n-grams of each order that end at the word, ``known`` whether there is such an n-gram.
    """
    n = len(counts[0])
    out, done, given_up = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
    factor = np.zeros(n)
    for k in range(len(counts) - 1, 0, -1):
        context = counts[0] if k == 1 else np.concatenate(([1], counts[k - 1][:-1]))
        use = known[k] & ~done & ((counts[k] >= least) | (k == 1))
        with np.errstate(divide="ignore"):
            out[use] = factor[use] + np.log(counts[k][use] / context[use])
        done |= use
        skipped = known[k] & ~done
        factor[skipped] += np.log(backoff)
        given_up |= skipped
    return out, given_up


def _score(order: int, backoff: float, least: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backoff", pa.int64()), ("log_score", pa.float64())])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        found, starts = grams(texts_of(docs.column("text")), order)
        keys, _ = distinct_grams(found)
        answers = answers.sort_by("bucket")
        total = np.concatenate([np.empty(0, np.uint64), *(from_planes(x, np.uint64) for x in answers.column("n").to_pylist())])
        if len(total) != len(keys):
            raise RuntimeError("a chunk changed between the passes: score a table that is stored")
        counts = []
        for h in found:
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            counts.append(np.where(h != 0, total[at] if len(keys) else 0, 0).astype(np.float64))
        logs, given_up = log_probabilities(counts, [h != 0 for h in found], backoff, least)
        n = np.diff(starts)
        owner = np.repeat(np.arange(len(n)), n)
        return pa.Table.from_arrays([
            docs.column("doc_id"), pa.array(n), pa.array(np.bincount(owner, given_up, len(n)).astype(np.int64)),
            pa.array(np.bincount(owner, logs, len(n)))], schema=schema)

    return run


def score(docs: DataFrame, order: int = 2, backoff: float = 0.4, least: int = 2) -> DataFrame:
    """doc_id, ``n_words``, ``n_backoff`` (words scored by a shorter n-gram than they have), ``log_score`` (sum over the words of ln S) and
    ``score`` (its mean) for every row of ``docs`` (doc_id, text; nothing else is read), which must be stored and not change.

    S of a word is count(n-gram) / count(n-gram without the word) for the longest n-gram up to ``order`` that the corpus has at least
    ``least`` times, times ``backoff`` for each order given up; the word alone is measured against all words. Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A null or empty text has no words, log_score 0 and a null score. Null ids stay,
    and repeated rows count and are scored each.
    """
    spark = docs.sparkSession
    share_package(spark)
    buckets = _BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = texts.mapInArrow(_requests(order, buckets), "bucket long, chunk long, keys binary, n binary")
    answers = asked.groupBy("bucket").applyInArrow(_count, "chunk long, bucket long, n binary")
    chunks = texts.mapInArrow(_chunks, "chunk long, doc_id long, text string")
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _score(order, backoff, least), "doc_id long, n_words long, n_backoff long, log_score double")
    return scored.withColumn("score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
