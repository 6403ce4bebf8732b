"""Harmonic packing of documents into token sequences of a fixed capacity.

A piece of length n belongs to class k = capacity // n, so exactly k pieces of a class fit in one bin, and a bin is full
when it has k of them: no search and no state but one open bin for each class. Each worker (a task of the tokenising pass)
fills its bins on its own. Documents are cut so that nearly all pieces are as long as their class allows: full sequences
first, then pieces of capacity // (k + 1) while a whole rest would leave more than ``slack`` tokens of a bin unused.

Bins that are still open at the end of a task are filled on for ``_TOGETHER`` tasks at a time. What is open then is laid end to
end and cut at the capacity, so that such a group leaves one part-filled sequence.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.arrays import gathered, ragged, slices, texts_of
from whisperlake.llm.store import share_package, tidy, written
from whisperlake.llm.tokens import encoder, with_end

# Tasks whose open bins are filled on together; it bounds a group to so many times the open pieces of one task.
_TOGETHER = 16
# A sequence id holds the task or group above, the bin below.
_BIN_BITS = 40
# Bytes of text at a time: ids, places and pieces of a slice take some forty times as much in a worker.
_SLICE = 1 << 20

_FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("worker", pa.int64()),
]
_SCHEMA = pa.schema(_FIELDS)
_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, worker long"


@lru_cache(maxsize=8)
def cuts(capacity: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a rest of each length below the capacity is cut: all lengths, and for each rest their place and number."""
    out: list[list[int]] = [[]]
    for rest in range(1, capacity):
        k = capacity // rest
        # A whole rest wastes capacity - k * rest of its bin.
        out.append([rest] if capacity - k * rest <= slack else [capacity // (k + 1), *out[rest - capacity // (k + 1)]])
    number = np.array([len(x) for x in out])
    return np.array([n for x in out for n in x], np.int64), np.cumsum(number) - number, number


def fill(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fills bins with a fixed number of pieces for each class, in the given order.

    Returns the pieces in full bins with their bin (from 0) and offset, and the pieces left over.
    """
    k = capacity // lengths
    order = np.argsort(k, kind="stable")
    sorted_k = k[order]
    classes, first, count = np.unique(sorted_k, return_index=True, return_counts=True)
    rank = np.arange(len(order)) - np.repeat(first, count)
    bins = count // classes
    full = rank < np.repeat(bins * classes, count)
    bin_no = np.repeat(np.cumsum(bins) - bins, count) + rank // np.maximum(sorted_k, 1)
    placed = order[full]
    bin_no, size = bin_no[full], lengths[placed]
    before = np.cumsum(size) - size
    starts = np.flatnonzero(np.diff(bin_no, prepend=-1))
    offset = before - np.repeat(before[starts], np.diff(np.append(starts, len(size))))
    return placed, bin_no, offset, order[~full]


def _pieces(doc_ids: pa.Array, ids: np.ndarray, starts: np.ndarray, capacity: int, slack: int, worker: int) -> pa.Table:
    total = np.diff(starts)
    full, rest = total // capacity, total % capacity
    plan, place, number = cuts(capacity, slack)
    n = full + number[rest]
    owner = np.repeat(np.arange(len(total)), n)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    length = np.full(len(owner), capacity, np.int64)
    tail = rank >= full[owner]
    length[tail] = plan[ragged(place[rest], number[rest])]
    ends = np.cumsum(length)
    edges = (np.concatenate(([0], ends)) * 4).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(edges), pa.py_buffer(ids.astype("<u4"))])
    null = pa.nulls(len(owner), pa.int64())
    return pa.Table.from_arrays([
        doc_ids.take(pa.array(owner)), pa.array(ends - length - starts[owner]), pa.array(length), data, pa.array(total[owner]),
        null, null, pa.array(np.full(len(owner), worker, np.int64))], schema=_SCHEMA)


def _placed(t: pa.Table, sequence: np.ndarray, offset: np.ndarray) -> pa.Table:
    t = t.set_column(5, _SCHEMA.field(5), pa.array(sequence, pa.int64()))
    return t.set_column(6, _SCHEMA.field(6), pa.array(offset, pa.int64()))


def _tokenise(file: str, end_id: int, capacity: int, slack: int):
    def run(batches):
        worker = TaskContext.get().partitionId()
        encode = encoder(file).encode
        waiting, bins = _SCHEMA.empty_table(), 0
        for table in gathered(batches, _SLICE):
            texts, doc_ids = texts_of(table.column(1)), table.column(0).combine_chunks()
            for at, part in slices(texts, _SLICE):
                t = with_end(encode(part), end_id)
                new = _pieces(doc_ids.slice(at, len(part)), t.ids, t.starts, capacity, slack, worker)
                both = pa.concat_tables([waiting, new]).combine_chunks()
                placed, bin_no, offset, rest = fill(both.column("length").to_numpy(), capacity)
                waiting = both.take(pa.array(rest))
                if len(placed):
                    sequence = (np.int64(2 * worker) << _BIN_BITS) + bins + bin_no
                    bins += int(bin_no[-1]) + 1
                    yield from _placed(both.take(pa.array(placed)), sequence, offset).to_batches(20_000)
        yield from waiting.to_batches(20_000)

    return run


def _fill_on(capacity: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        group = key[0].as_py()
        t = t.select(_SCHEMA.names).cast(_SCHEMA).combine_chunks()
        t = t.sort_by([("length", "descending"), ("worker", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        placed, bin_no, offset, rest = fill(t.column("length").to_numpy(), capacity)
        base = np.int64(2 * group + 1) << _BIN_BITS
        bins = int(bin_no[-1]) + 1 if len(bin_no) else 0
        out = [_placed(t.take(pa.array(placed)), base + bin_no, offset)]
        # End to end: a piece that reaches over the end of a sequence is cut there.
        left = t.take(pa.array(rest))
        rows, at = [], 0
        for r in left.to_pylist():
            done = 0
            while done < r["length"]:
                n = min(r["length"] - done, capacity - at % capacity)
                rows.append(r | {"start": r["start"] + done, "length": n, "ids": r["ids"][4 * done:4 * (done + n)],
                                 "sequence_id": int(base) + bins + at // capacity, "offset": at % capacity})
                done, at = done + n, at + n
        out.append(pa.Table.from_pylist(rows, schema=_SCHEMA))
        return pa.concat_tables(out)

    return run


def pack(docs: DataFrame, file: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = 4096, slack: int = 64) -> DataFrame:
    """Packs every document of ``docs`` (doc_id, text; other columns are not read).

    Returns one row per piece: ``doc_id``, ``start`` (the document's ids before it), ``length``, ``ids`` (unsigned 32-bit,
    little-endian), ``doc_tokens`` (all ids of the document with ``end_id``), ``sequence_id``, ``offset`` (in the sequence, from 0,
    without gaps). A null or empty text is the one id ``end_id``; a null ``doc_id`` stays null; repeated rows are packed each;
    an empty table gives no rows. ``slack`` bounds the tokens of a full bin that stay unused.
    """
    share_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # The encoder and its pieces are some hundred megabytes in each worker, which later stages need; loading it again takes a task under a second.
    tokenised = texts.mapInArrow(tidy(_tokenise(file, end_id, capacity, slack), encoder.cache_clear), _DDL)
    pieces = written(tokenised, "pieces")
    done = pieces.filter("sequence_id is not null")
    group = F.floor(F.col("worker") / _TOGETHER).cast("long").alias("fill_group")
    rest = pieces.filter("sequence_id is null").groupBy(group).applyInArrow(_fill_on(capacity), _DDL)
    return done.unionByName(rest).drop("worker")
