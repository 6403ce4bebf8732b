"""Token ids in wavelet matrices: one file per shard that answers access, count and occurrence queries as it lies on disk.

A wavelet matrix keeps one bit-plane for each bit of the ids, highest first; at each level the ids with a zero bit move, in
order, before those with a one. A directory of set bits for each block gives rank by one addition, and select by binary search.

Layout of a shard's payload (little-endian): ``WVM1``, n as u64, levels as u32, zeros of each level as u64, then for each level the
packed bits (highest bit first) and the set bits before each block of 512 as u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whisperlake.llm.arrays import gathered, slices, texts_of
from whisperlake.llm.store import share_package, tidy
from whisperlake.llm.tokens import encoder, with_end

_BLOCK = 512
_BYTES = _BLOCK // 8
# A shard ends with the document that brings it to so many ids.
SHARD_IDS = 2 << 20
_SLICE = 12 << 20
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """Queries over one shard. Positions and symbols may be arrays."""

    def __init__(self, n: int, zeros: np.ndarray, planes: list[np.ndarray], blocks: list[np.ndarray]) -> None:
        self.n, self.zeros, self.planes, self.blocks = n, zeros, planes, blocks
        self.levels = len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        n = len(ids)
        if n and int(ids.max()) >> levels:
            raise ValueError(f"an id needs more than {levels} bits")
        a = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        zeros, planes, blocks = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (a >> a.dtype.type(level)) & a.dtype.type(1)
            one = bit.astype(bool)
            packed = np.packbits(one)
            planes.append(packed)
            padded = np.pad(packed, (0, -len(packed) % _BYTES)).reshape(-1, _BYTES)
            counts = np.bitwise_count(padded.view(np.uint64)).sum(axis=1, dtype=np.int64)
            blocks.append(np.concatenate(([0], np.cumsum(counts))).astype(np.uint32))
            zeros.append(n - int(np.count_nonzero(one)))
            a = np.concatenate((a[~one], a[one]))
        return cls(n, np.array(zeros, np.uint64), planes, blocks)

    def to_bytes(self) -> bytes:
        parts = [b"WVM1", struct.pack("<QI", self.n, self.levels), self.zeros.astype("<u8").tobytes()]
        for plane, block in zip(self.planes, self.blocks):
            parts += [plane.tobytes(), block.astype("<u4").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        if raw[:4] != b"WVM1":
            raise ValueError("not a wavelet matrix")
        n, levels = struct.unpack_from("<QI", raw, 4)
        at = 16
        zeros = np.frombuffer(raw, "<u8", levels, at)
        at += 8 * levels
        size, count = (n + 7) // 8, -(-((n + 7) // 8) // _BYTES) + 1
        planes, blocks = [], []
        for _ in range(levels):
            planes.append(np.frombuffer(raw, np.uint8, size, at))
            blocks.append(np.frombuffer(raw, "<u4", count, at + size))
            at += size + 4 * count
        return cls(n, zeros, planes, blocks)

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each position (0 to n)."""
        plane = self.planes[level] if self.n else np.zeros(1, np.uint8)
        block = at // _BLOCK
        out = self.blocks[level][block].astype(np.int64)
        byte = at >> 3
        for k in range(_BYTES):
            here = block * _BYTES + k
            use = here < byte
            out += np.where(use, _POPCOUNT[plane[np.minimum(here, len(plane) - 1)]], 0)
        part = (at & 7).astype(np.int64)
        tail = np.where(part > 0, plane[np.minimum(byte, len(plane) - 1)] >> (8 - np.maximum(part, 1)).astype(np.uint8), 0)
        return out + _POPCOUNT[tail]

    def access(self, at) -> np.ndarray:
        """The ids at positions ``at``."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        if not len(at):
            return at
        out = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            one = self._bit(level, at).astype(bool)
            rank = self._rank1(level, at)
            at = np.where(one, int(self.zeros[level]) + rank, at - rank)
            out = out * 2 + one
        return out

    def rank(self, symbol: int, end: int) -> int:
        """How often ``symbol`` occurs before position ``end``."""
        a, b = self._range(symbol, end)
        return b - a

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        if symbol < 0 or symbol >> self.levels:
            return 0, 0
        a, b = 0, end
        for level in range(self.levels):
            ra, rb = self._rank1(level, np.array([a, b])).tolist()
            if symbol >> (self.levels - 1 - level) & 1:
                a, b = int(self.zeros[level]) + ra, int(self.zeros[level]) + rb
            else:
                a, b = a - ra, b - rb
        return a, b

    def _select(self, level: int, one: bool, rank: np.ndarray) -> np.ndarray:
        """Positions of the set (or clear) bits of the given ranks (from 0), by binary search over rank."""
        low, high = np.zeros(len(rank), np.int64), np.full(len(rank), self.n, np.int64)
        while np.any(low < high):
            mid = (low + high) // 2
            found = self._rank1(level, mid + 1)
            enough = (found if one else mid + 1 - found) > rank
            high, low = np.where(enough, mid, high), np.where(enough, low, np.minimum(mid + 1, high))
        return low

    def locate(self, symbol: int) -> np.ndarray:
        """All positions of ``symbol``, ascending."""
        a, b = self._range(symbol, self.n)
        at = np.arange(a, b)
        for level in range(self.levels - 1, -1, -1):
            one = bool(symbol >> (self.levels - 1 - level) & 1)
            at = self._select(level, one, at - int(self.zeros[level]) if one else at)
        return at

    def select(self, symbol: int, rank: int) -> int:
        """The position of the occurrence number ``rank`` (from 0) of ``symbol``; -1 if there are fewer."""
        a, b = self._range(symbol, self.n)
        if not 0 <= rank < b - a:
            return -1
        at = np.array([a + rank])
        for level in range(self.levels - 1, -1, -1):
            one = bool(symbol >> (self.levels - 1 - level) & 1)
            at = self._select(level, one, at - int(self.zeros[level]) if one else at)
        return int(at[0])

    def decode(self) -> np.ndarray:
        """All ids: the levels' moves undone from the last to the first."""
        a = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            z = int(self.zeros[level])
            back = np.empty_like(a)
            back[~one], back[one] = a[:z], a[z:]
            a = back | (one.astype(a.dtype) << a.dtype.type(self.levels - 1 - level))
        return a.astype(np.uint32)


_SHARD = pa.schema([
    ("part", pa.int64()), ("shard", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_ids_n", pa.list_(pa.int64())), ("payload", pa.binary())])
_SHARD_DDL = ("part long, shard long, first_id long, n_ids long, doc_ids array<long>, doc_ids_n array<long>, payload binary")
_DOC = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_DOC_DDL = "doc_id long, part long, start long, n_tokens long, ids_crc32 long"


def _to_shards(file: str, end_id: int, shard_ids: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        e = encoder(file)
        levels = max(1, (max(e.tokenizer.get_vocab_size(), end_id + 1) - 1).bit_length())
        ids, docs, sizes = [], [], []
        shard = first = waiting = 0

        def close():
            nonlocal shard, first, waiting
            n = waiting
            payload = WaveletMatrix.build(np.concatenate(ids), levels).to_bytes()
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "first_id": first, "n_ids": n, "doc_ids": docs[:],
                                               "doc_ids_n": sizes[:], "payload": payload}], schema=_SHARD)
            shard, first, waiting = shard + 1, first + n, 0
            ids.clear(), docs.clear(), sizes.clear()
            return row

        for table in gathered(batches, _SLICE):
            texts, doc_ids = texts_of(table.column(1)), table.column(0).combine_chunks()
            for at, some in slices(texts, _SLICE):
                t = with_end(e.encode(some), end_id)
                names, number = doc_ids.slice(at, len(some)).to_pylist(), np.diff(t.starts)
                done = 0
                while done < len(names):
                    # As many documents as bring the shard to its size.
                    k = int(np.searchsorted(t.starts[done + 1:] - t.starts[done], shard_ids - waiting)) + 1
                    stop = min(len(names), done + k)
                    ids.append(t.ids[t.starts[done]:t.starts[stop]])
                    docs += names[done:stop]
                    sizes += number[done:stop].tolist()
                    waiting += int(t.starts[stop] - t.starts[done])
                    done = stop
                    if waiting >= shard_ids:
                        yield close()
        if docs:
            yield close()

    return run


def _from_shards(batches):
    for batch in batches:
        for row in batch.to_pylist():
            raw = WaveletMatrix.from_bytes(row["payload"]).decode().astype("<u4").tobytes()
            n = np.array(row["doc_ids_n"], np.int64)
            ends = np.cumsum(n)
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(n), row["part"])), pa.array(row["first_id"] + ends - n),
                pa.array(n), pa.array(crc, pa.int64())], schema=_DOC)


def write_shards(docs: DataFrame, path: str, file: str = "byte_bpe_50k.json", end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of ``docs`` (doc_id, text), ``end_id`` after each document, as wavelet matrices in ascending order of doc_id.

    The folder is a Parquet table with one row per shard: its place in the order (``part``, ``shard``), the part's ids before it
    (``first_id``), ``n_ids``, the documents with their numbers of ids, and the matrix as ``payload``. A null or empty text
    is the one id ``end_id``; null doc_ids come first; equal doc_ids are ordered by text; other columns are not read; an empty
    table gives an empty folder. A document is never split between shards.
    """
    share_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidy(_to_shards(file, end_id, shard_ids)), _SHARD_DDL).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Reads a folder of ``write_shards``: doc_id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` of all its ids."""
    share_package(spark)
    shards = spark.read.schema(_SHARD_DDL).parquet(path)
    # One small row per task of the writer, so one window over them all is cheap at any size of the corpus.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = shards.mapInArrow(_from_shards, _DOC_DDL)
    return docs.join(base, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
