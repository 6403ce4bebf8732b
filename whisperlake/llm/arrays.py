"""Columns of texts as numpy arrays. Everything here works on one slice of an Arrow batch, inside a task."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Work is done on slices of so many bytes of text (one text at least), which bounds a task's memory.
SLICE_BYTES = 4 << 20
# Odd multipliers of the 64-bit finaliser (fixed values, public domain).
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Words(NamedTuple):
    """All words of some texts: ``codes`` index ``vocab``; text i owns codes[starts[i]:starts[i + 1]]."""

    codes: np.ndarray
    starts: np.ndarray
    vocab: pa.Array

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of strings, null becoming the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def strings(column: pa.Array) -> list[str | None]:
    """``to_pylist`` of a column of strings, several times faster."""
    return column.to_numpy(zero_copy_only=False).tolist()


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts (first row, texts) of about ``limit`` bytes each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Consecutive batches put together until they have ``limit`` bytes: larger slices repeat more words."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def drop_empty(codes: np.ndarray, starts: np.ndarray, empty: int) -> tuple[np.ndarray, np.ndarray]:
    """Without the code ``empty`` (negative: there is none)."""
    if empty < 0:
        return codes, starts
    keep = codes != empty
    return codes[keep], np.concatenate(([0], np.cumsum(keep)))[starts]


def coded(parts: pa.Array) -> Words:
    """Lists of strings with the strings as codes."""
    starts = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten().dictionary_encode()
    return Words(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts - starts[0], flat.dictionary)


def words(texts: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    w = coded(pc.ascii_split_whitespace(texts))
    codes, starts = drop_empty(w.codes, w.starts, pc.index(w.vocab, "").as_py() if len(w.vocab) else -1)
    return Words(codes, starts, w.vocab)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _random_table() -> np.ndarray:
    """64 times 256 random numbers, the same everywhere: what a byte adds at a position."""
    return mixed(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_TABLE = _random_table()


def hashes(vocab: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, by tabulation: the sum of one random number for each byte and position, mixed with the length."""
    vocab = vocab.cast(pa.large_string())
    offsets = np.frombuffer(vocab.buffers()[1], np.int64)[vocab.offset:vocab.offset + len(vocab) + 1]
    if not len(vocab) or offsets[-1] == offsets[0]:
        return mixed(np.ones(len(vocab), np.uint64))
    raw = np.frombuffer(vocab.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    starts, size = offsets[:-1] - offsets[0], np.diff(offsets)
    # One position of all strings at a time, the long ones first.
    order = np.argsort(-np.minimum(size, 65).astype(np.int8), kind="stable")
    begin, sums = starts[order], np.zeros(len(size), np.uint64)
    longer = len(size) - np.cumsum(np.bincount(np.minimum(size, 65), minlength=66))
    for at in range(min(int(size.max()), 64)):
        n = int(longer[at])
        sums[:n] += _TABLE[at << 8:at + 1 << 8][raw[begin[:n] + at]]
    if n := int(longer[64]):  # each further stretch of 64 bytes has a factor of its own
        begin, rest = begin[:n], size[order[:n]] - 64
        where = ragged(begin + 64, rest)
        at = where - np.repeat(begin, rest)
        value = _TABLE[(at & 63) << 8 | raw[where]] * (mixed((at >> 6).astype(np.uint64)) | np.uint64(1))
        sums[:n] += np.add.reduceat(value, np.cumsum(rest) - rest)
    total = np.empty(len(size), np.uint64)
    total[order] = sums
    return mixed(total + (size.astype(np.uint64) + np.uint64(1)) * _M2)


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of several columns of 64-bit values; the order of the columns counts."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + p)
    return out


def windows(starts: np.ndarray, size: int) -> np.ndarray:
    """Positions where ``size`` consecutive words of one text begin."""
    n = int(starts[-1])
    inside = np.zeros(n + 1, np.int64)
    lengths = np.diff(starts)
    full = lengths >= size
    # +1 where a text's windows begin, -1 behind the last one.
    np.add.at(inside, starts[:-1][full], 1)
    np.add.at(inside, starts[1:][full] - size + 1, -1)
    return np.flatnonzero(np.cumsum(inside)[:n] > 0)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text's words."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]
