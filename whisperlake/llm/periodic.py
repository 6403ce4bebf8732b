"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words with smallest period q, as long as it can be, of at least ``max(SHORTEST, TIMES * q)`` words. Each text is treated
as a string of words:

* Prefix doubling names the blocks of 1, 2, 4, ... words that begin at each place: a name is the first place of the block's interval in
  the suffix array, so equal blocks have equal names, and the last names are the suffix array itself.
* A wavelet tree over the suffix array (as a matrix of bit planes) answers the range successor: the first place behind ``x`` among the
  occurrences of a block. Every dyadic block (length L = 2^k, beginning at a multiple of L in its text) asks for its occurrences that begin
  L + 1 to 2 L words later (for single words: 1 to 2). A run of period q, L < q <= 2 L, holds a block that recurs after q words.
* The window holds 2 L words, so the occurrences in it form one arithmetic progression. One or two of them are candidate periods as they
  stand. Three or more have the block's own period p as difference; the block and the progression then lie in two stretches of period p,
  and a run of period q shifts the end of the first onto the end of the second: that distance is the candidate.
* Candidates are extended to both sides by the block names (longest common extensions), which gives exact stretches; the smallest period of
  equal stretches stays.

Everything is one pass over the texts; a slice of texts, or one long text, is worked on at a time in numpy.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.arrays import Words, ragged, slices, texts_of, words
from whisperlake.llm.store import share_package

SHORTEST = 6
TIMES = 4
_SLICE = 2 << 20


class Blocks(NamedTuple):
    """Names of the dyadic blocks of all texts: ``names[k][i]`` for the 2^k words from place i on, padded with -1."""

    names: list[np.ndarray]
    suffixes: np.ndarray


def blocks(codes: np.ndarray, starts: np.ndarray) -> Blocks:
    """Prefix doubling over all texts at once; a text's blocks never equal another text's, nor do those that end behind it."""
    n = len(codes)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    end = np.repeat(starts[1:], np.diff(starts))
    key = owner * np.int64(int(codes.max(initial=0)) + 1) + codes
    active = np.arange(n)
    name = np.zeros(n + 1, np.int32)
    name[n] = -1
    base = np.zeros(n, np.int64)  # where the interval of each place's shorter block begins
    names: list[np.ndarray] = []
    length = 1
    while len(active):
        order = np.argsort(key, kind="stable")
        place, sorted_key, low = active[order], key[order], base[active[order]]
        rank = np.arange(len(order))
        new = np.ones(len(order), bool)
        new[1:] = np.diff(sorted_key) != 0
        group = np.ones(len(order), bool)
        group[1:] = np.diff(low) != 0
        first = np.maximum.accumulate(np.where(new, rank, 0))
        # Within its old interval a block begins as many places later as there are smaller ones.
        fresh = low + first - np.maximum.accumulate(np.where(group, rank, 0))
        name = name.copy()
        name[place] = fresh
        names.append(name)
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        active = np.sort(place[np.repeat(size > 1, size)])
        base = name[:n].astype(np.int64)
        follow = active + length
        inside = follow < end[active]
        second = np.where(inside, name[np.minimum(follow, n)].astype(np.int64) + 1, 0)
        key = base[active] * np.int64(n + 1) + second
        length *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[name[:n]] = np.arange(n)
    return Blocks(names, suffixes)


class WaveletTree:
    """Ranges of a sequence of whole numbers below 2^levels: how many are below a value, and the k-th smallest."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.levels, self.planes, self.before, self.zeros = levels, [], [], []
        for level in range(levels - 1, -1, -1):
            one = (values >> level & 1).astype(bool)
            bits = np.packbits(np.append(one, np.zeros(64 - len(one) % 64, bool)), bitorder="little").view("<u8")
            self.planes.append(bits)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1])).astype(np.int32))
            self.zeros.append(len(one) - int(np.count_nonzero(one)))
            values = np.concatenate((values[~one], values[one]))

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k][word] + np.bitwise_count(self.planes[k][word] & mask)

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many numbers at [low, high) are smaller than ``value``."""
        out = np.where(value >> self.levels > 0, high - low, 0)
        for k in range(self.levels):
            one = (value >> (self.levels - 1 - k) & 1).astype(bool)
            a, b = self._ones(k, low), self._ones(k, high)
            out += np.where(one & (value >> self.levels == 0), (high - low) - (b - a), 0)
            low, high = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, high - b)
        return out

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number with ``k`` smaller or equal ones before it at [low, high)."""
        out = np.zeros(len(low), np.int64)
        for level in range(self.levels):
            a, b = self._ones(level, low), self._ones(level, high)
            zero = (high - low) - (b - a)
            one = k >= zero
            k = np.where(one, k - zero, k)
            out = out * 2 + one
            low, high = np.where(one, self.zeros[level] + a, low - a), np.where(one, self.zeros[level] + b, high - b)
        return out


def extension(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from places i and j > i of one text on are equal."""
    out = np.zeros(len(i), np.int64)
    last = len(names[0]) - 1
    for k in range(len(names) - 1, -1, -1):
        same = names[k][i + out] == names[k][np.minimum(j + out, last)]
        out += same.astype(np.int64) << k
    return out


def extension_back(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many words before places i and j > i of one text (from ``start`` on) are equal."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        size = 1 << k
        inside = i - out - size >= start
        same = inside & (names[k][np.maximum(i - out - size, 0)] == names[k][np.maximum(j - out - size, 0)])
        out += same.astype(np.int64) << k
    return out


class Runs(NamedTuple):
    """Runs ordered by text, start and period; start and end (behind it) as places among all words."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


def _candidates(b: Blocks, tree: WaveletTree, starts: np.ndarray, local: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods that the dyadic blocks of 2^k words propose."""
    n, length = len(local), 1 << k
    name = b.names[k][:n]
    size = np.bincount(name, minlength=n)
    place = np.flatnonzero((local & (length - 1) == 0) & (size[name] > 1))
    low = name[place].astype(np.int64)
    high = low + size[low]
    at = local[place]
    nearest = at + (1 if k == 0 else length + 1)
    first = tree.below(low, high, nearest)
    number = tree.below(low, high, at + 2 * length + 1) - first
    some = number > 0
    place, low, high, at, first, number = (x[some] for x in (place, low, high, at, first, number))
    successor = tree.kth(low, high, first)
    places, periods = [place], [successor - at]
    two = number == 2
    places.append(place[two])
    periods.append(tree.kth(low[two], high[two], first[two] + 1) - at[two])
    many = np.flatnonzero(number > 2)
    if len(many):
        i, j = place[many], place[many] + successor[many] - at[many]
        own = tree.kth(low[many], high[many], first[many] + 1) - successor[many]
        places.append(i)
        # The ends of the two stretches of the block's own period.
        periods.append(j + extension(b.names, j, j + own) - i - extension(b.names, i, i + own))
    place, period = np.concatenate(places), np.concatenate(periods)
    keep = (period > (0 if k == 0 else length)) & (period <= 2 * length)
    return place[keep], period[keep]


def runs(codes: np.ndarray, starts: np.ndarray) -> Runs:
    """All runs of the texts whose words are ``codes[starts[i]:starts[i + 1]]``."""
    none = np.zeros(0, np.int64)
    if not len(codes):
        return Runs(none, none, none, none)
    b = blocks(codes, starts)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    local = np.arange(len(codes)) - starts[:-1][owner]
    tree = WaveletTree(local[b.suffixes], max(1, int(np.diff(starts).max()).bit_length()))
    proposed = [_candidates(b, tree, starts, local, k) for k in range(len(b.names) - 1)]
    place, period = (np.concatenate([none, *(x[c] for x in proposed)]) for c in (0, 1))
    if not len(place):
        return Runs(none, none, none, none)
    text = owner[place]
    start = place - extension_back(b.names, place, place + period, starts[:-1][text])
    end = place + period + extension(b.names, place, place + period)
    keep = end - start >= np.maximum(SHORTEST, TIMES * period)
    text, start, end, period = (x[keep] for x in (text, start, end, period))
    # The smallest period of each stretch.
    order = np.lexsort((period, end, start))
    text, start, end, period = (x[order] for x in (text, start, end, period))
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
    text, start, end, period = (x[new] for x in (text, start, end, period))
    order = np.lexsort((period, start))
    return Runs(*(x[order] for x in (text, start, end, period)))


def covered(r: Runs, n: int) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, r.start + r.period, 1)
    np.add.at(depth, r.end, -1)
    return np.cumsum(depth)[:n] > 0


def _joined(w: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text with one space between."""
    edges = np.concatenate(([0], np.cumsum(keep)))[w.starts].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(edges), w.vocab.cast(pa.large_string()).take(pa.array(w.codes[keep])))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


_FIELDS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
           ("runs", pa.large_string()), ("collapsed", pa.large_string())]
_RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string"


def described(w: Words) -> list[pa.Array]:
    """The columns of ``_FIELDS`` for some texts."""
    found = runs(w.codes, w.starts)
    size = len(w.starts) - 1
    number = np.bincount(found.text, minlength=size)
    length = found.end - found.start
    begin = found.start - w.starts[:-1][found.text]
    # Exact for texts of less than 2^26 words: unequal fractions then differ as doubles, equal ones don't.
    ratio = length / np.maximum(found.period, 1)
    order = np.lexsort((found.period, found.start, -ratio, found.text))
    best = order[np.searchsorted(found.text[order], np.flatnonzero(number))]
    row = np.full(size, -1)
    row[number > 0] = best
    pick = pa.array(row, mask=row < 0)
    columns = [pa.array(x).take(pick) for x in (begin, length, found.period, 1000 * length // np.maximum(found.period, 1))]
    edge = np.concatenate(([0], np.cumsum(number)))
    rows = list(map("%d,%d,%d\n".__mod__, zip(begin.tolist(), length.tolist(), found.period.tolist())))
    told = ["".join(rows[a:b]) for a, b in zip(edge, edge[1:])]
    kept = _joined(w, ~covered(found, len(w.codes)))
    return [pa.array(number), *columns, pa.array(told, pa.large_string()), kept]


def planted(w: Words, seeds: np.ndarray) -> Words:
    """Some texts with a periodic tail, drawn by their seeds: with seed % 10 = 0 the words from a = g % n on repeat those from a on with
    a period of 1 + (n - a) // (3 + g % 8) at most, where g = seed // 10 and n is the number of words."""
    n = np.diff(w.starts)
    some = np.flatnonzero((seeds % 10 == 0) & (n > 0))
    if not len(some):
        return w
    n, g = n[some], seeds[some] // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    to = ragged(w.starts[:-1][some] + a, n - a)
    first = np.repeat(w.starts[:-1][some] + a, n - a)
    codes = w.codes.copy()
    codes[to] = w.codes[first + (to - first) % np.repeat(p, n - a)]
    return Words(codes, w.starts, w.vocab)


def _search(plant: bool):
    def run(batches):
        for batch in batches:
            for at, part in slices(texts_of(batch.column(1)), _SLICE):
                w = words(part)
                if plant:
                    w = planted(w, pc.fill_null(batch.column(2).slice(at, len(part)), 1).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), *described(w)], schema=pa.schema([("doc_id", pa.int64()), *_FIELDS]))

    return run


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; nothing else is read), in words ``[^\\x20\\x09-\\x0D]+`` numbered from 0: doc_id, ``n_runs``;
    ``start``, ``length``, ``period`` and ``exponent_milli`` (1000 * length // period) of the run with the greatest length / period (ties: smallest
    start, then period; null without runs); ``runs`` (each run as ``start,length,period`` and a line feed, by start and period) and
    ``collapsed`` (the words that no run holds after its first period, joined by one space).

    ``plant`` first gives the texts with crc32(doc_id) % 10 = 0 a periodic tail (see ``planted``), never those without a doc_id.
    Null and empty texts have no words and no runs; ids may be null or repeated; equal rows give equal rows; an empty table gives no rows.
    """
    share_package(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id, F.col("text").cast("string"), F.crc32(doc_id.cast("string").cast("binary")).alias("seed"))
    return rows.mapInArrow(_search(plant), f"doc_id long, {_RESULT}")
