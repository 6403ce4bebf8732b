"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are compared as sequences of words without letter case and marks around them. Windows of
``least`` words that occur in an item are seeds. A document and an item that share seeds are tiled: the longest match of unmarked
words is marked again and again, so that no word is in two tiles, however the passage was reordered or cut up. Matches are found by
Karp-Rabin hashes of windows whose length goes down from long to ``least``. An item leaks if its tiles cover ``coverage`` of its words.

The items are a stated query set. They go to the tasks in blocks of bounded size, and each block meets all documents where these
lie: nothing is shuffled, and a passage that very many documents hold is as cheap as any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.arrays import Words, drop_empty, hashes, ragged, slices, strings, texts_of, windows, words
from whisperlake.llm.store import share_package, written

LEAST = 4
COVERAGE = 0.5
# Characters of benchmark text in a block; a block's index takes about ten times as many bytes in each task.
BLOCK_CHARS = 4 << 20
_MARKS = '!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’–—…¿¡'
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, and where each text begins. Words of marks only are left out."""
    w: Words = words(texts)
    plain = [v.strip(_MARKS).lower() for v in strings(w.vocab)]
    value = hashes(pa.array(plain, pa.large_string()))
    codes = np.where(np.array([not p for p in plain], bool)[w.codes], -1, w.codes) if plain else w.codes
    codes, starts = drop_empty(codes + 1, w.starts, 0)
    return value[codes - 1], starts


def window_hashes(token: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2^64) of the windows of ``size`` words that begin at ``at``."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * _BASE + token[at + k]
    return out


class Index(NamedTuple):
    """Some benchmark items and their seeds."""

    names: list
    token: np.ndarray
    starts: np.ndarray
    seeds: np.ndarray  # sorted, distinct
    first: np.ndarray  # of each seed in ``places``
    places: np.ndarray  # positions in ``token``
    item: np.ndarray  # of each position in ``token``
    bits: np.ndarray  # a first, coarse test of a seed
    least: int


def index_of(names: list, texts: list[str], least: int) -> Index:
    token, starts = tokens(texts_of(pa.array(texts, pa.string())))
    at = windows(starts, least)
    h = window_hashes(token, at, least)
    order = np.argsort(h, kind="stable")
    seeds, first = np.unique(h[order], return_index=True)
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[(seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Index(names, token, starts, seeds, np.append(first, len(at)), at[order], np.repeat(np.arange(len(names)), np.diff(starts)), bits, least)


def _matches(doc: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, item position, document position) of at least ``size`` unmarked words."""
    def open_windows(free: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(free)))
        return np.flatnonzero(total[size:] - total[:-size] == size)

    di, ii = open_windows(free_d), open_windows(free_i)
    hd, hi = window_hashes(doc, di, size), window_hashes(item, ii, size)
    places: dict[int, list[int]] = {}
    for p, h in zip(ii.tolist(), hi.tolist()):
        places.setdefault(h, []).append(p)
    known = np.isin(hd, hi)
    out = []
    for d, h in zip(di[known].tolist(), hd[known].tolist()):
        for i in places[h]:
            if d and i and free_d[d - 1] and free_i[i - 1] and doc[d - 1] == item[i - 1]:
                continue  # part of a longer match
            n = 0
            while d + n < len(doc) and i + n < len(item) and free_d[d + n] and free_i[i + n] and doc[d + n] == item[i + n]:
                n += 1
            if n >= size:
                out.append((n, i, d))
    return out


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (length, item position, document position) of each tile, longest first within a search length."""
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), 4 * least))
    while True:
        found = _matches(doc, item, free_d, free_i, size)
        longest = max((m[0] for m in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        while found:
            # Ties go to the first place in the item, then in the document.
            n, i, d = min(found, key=lambda m: (-m[0], m[1], m[2]))
            out.append((n, i, d))
            free_d[d:d + n] = False
            free_i[i:i + n] = False
            rest = []
            for n, i, d in found:
                # What the marks have left of a match, as runs of unmarked words.
                run = np.flatnonzero(np.diff(np.concatenate(([0], (free_d[d:d + n] & free_i[i:i + n]).astype(np.int8), [0]))))
                rest += [(int(b - a), i + int(a), d + int(a)) for a, b in zip(run[::2], run[1::2]) if b - a >= size]
            found = rest
        if size == least:
            return out
        size = max(least, size // 2)


def leaks(texts: pa.Array, index: Index, coverage: float) -> list[list[dict]]:
    """For each text the items that leak into it."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    token, starts = tokens(texts)
    at = windows(starts, index.least)
    h = window_hashes(token, at, index.least)
    maybe = np.flatnonzero(index.bits[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    if not len(maybe) or not len(index.seeds):
        return out
    where = np.minimum(np.searchsorted(index.seeds, h[maybe]), len(index.seeds) - 1)
    hit = index.seeds[where] == h[maybe]
    at, where = at[maybe[hit]], where[hit]
    doc = np.searchsorted(starts, at, side="right") - 1
    number = index.first[where + 1] - index.first[where]
    place = index.places[ragged(index.first[where], number)]
    # Distinct (document, place in an item); the words under them bound what tiles can cover.
    pairs = np.unique(np.repeat(doc, number) * np.int64(len(index.token)) + place)
    doc, place = pairs // len(index.token), pairs % len(index.token)
    group = doc * np.int64(len(index.names)) + index.item[place]
    gap = np.diff(place, prepend=-index.least)
    new = np.diff(group, prepend=-1) != 0
    covered = np.where(new, index.least, np.minimum(gap, index.least))
    first = np.flatnonzero(new)
    most = np.add.reduceat(covered, first) if len(first) else covered
    for g, bound in zip(group[first].tolist(), most.tolist()):
        d, i = divmod(g, len(index.names))
        item = index.token[index.starts[i]:index.starts[i + 1]]
        if bound < coverage * len(item):
            continue
        found = tiles(token[starts[d]:starts[d + 1]], item, index.least)
        matched = sum(n for n, _, _ in found)
        if matched >= coverage * len(item):
            out[d].append({"item_id": index.names[i], "item_words": len(item), "matched": matched, "tiles": len(found)})
    return out


_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("item_words", pa.int64()), ("matched", pa.int64()), ("tiles", pa.int64())]))
_LEAK_DDL = "array<struct<item_id: long, item_words: long, matched: long, tiles: long>>"


def leak_columns(benchmark: DataFrame, text: Column, least: int = LEAST, coverage: float = COVERAGE,
                 block_chars: int = BLOCK_CHARS) -> Iterator[Column]:
    """One array column for each block of ``benchmark`` (item_id, text): the items that leak into ``text``. They are made one at a time.

    Items of fewer than ``least`` words can't be told from chance and match nothing. Null texts are empty; repeated rows of the
    benchmark count once. Building the columns reads the benchmark, block by block.
    """
    share_package(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = items.distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // block_chars
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        index = index_of([r[0] for r in rows], [r[1] for r in rows], least)
        yield _leak_udf(index, coverage)(text.cast("string"))


def _leak_udf(index: Index, coverage: float):
    def run(column: pa.Array) -> pa.Array:
        return pa.array([x for _, t in slices(texts_of(column)) for x in leaks(t, index, coverage)], _LEAK)

    return F.arrow_udf(run, _LEAK_DDL)


def leaked_items(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document of ``docs`` (doc_id, text) and item that leaks into it: doc_id, item_id, ``item_words``,
    ``matched`` (words in tiles), ``tiles`` and ``coverage``.

    Null and empty texts leak nothing; null ids stay null; each repeated row is reported; no other column is read.
    """
    # Written block by block, so that no plan and no task holds more than one block of the benchmark.
    parts = [written(docs.select(F.col("doc_id").cast("long"), F.explode(c).alias("l")).select("doc_id", "l.*"), "leaks")
             for c in leak_columns(benchmark, F.col("text"), **options)]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("coverage", F.col("matched") / F.col("item_words"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns."""
    # The last block's filter is left to whoever reads the result; what the others leave is written.
    left = None
    for c in leak_columns(benchmark, F.col("text"), **options):
        docs = docs if left is None else written(left, "without-leaks")
        left = docs.filter(F.size(c) == 0)
    return left
