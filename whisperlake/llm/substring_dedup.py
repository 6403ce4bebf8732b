"""Repeated passages of words, by suffix trees over parts of the suffixes that prefixes split to the size of memory.

A window of ``size`` words is repeated if its word sequence begins anywhere else too. Suffixes of all texts that share ``size`` words are those
below an internal node of that depth in the suffix tree; the tree of a whole corpus is split by the suffixes' prefixes:

* Suffixes begin at anchors: in each window the place whose ``PREFIX`` words have the smallest hash. Equal windows have their anchor at the
  same place, and consecutive windows mostly share one, so there is one suffix for about a dozen words. A suffix carries the words of
  its own windows only: up to size - PREFIX words to the left of the anchor and up to ``size`` from it on (its label).
* The prefix of ``PREFIX`` words is the suffix's first group. Prefixes that occur once are dropped with their suffixes. Suffixes with equal labels
  are one leaf; a group of one leaf is a single deep node, so that all its windows are repeated if it occurs twice.
* Other groups go to tasks with their labels, many small ones to each. A task sorts the leaves of a group by the words that follow the anchor;
  neighbours' common lengths give the tree's internal nodes of each depth. The same over the words to the left, backwards, gives the
  mirrored tree. A window that begins j words left of its anchor is repeated if two leaves are below one node of depth size - j in the
  first tree and below one of depth j in the second.
* A group of more than ``leaves`` leaves is split by longer prefixes: its windows' own suffixes, by all their ``size`` words. That is the
  depth asked for, so such a group is a node and needs no tree, only a count, which Spark begins on the map side.

Groups and labels are named by 64-bit hashes, together 128 bits; within a tree words are compared themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.arrays import hashes, mixed, ragged, slices, texts_of, windows, words
from whisperlake.llm.store import sent_if_small, share_package, written

WINDOW = 35
PREFIX = 8
# Most leaves of a group that one task builds a tree of.
LEAVES = 20_000
_SLICE = 4 << 20
# Bytes of labels that a task takes up before it builds their trees, and for each task of that stage.
_TREES = 4 << 20
_PART_WORDS = 1 << 20
# Anchors are ordered by the upper bits of their hash, then by place.
_PLACE = np.uint64((1 << 26) - 1)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


class Rolled:
    """Hashes of any stretch of a sequence of word hashes, by powers of an odd base."""

    def __init__(self, token: np.ndarray, base: np.uint64) -> None:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        n = len(token)
        self.back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, inverse))), dtype=np.uint64)
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n - 1, 0), base))), dtype=np.uint64)[:n]
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(token * power, dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(np.uint64))


def anchors(rolled: Rolled, starts: np.ndarray, size: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all windows, and the first and last window of each (all as places among the words of all texts)."""
    begin = windows(starts, size)
    if not len(begin):
        return begin, begin, begin
    n = int(starts[-1])
    place = np.arange(n - prefix + 1)
    local = (place - np.repeat(starts[:-1], np.diff(starts))[place]).astype(np.uint64)
    least = (rolled.of(place, place + prefix) & ~_PLACE) | (local & _PLACE)
    # The smallest of size - prefix + 1 neighbours, by doubling.
    span, width = size - prefix + 1, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:len(least) - step], least[step:])
        width += step
    text = np.searchsorted(starts, begin, side="right") - 1
    # Place of the anchor: the one at or behind the window's begin with these low bits.
    ahead = (least[begin] - (begin - starts[:-1][text]).astype(np.uint64)) & _PLACE
    at = begin + ahead.astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], begin[first], begin[np.append(first[1:], len(at)) - 1]


_ANCHOR = pa.schema([("name", pa.binary()), ("row", pa.int64()), ("pos", pa.int32()), ("back", pa.int32()), ("ahead", pa.int32()),
                     ("key", pa.int64()), ("label", pa.int64())])
_ANCHOR_DDL = "name binary, row long, pos int, back int, ahead int, key long, label long"


def _anchor_rows(size: int, prefix: int):
    def run(batches):
        # Names the rows of one written table; never compared with another run's.
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, part in slices(texts_of(batch.column(1)), _SLICE):
                w = words(part)
                rolled = Rolled(hashes(w.vocab)[w.codes], _BASES[0])
                place, first, last = anchors(rolled, w.starts, size, prefix)
                text = np.searchsorted(w.starts, place, side="right") - 1
                back, ahead = place - first, last + size - place
                label = mixed(rolled.of(first, last + size) + (back * 256 + ahead).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(part)).take(pa.array(text)), pa.array(row + text), pa.array((place - w.starts[:-1][text]).astype(np.int32)),
                    pa.array(back.astype(np.int32)), pa.array(ahead.astype(np.int32)),
                    pa.array(rolled.of(place, place + prefix).view(np.int64)), pa.array(label.view(np.int64))], schema=_ANCHOR)
                row += len(part)

    return run


def _asked(batch: pa.RecordBatch, column: int = 1) -> tuple[np.ndarray, pa.StructArray]:
    asked = batch.column(column)
    return np.repeat(np.arange(batch.num_rows), np.asarray(asked.value_lengths())), asked.flatten()


def _first_copies(batches):
    """Rows (text, leaves, name) without those that repeat a name of the same task."""
    seen: set[bytes] = set()
    for batch in batches:
        names = batch.column(2).to_pylist()
        fresh = [n not in seen and not seen.add(n) for n in names]
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _label_rows(batches):
    """Rows (text, leaves asked of it, its name) to leaves with their words; a text comes from each task that has it, at most."""
    for batch in _first_copies(batches):
        for at, part in slices(texts_of(batch.column(0)), _SLICE):
            w = words(part)
            text, rows = _asked(batch.slice(at, len(part)))
            pos, back, ahead = (np.asarray(rows.field(c)).astype(np.int64) for c in ("pos", "back", "ahead"))
            edges = np.concatenate(([0], np.cumsum(back + ahead))).astype(np.int32)
            codes = w.codes[ragged(w.starts[:-1][text] + pos - back, back + ahead)]
            lists = pa.ListArray.from_arrays(pa.array(edges), w.vocab.cast(pa.large_string()).take(pa.array(codes)))
            label = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(rows.field(c) for c in ("key", "label", "often", "back", "ahead")), label], names=["key", "label", "often", "back", "ahead", "words"])


def _window_rows(size: int):
    """Rows (text, leaves asked of it, its name) to the windows of the leaves, each with two hashes of all its words."""
    def run(batches):
        for batch in _first_copies(batches):
            for at, part in slices(texts_of(batch.column(0)), _SLICE):
                w = words(part)
                token = hashes(w.vocab)[w.codes]
                text, rows = _asked(batch.slice(at, len(part)))
                pos, back, ahead = (np.asarray(rows.field(c)).astype(np.int64) for c in ("pos", "back", "ahead"))
                low = size - ahead
                number = back - low + 1
                leaf = np.repeat(np.arange(len(text)), number)
                offset = ragged(low, number)
                begin = w.starts[:-1][text][leaf] + pos[leaf] - offset
                w1, w2 = (Rolled(token, base).of(begin, begin + size) for base in _BASES)
                take = pa.array(leaf)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.field(c).take(take) for c in ("key", "label", "often")), pa.array(offset.astype(np.int32)), pa.array(w1.view(np.int64)),
                     pa.array(w2.view(np.int64))], names=["key", "label", "often", "offset", "w1", "w2"])

    return run


def sorted_tree(group: np.ndarray, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaves in the order of (group, symbols), and the common length of each with the one before it (-1: another group).

    Row i holds ``length[i]`` symbols; what stands behind them counts for nothing. The internal nodes of depth d are the longest stretches of
    two leaves or more whose common lengths are all d or more.
    """
    width = symbols.shape[1]
    valid = np.arange(width) < length[:, None]
    order = np.lexsort((*(np.where(valid, symbols, -1)[:, c] for c in range(width - 1, -1, -1)), group))
    s, v = symbols[order], valid[order]
    common = np.cumprod((s[1:] == s[:-1]) & v[1:] & v[:-1], axis=1).sum(1)
    same = group[order][1:] == group[order][:-1]
    return order, np.concatenate(([-1], np.where(same, common, -1)))


def nodes_of_depth(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """The node of depth ``depth`` above each leaf; a leaf alone has a number of its own."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeated_windows(group: np.ndarray, ahead_of: np.ndarray, ahead: np.ndarray, back_of: np.ndarray, back: np.ndarray, often: np.ndarray, size: int) -> np.ndarray:
    """For each leaf a bit for each window that is repeated (bit j: begins j words left of the anchor).

    ``ahead_of``: words from the anchor on, ``back_of``: words left of it, the nearest first; ``ahead`` and ``back`` are their numbers.
    """
    forward = sorted_tree(group, ahead_of, ahead)
    backward = sorted_tree(group, back_of, back)
    out = np.zeros(len(group), np.int64)
    for j in range(int(back.max(initial=-1)) + 1):
        # Leaves that have this window: both parts of it are in their labels.
        own = np.flatnonzero((back >= j) & (size - j <= ahead))
        if not len(own):
            continue
        right, left = nodes_of_depth(*forward, size - j)[own], nodes_of_depth(*backward, j)[own]
        _, which, number = np.unique(right * np.int64(len(group) + 1) + left, return_inverse=True, return_counts=True)
        some = own[(number[which] > 1) | often[own]]
        out[some] |= np.int64(1) << np.int64(j)
    return out


def _build(t: pa.Table, size: int) -> pa.RecordBatch:
    """The trees of all groups of ``t``, which holds groups as a whole; leaves of copied texts may stand several times, one behind the other."""
    key, label = t.column("key").to_numpy(), t.column("label").to_numpy()
    t = t.filter(pa.array(np.concatenate(([True], (np.diff(key) != 0) | (np.diff(label) != 0))))).combine_chunks()
    w = words(texts_of(t.column("words")))
    back, ahead = (t.column(c).to_numpy().astype(np.int64) for c in ("back", "ahead"))
    begin = w.starts[:-1]
    width = max(int(ahead.max()), 1), max(int(back.max()), 1)
    last = len(w.codes) - 1
    right = w.codes[np.minimum((begin + back)[:, None] + np.arange(width[0]), last)]
    left = w.codes[np.maximum((begin + back - 1)[:, None] - np.arange(width[1]), 0)]
    found = repeated_windows(t.column("key").to_numpy(), right, ahead, left, back, t.column("often").to_numpy(), size)
    return pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in ("key", "label")] + [pa.array(found)], names=["key", "label", "mask"])


def _trees(size: int):
    def run(batches):
        held: list[pa.RecordBatch] = []
        bytes_ = 0
        for batch in batches:
            held.append(batch)
            bytes_ += batch.nbytes
            if bytes_ < _TREES:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            # The last group may go on in the next batch.
            cut = int(pc.index(t.column("key"), t.column("key")[-1]).as_py())
            if cut:
                yield _build(t.slice(0, cut), size)
            t = t.slice(cut)
            held, bytes_ = t.to_batches(), t.nbytes
        if held and sum(b.num_rows for b in held):
            yield _build(pa.Table.from_batches(held).combine_chunks(), size)

    return run


def _merged(size: int):
    """Rows (name, list of (pos, mask)) to the stretches of words that repeated windows cover, as begin, end, begin, end, ..."""
    def run(batches):
        for batch in batches:
            text, rows = _asked(batch)
            pos, mask = np.asarray(rows.field("pos")).astype(np.int64), np.asarray(rows.field("mask")).astype(np.int64)
            row, offset = np.nonzero(mask[:, None] >> np.arange(size) & 1)
            owner, begin = text[row], pos[row] - offset
            order = np.lexsort((begin, owner))
            owner, begin = owner[order], begin[order]
            new = np.ones(len(begin), bool)
            new[1:] = (np.diff(owner) != 0) | (np.diff(begin) > size)
            first = np.flatnonzero(new)
            ends = begin[np.append(first[1:], len(begin)) - 1] + size if len(begin) else begin
            edges = np.concatenate(([0], np.cumsum(2 * np.bincount(owner[first], minlength=batch.num_rows)))).astype(np.int32)
            flat = np.stack((begin[first], ends), 1).ravel().astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], names=["name", "spans"])

    return run


def _kept(batches):
    """Rows (doc_id, text, stretches) to (doc_id, n_words, n_removed, spans, text)."""
    for batch in batches:
        for at, part in slices(texts_of(batch.column(1)), _SLICE):
            w = words(part)
            spans = batch.column(2).slice(at, len(part))
            number = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False) // 2
            flat = spans.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2)
            owner = np.repeat(np.arange(len(part)), number)
            gone = np.zeros(len(w.codes) + 1, np.int64)
            np.add.at(gone, w.starts[:-1][owner] + flat[:, 0], 1)
            np.add.at(gone, w.starts[:-1][owner] + flat[:, 1], -1)
            keep = np.cumsum(gone)[:-1] == 0
            edges = np.concatenate(([0], np.cumsum(keep)))[w.starts].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), w.vocab.cast(pa.large_string()).take(pa.array(w.codes[keep])))
            n = np.diff(w.starts)
            out = pc.fill_null(spans, pa.scalar([], spans.type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(part)), pa.array(n), pa.array(n - np.diff(edges)), out,
                 pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "text"])


def _name(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _spans(texts: DataFrame, size: int, prefix: int, leaves: int) -> DataFrame:
    """(name, spans) for the texts of ``texts`` (text) that lose words."""
    spark = texts.sparkSession
    named = texts.select(_name(F.col("text")).alias("name"), "text")
    places = written(named.mapInArrow(_anchor_rows(size, prefix), _ANCHOR_DDL), "anchors")
    place = F.xxhash64("row", "pos")
    groups = written(places.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a != b").select("key"), "prefixes")
    shared = places.join(sent_if_small(groups, 8), "key")
    all_leaves = written(shared.groupBy("key", "label").agg(
        F.min(place).alias("a"), F.max(place).alias("b"), F.first("name").alias("name"), F.first("pos").alias("pos"), F.first("back").alias("back"),
        F.first("ahead").alias("ahead")).select("key", "label", "name", "pos", "back", "ahead", (F.col("a") != F.col("b")).alias("often")), "leaves")
    # Groups in which a leaf that occurs once may share windows with others.
    open_groups = written(all_leaves.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("often").alias("settled")).filter("n > 1 and not settled"), "groups")
    found = all_leaves.join(sent_if_small(open_groups, 24), "key")
    asked = written(found.groupBy("name", (F.col("n") > leaves).alias("split")).agg(
        F.collect_list(F.struct("key", "label", "often", "pos", "back", "ahead")).alias("asked")), "asked")

    def of_texts(rows: DataFrame) -> DataFrame:
        few = sent_if_small(rows.select("name", "asked"), 32 + 40 * F.size("asked"))
        return named.join(few, "name").select("text", "asked", "name")

    total, split = open_groups.agg(F.sum("n"), F.count(F.when(F.col("n") > leaves, 1))).first()
    labels = of_texts(asked.filter("not split")).mapInArrow(_label_rows, "key long, label long, often boolean, back int, ahead int, words string")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) * size // _PART_WORDS)
    masks = labels.repartition(parts, "key").sortWithinPartitions("key", "label").mapInArrow(_trees(size), "key long, label long, mask long")
    if split:
        rows = of_texts(asked.filter("split")).mapInArrow(_window_rows(size), "key long, label long, often boolean, offset int, w1 long, w2 long").distinct()
        twice = rows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.max("often").alias("o")).filter("n > 1 or o").select("w1", "w2")
        masks = masks.union(rows.join(twice, ["w1", "w2"]).groupBy("key", "label").agg(
            F.bit_or(F.expr("shiftleft(1L, offset)")).alias("mask")))
    masks = written(masks, "repeated-windows")
    # Leaves of the other groups occur twice with all of their windows.
    whole = F.expr(f"shiftleft(1L, back + 1) - shiftleft(1L, {size} - ahead)")
    marked = all_leaves.select("key", "label", "back", "ahead").join(sent_if_small(open_groups.select("key"), 8), "key", "left_anti").select("key", "label", whole.alias("mask"))
    marked = written(masks.filter("mask != 0").union(marked), "marked-leaves")
    gone = places.select("name", "pos", "key", "label").join(sent_if_small(marked, 24), ["key", "label"])
    by_text = gone.groupBy("name").agg(F.collect_set(F.struct("pos", "mask")).alias("gone"))
    return written(by_text.mapInArrow(_merged(size), "name binary, spans array<int>"), "spans")


def repeated_passages(docs: DataFrame, size: int = WINDOW, prefix: int = PREFIX, leaves: int = LEAVES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; nothing else is read), in words ``[^\\x20\\x09-\\x0D]+``: doc_id, ``n_words``, ``n_removed``, ``spans`` (begin
    and end of each stretch of words that goes: begin, end, begin, end, ...) and ``text`` (the words that stay, joined by one space).

    Every word goes that lies in a window of ``size`` words whose word sequence begins at another place too, in the same text or in another row. Words are
    compared as they are. Null and empty texts have no words; texts of fewer than ``size`` words lose none; rows with equal texts of ``size`` words or
    more lose all; ids may be null or repeated and play no part. An empty table gives no rows. ``size`` is at most 62, ``prefix`` less.
    """
    if not 0 < prefix < size <= 62:
        raise ValueError("a prefix is shorter than a window, which has at most 62 words")
    share_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = sent_if_small(_spans(texts.select("text"), size, prefix, leaves), 24 + 4 * F.size("spans"))
    both = texts.withColumn("name", _name(F.col("text"))).join(spans, "name", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, spans array<int>, text string")
