"""Line de-duplication by an exact set-similarity join.

A line is the set of its words (A-Z lower-cased). Lines with equal sets are one class, of which the first line, by (doc_id, hash of the
text, line number), stands for all: ids may be null or repeated, so a text is named by both. Classes are joined where the Jaccard similarity of their sets is ``4 / 5`` or more:

* words are ordered from rare to frequent, and a set of n words is indexed under its first n - ceil(4 n / 5) + 1 words only, as
  sets that are similar enough share one of these (prefix filter);
* the sizes of similar sets differ by a quarter at most (length filter);
* what can still follow the shared word in both sets must reach the overlap needed (positional filter);
* a word of only one of the sets flips one of 64 parity bits, so similar sets differ in few of these bits (bitmap filter);
* pairs that pass are not written out. The sets of one word are compared in place, and a spanning forest of those that pass is kept. The
  trees of all words that have the same first set are a clump; similar sets share one. What the filters need is sent in packed blocks of words;
* each set is sent to its few clumps, where all pairs are verified on the words themselves, and leaves as the number of its links
  and the first line that it is linked to. Frequent words are sent as the gaps between their ranks, a byte or two for each. Clumps and
  words with very many sets are dealt in parts, each two of which meet in a task.

A line goes if an earlier line has an equal or similar set. Rarity comes from a summary of the frequent words of all documents:
each task reports the words that it has seen ``_OFTEN`` times or more, and the ``MOST_WORDS`` with the largest sums are kept. All other
words are rarer than those. The summary only orders the words; any order gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.arrays import gathered, hashes, mixed, ragged, slices, texts_of, words
from whisperlake.llm.store import sent_if_small, share_package, tidy, unused, written

# Similarity as a fraction, so that all bounds are whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
MOST_WORDS = 1 << 17
_OFTEN = 4
_SALT = np.uint64(0xD6E8FEB86659FD93)
_SLICE = 4 << 20
# Sets of a run up to which its pairs are listed, and up to which they are compared as one square.
_SMALL, _SQUARE = 64, 512
# Sets of a word, and sets and words of a clump, from which on these are dealt in parts.
_WORD_SETS = 1 << 16
_CLUMP, _CLUMP_WORDS = 2048, 1 << 21
# Classes (by the last bits of their hashes) in which words are counted first, and columns of a matrix of words.
_CLASSES = 1 << 18
_CLASS_ROW = 1 << 12
_COLUMNS = 1024
# Sets of a clump up to which pairs are compared one by one, and cells of a matrix for those of up to _SMALL.
_LISTED = 8
_DENSE = 1 << 20
# Words that are compared at a time, and new words of a task from which on they are merged with those counted before.
_VERIFIED = 1 << 20
_MERGED = 1 << 20
# Rows of indexed words in a block, about, and bytes of sets that are packed at a time.
_BLOCK_ROWS = 1 << 17
_PACKED = 8 << 20
# A packed row: hash of the word, id and parity of the set, its words, and those from the shared one on.
_ROW = [np.uint32, np.int64, np.uint64, np.uint32, np.uint32]


class Frequent(NamedTuple):
    """Hashes of frequent words, sorted, and their counts."""

    word: np.ndarray
    count: np.ndarray

    def of(self, value: np.ndarray) -> np.ndarray:
        """Counts; 0 for a word that is not frequent."""
        if not len(self.word):
            return np.zeros(len(value), np.int64)
        at = np.minimum(np.searchsorted(self.word, value), len(self.word) - 1)
        return np.where(self.word[at] == value, self.count[at], 0)

    def codes(self, value: np.ndarray) -> np.ndarray:
        """Places in the order from the most frequent word on; -1 for a word that is not frequent."""
        if not len(self.word):
            return np.full(len(value), -1)
        place = np.empty(len(self.word), np.int64)
        place[np.lexsort((self.word, -self.count))] = np.arange(len(self.word))
        at = np.minimum(np.searchsorted(self.word, value), len(self.word) - 1)
        return np.where(self.word[at] == value, place[at], -1)


def needed(n: np.ndarray) -> np.ndarray:
    """ceil(n * similarity): the smallest overlap of a set of n words with a similar one."""
    return -(-n * NUMERATOR // DENOMINATOR)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines (A-Z lower-cased), and where each text's lines begin."""
    parts = pc.split_pattern(pc.ascii_lower(texts), "\n")
    return parts.flatten(), parts.offsets.to_numpy().astype(np.int64)


def _count_words(batches):
    word, n = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]

    def merge():
        order = np.argsort(np.concatenate(word))
        values, counts = np.concatenate(word)[order], np.concatenate(n)[order]
        starts = np.flatnonzero(np.concatenate((np.ones(min(len(values), 1), bool), values[1:] != values[:-1])))
        word[:], n[:] = [values[starts]], [np.add.reduceat(counts, starts) if len(starts) else counts]

    for table in gathered(batches, _SLICE):
        for _, part in slices(texts_of(table.column(0)), 2 * _SLICE):
            w = words(part)
            word.append(hashes(pc.ascii_lower(w.vocab))), n.append(np.bincount(w.codes, minlength=len(w.vocab)))
            if sum(map(len, word[1:])) > max(_MERGED, len(word[0])):
                merge()
    merge()
    word, n = word[0], n[0]
    often = n >= _OFTEN
    yield pa.RecordBatch.from_arrays([pa.array(word[often].view(np.int64)), pa.array(n[often])], names=["word", "n"])


def frequent_words(docs: DataFrame) -> Frequent:
    """The summary of all of ``docs`` (text)."""
    seen = docs.select(F.col("text").cast("string")).mapInArrow(tidy(_count_words), "word long, n long")
    total = written(seen.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    # Counts are sorted from a bound on: the largest eighth of a power of two that MOST_WORDS words reach (a few hundred rows).
    size = F.floor(F.log2("n") * 8)
    least, reached = 0, 0
    for r in sorted(total.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):
        least, reached = r["size"], reached + r["count"]
        if reached >= MOST_WORDS:
            break
    top = total.filter(size >= least).orderBy(F.desc("n"), "word").limit(MOST_WORDS).toArrow()
    word = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    return Frequent(word[order], top.column("n").to_numpy()[order])


def _line_words(lines: pa.Array, frequent: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words; the distinct words of each line, as places among these, rare ones first; and where each line begins."""
    w = words(lines)
    value = hashes(w.vocab)
    if not len(w.codes):
        return value, np.empty(0, np.int64), np.zeros(len(lines) + 1, np.int64)
    # Sorted values are looked up several times faster.
    order = np.argsort(value)
    order = order[np.argsort(frequent.of(value[order]), kind="stable")]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # Several times faster than np.unique.
    keys = np.sort(w.owner << 32 | rank[w.codes])
    keys = keys[np.diff(keys, prepend=-1) != 0]
    starts = np.concatenate(([0], np.cumsum(np.bincount(keys >> 32, minlength=len(lines)))))
    return value, order[keys & 0xFFFFFFFF], starts


def line_sets(lines: pa.Array, frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each line as hashes, rare ones first, and where each line begins."""
    value, which, starts = _line_words(lines, frequent)
    return value[which], starts


def gap_bytes(code: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Lists of whole numbers under 2^21, each ascending, as the gaps between neighbours in one to three bytes."""
    gap = np.diff(code, prepend=0)
    heads = starts[:-1][np.diff(starts) > 0]
    gap[heads] = code[heads]
    size = 1 + (gap >= 1 << 7) + (gap >= 1 << 14)
    ends = np.concatenate(([0], np.cumsum(size)))
    out, at = np.empty(ends[-1], np.uint8), ends[:-1]
    out[at] = (gap & 127) | (size > 1) * 128
    for k in (1, 2):
        long = size > k
        out[at[long] + k] = (gap[long] >> 7 * k & 127) | (size[long] > k + 1) * 128
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(ends[starts].astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def of_gaps(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``gap_bytes``, and the list of each."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].astype(np.int64)
    end = np.flatnonzero(raw < 128)
    size = np.diff(end, prepend=-1)
    at = end - size + 1
    gap = raw[at] & 127
    for k in (1, 2):
        long = size > k
        gap[long] |= (raw[at[long] + k] & 127) << 7 * k
    first = np.searchsorted(end, offsets - offsets[0])
    total = np.concatenate(([0], np.cumsum(gap)))
    owner = np.repeat(np.arange(len(column)), np.diff(first))
    return total[1:] - total[first[owner]], owner


_LINE = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("line_no", pa.int32()), ("n", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()),
                   ("parity", pa.int64()), ("prefix", pa.list_(pa.int32())), ("lead", pa.bool_())])
_TOKEN_DDL = "roots array<struct<root: long, parts: int, earlier: array<long>>>, doc_id long, text_key long, line_no int, id long, often binary, rare array<long>"
_LINE_DDL = "doc_id long, text_key long, line_no int, n int, k1 long, k2 long, parity long, prefix array<int>, lead boolean"
_LEAD_DDL = "k1 long, k2 long, doc_id long, text_key long, line_no int, n int, parity long, prefix array<int>"


def set_keys(value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: together its name."""
    out = []
    for salt in (np.uint64(0), _SALT):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(value ^ salt), dtype=np.uint64)))
        out.append((total[starts[1:]] - total[starts[:-1]]).view(np.int64))
    return out[0], out[1]


def _leads(batch: pa.RecordBatch, owner: np.ndarray, line_no: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Whether a line is the first of its set among those of ``batch`` (doc_id, text, text_key)."""
    doc = batch.column(0)
    order = np.lexsort((batch.column(2).to_numpy(), pc.fill_null(doc, 0).to_numpy(), pc.is_valid(doc).to_numpy(zero_copy_only=False)))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    order = np.lexsort((rank[owner] << 32 | line_no, k2, k1))
    out = np.zeros(len(order), bool)
    if len(order):
        out[order[_runs([k1[order], k2[order]])[0]]] = True
    return out


def _first_rows(batches):
    """Of rows sorted by their first two columns the first of each run."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(c).to_numpy() for c in range(2))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new[0] = (a[0], b[0]) != last
        last = a[-1], b[-1]
        yield batch.filter(pa.array(new))


def _line_rows(frequent: Frequent):
    """Rows (doc_id, text, text_key) to one row for each line. The first line of a set in a slice is marked; only it has the set's prefix."""
    def run(batches):
        for batch in batches:
            for at, part in slices(texts_of(batch.column(1)), _SLICE):
                lines, first = _split(part)
                value, starts = line_sets(lines, frequent)
                n = np.diff(starts)
                filled = np.flatnonzero(n)
                owner = np.repeat(np.arange(len(part)), np.diff(first))[filled]
                line_no = filled - first[owner]
                k1, k2 = (k[filled] for k in set_keys(value, starts))
                lead = _leads(batch.slice(at, len(part)), owner, line_no, k1, k2)
                # Sets of fewer words are only similar to equal ones.
                join = lead & (n[filled] >= NUMERATOR)
                length = np.where(join, n[filled] - needed(n[filled]) + 1, 0)
                bits = np.uint64(1) << (value >> np.uint64(58))
                parity = np.bitwise_xor.reduceat(bits, starts[:-1][filled]) if len(filled) else bits
                prefix = value[ragged(starts[:-1][filled], length)]
                ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(at, len(part)).take(pa.array(owner)) for c in (0, 2)), pa.array(line_no.astype(np.int32)),
                    pa.array(n[filled].astype(np.int32)), pa.array(k1), pa.array(k2),
                    pa.array(parity.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array((prefix & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))),
                    pa.array(lead)], schema=_LINE)

    return run


def _asked_lines(frequent: Frequent):
    """Words of the lines that are asked for: rows (doc_id, text_key, text, lines) to one row for each line."""
    def run(batches):
        for batch in batches:
            # Equal rows are one text.
            doc = batch.column(0)
            key = [batch.column(1).to_numpy(), pc.fill_null(doc, 0).to_numpy(), pc.is_valid(doc).to_numpy(zero_copy_only=False)]
            order = np.lexsort(key)
            once = order[_runs([k[order] for k in key])[0]]
            batch = batch.take(pa.array(np.sort(once))) if len(once) < len(order) else batch
            for at, part in slices(texts_of(batch.column(2)), _SLICE):
                lines, first = _split(part)
                asked = batch.column(3).slice(at, len(part))
                number = np.asarray(asked.value_lengths()).astype(np.int64)
                rows = asked.flatten()
                owner = np.repeat(np.arange(len(part)), number)
                which = first[owner] + np.asarray(rows.field("line_no")).astype(np.int64)
                value, word, starts = _line_words(lines.take(pa.array(which)), frequent)
                code = frequent.codes(value)[word]
                often = code >= 0
                line = np.repeat(np.arange(len(which)), np.diff(starts))
                sorted_codes = np.sort(line[often] << 32 | code[often]) & 0xFFFFFFFF
                before = np.concatenate(([0], np.cumsum(often)))[starts]
                yield pa.RecordBatch.from_arrays(
                    [rows.field("roots"), *(batch.column(c).slice(at, len(part)).take(pa.array(owner)) for c in (0, 1)),
                     rows.field("line_no"), rows.field("id"), gap_bytes(sorted_codes, before),
                     pa.ListArray.from_arrays(pa.array((starts - before).astype(np.int32)), pa.array(value[word[~often]].view(np.int64)))],
                    names=["roots", "doc_id", "text_key", "line_no", "id", "often", "rare"])

    return run


def _whole_runs(batches, keys: int):
    """Tables of whole runs of rows that are equal in the first ``keys`` columns; the rows are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in range(keys):
            column = batch.column(c).to_numpy()
            new[1:] |= column[1:] != column[:-1]
            new[0] |= not held or column[0] != held[-1].column(c)[-1].as_py()
        last = np.flatnonzero(new)[-1:]
        if len(last):
            if held or last[0]:
                yield pa.Table.from_batches([*held, batch.slice(0, last[0])]).combine_chunks()
            held = []
        held.append(batch.slice(last[0] if len(last) else 0))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal rows begin, and their lengths."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(new)))


class Filters(NamedTuple):
    """What the filters look at: parity bits, words of a set, words from the shared one on."""

    parity: np.ndarray
    n: np.ndarray
    left: np.ndarray

    def fit(self, a, b) -> np.ndarray:
        """Whether the sets at ``a`` and ``b`` can be similar."""
        a, b = np.broadcast_arrays(a, b)
        out = self._few_bits(self.parity[a] ^ self.parity[b], self.n[a] + self.n[b])
        some = np.flatnonzero(out)
        a, b = a[some], b[some]
        total = self.n[a] + self.n[b]
        out[some] = (np.minimum(self.n[a], self.n[b]) * DENOMINATOR >= np.maximum(self.n[a], self.n[b]) * NUMERATOR) & (
            np.minimum(self.left[a], self.left[b]) * (NUMERATOR + DENOMINATOR) >= total * NUMERATOR)
        return out

    @staticmethod
    def _few_bits(flipped: np.ndarray, total: np.ndarray) -> np.ndarray:
        # The symmetric difference of similar sets is at most total * (1 - s) / (1 + s), their overlap at least total * s / (1 + s).
        return np.bitwise_count(flipped) <= total * (DENOMINATOR - NUMERATOR) // (NUMERATOR + DENOMINATOR)

    def square(self, s: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that fit of the ``m`` sets from ``s`` on."""
        parity, n = self.parity[s:s + m], self.n[s:s + m]
        a, b = np.nonzero(np.triu(self._few_bits(parity[:, None] ^ parity, n[:, None] + n), 1))
        a, b = s + a, s + b
        good = self.fit(a, b)
        return a[good], b[good]


def small_pairs(starts: np.ndarray, size: np.ndarray, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one run, for runs of up to ``most`` (``_SMALL``) rows: one distance after the other."""
    few = (size > 1) & (size <= (_SMALL if most is None else most))
    starts, size = starts[few], size[few]
    for lag in range(1, int(size.max()) if len(size) else 0):
        long = size > lag
        starts, size = starts[long], size[long]
        a = ragged(starts, size - lag)
        yield a, a + lag


def forest(of: Filters, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, first row) that connect what the pairs passing the filters within the runs connect."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in small_pairs(starts, size):
        good = of.fit(a, b)
        left.append(a[good]), right.append(b[good])
    for s, m in zip(starts[size > _SMALL].tolist(), size[size > _SMALL].tolist()):
        if m <= _SQUARE:
            a, b = of.square(s, m)
            left.append(a), right.append(b)
            continue
        rest, queue = np.arange(s, s + m), []
        while len(rest):  # rows that were reached are compared with those that were not
            if not queue:
                queue, rest = [rest[0]], rest[1:]
            row = queue.pop()
            good = of.fit(row, rest)
            left.append(np.full(int(good.sum()), row)), right.append(rest[good])
            queue.extend(rest[good])
            rest = rest[~good]
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(len(of.n))
    while True:
        least = np.minimum(root[a], root[b])
        if (root[a] == root[b]).all():
            break
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
    moved = np.unique(np.concatenate((a, b)))
    moved = moved[root[moved] != moved]
    return moved, root[moved]


def _links(key: np.ndarray, node: np.ndarray, of: Filters) -> pa.RecordBatch:
    """Links of a spanning forest of each key, from rows sorted by key and id."""
    starts, number = _runs([key]) if len(key) else (np.empty(0, np.int64),) * 2
    met = np.repeat(number > 1, number)
    of, node, number = Filters(*(x[met] for x in of)), node[met], number[number > 1]
    a, b = forest(of, np.cumsum(number) - number, number)
    return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])


def _forests(batches):
    """Rows (key, id, parity, size) sorted by key and id to links."""
    for t in _whole_runs(batches, 1):
        key, node, parity, size = (t.column(c).to_numpy() for c in range(4))
        yield _links(key, node, Filters(parity.view(np.uint64), size >> 32, size & 0xFFFFFFFF))


def _class_sizes(batches):
    """Rows (prefix) to (part, counts): how many words are in each class, 4096 classes a row."""
    n = np.zeros(_CLASSES, np.int64)
    for batch in batches:
        n += np.bincount(batch.column(0).flatten().to_numpy().view(np.uint32) & np.uint32(_CLASSES - 1), minlength=_CLASSES)
    parts = n.reshape(-1, _CLASS_ROW)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "counts"])


def _large_classes(limit: int):
    """Rows (part, counts) sorted by part to the classes of more than ``limit`` words."""
    def run(batches):
        for t in _whole_runs(batches, 1):
            first = t.column(0)[0].as_py() * _CLASS_ROW
            n = sum(np.frombuffer(x, np.int64) for x in t.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array((first + np.flatnonzero(n > limit)).astype(np.int32))], names=["class"])

    return run


def _packed(large: np.ndarray, blocks: int):
    """Rows (id, n, parity, prefix) to (block, rows): the indexed words that are in no large class, in blocks of neighbouring hashes.

    Equal bytes of all rows of a block stand together, where most of them compress.
    """
    def run(batches):
        for t in gathered(batches, _PACKED):
            node, n, parity = (t.column(c).to_numpy() for c in range(3))
            prefix = _flat(t.column(3))
            length = np.asarray(prefix.value_lengths()).astype(np.int64)
            key = prefix.flatten().to_numpy().view(np.uint32)
            some = np.flatnonzero(~large[key & np.uint32(_CLASSES - 1)])
            # By hash: a sort of whole numbers is several times faster than one of places.
            some = some[np.sort(key[some].astype(np.uint64) << np.uint64(32) | np.arange(len(some), dtype=np.uint64)).astype(np.uint32)]
            set_of = np.repeat(np.arange(len(node)), length)[some]
            left = n[set_of] - (some - (np.cumsum(length) - length)[set_of])
            key = key[some]
            planes = np.concatenate([np.ascontiguousarray(c.astype(kind).view(np.uint8).reshape(len(some), -1).T) for c, kind in zip(
                (key, node[set_of], parity[set_of].view(np.uint64), n[set_of], left), _ROW)])
            block, number = np.unique((key.astype(np.uint64) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32), return_counts=True)
            ends = np.cumsum(number).tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array(block), pa.array([planes[:, i:j].tobytes() for i, j in zip([0, *ends], ends)], pa.binary())], names=["block", "rows"])

    return run


def _packed_forests(batches):
    """Rows (block, rows) sorted by block to links."""
    for t in _whole_runs(batches, 1):
        width = sum(np.dtype(kind).itemsize for kind in _ROW)
        planes = np.concatenate([np.frombuffer(x, np.uint8).reshape(width, -1) for x in t.column(1).to_pylist()], axis=1)
        columns, at = [], 0
        for kind in _ROW:
            size = np.dtype(kind).itemsize
            columns.append(np.ascontiguousarray(planes[at:at + size].T).view(kind).ravel())
            at += size
        order = np.lexsort((columns[1], columns[0]))
        key, node, parity, n, left = (c[order] for c in columns)
        yield _links(key, node, Filters(parity, n.astype(np.int64), left.astype(np.int64)))


def clumps(sets: DataFrame, limit: int = _WORD_SETS) -> DataFrame:
    """Rows (node, ``roots``): ids of ``sets`` (id, n, parity, prefix) and the clumps that they are in. Sets without a row have no similar set.

    A clump is named by the first row of its trees. Similar sets share one; of the clumps that they share the first counts.
    Words travel in packed blocks but for those of classes with more than ``limit`` rows; a word that more than ``limit`` sets index is dealt in parts.
    """
    sets = sets.select("id", "n", "parity", "prefix")
    # How many words the set has above, how many from this one on below.
    rows = sets.select("id", "parity", "n", F.posexplode("prefix").alias("at", "word")).select(
        F.col("word").cast("long").alias("key"), "id", "parity",
        F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR((F.col("n") - F.col("at")).cast("long")).alias("size"))
    # Only words whose class is large are counted one by one.
    group = F.col("key").bitwiseAND(F.lit(_CLASSES - 1)).cast("int")
    sizes = sets.select("prefix").mapInArrow(tidy(_class_sizes), "part int, counts binary")
    large = written(sizes.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(_large_classes(limit)), "class int"), "large-classes")
    is_large = np.zeros(_CLASSES, bool)
    is_large[[r["class"] for r in large.collect()]] = True  # at most _CLASSES
    blocks = (sets.agg(F.sum(F.size("prefix"))).first()[0] or 0) // _BLOCK_ROWS + 1
    packed = sets.mapInArrow(tidy(_packed(is_large, blocks)), "block int, rows binary")
    links = packed.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(_packed_forests), "a long, b long")
    if is_large.any():
        some = rows.withColumn("class", group).join(sent_if_small(large, 16), "class", "left_semi").drop("class")
        hot = some.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > limit)
        hot = written(hot.select("key", F.ceil(F.col("m") / limit).cast("int").alias("parts")), "hot-words")
        marked = some.join(sent_if_small(hot, 24), "key", "left")
        part = F.pmod(F.xxhash64("id"), "parts").cast("int")
        other = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        dealt = marked.select("*", part.alias("part"), F.explode(other).alias("other"))
        loose = dealt.select(F.when(F.col("parts").isNull(), F.col("key")).otherwise(
            F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))).alias("key"), "id", "parity", "size")
        links = links.union(loose.repartition("key").sortWithinPartitions("key", "id").mapInArrow(tidy(_forests), "a long, b long"))
    trees = links.groupBy("a").agg(F.collect_set("b").alias("firsts")).select(F.col("a").alias("node"), F.explode("firsts").alias("first"))
    trees = written(trees, "trees")
    own = trees.select("first").distinct().select(F.col("first").alias("node"), "first")
    return written(trees.union(own).groupBy("node").agg(F.sort_array(F.collect_set("first")).alias("roots")), "clumps")


def _same_words(a: np.ndarray, b: np.ndarray, starts: np.ndarray, length: np.ndarray, word: np.ndarray) -> np.ndarray:
    """How many words (whole numbers under 2^32) the sets ``a`` and ``b`` share."""
    shared = np.zeros(len(a), np.int64)
    at, size = 0, np.cumsum(length[a] + length[b])
    while at < len(a):  # some pairs at a time
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _VERIFIED, side="right")))
        one, two = a[at:stop], b[at:stop]
        pair = np.concatenate((np.repeat(np.arange(stop - at), length[one]), np.repeat(np.arange(stop - at), length[two])))
        words_of = word[np.concatenate((ragged(starts[one], length[one]), ragged(starts[two], length[two])))]
        # A word that both sets have stands twice.
        key = np.sort(pair << 32 | words_of)
        shared[at:stop] = np.bincount(key[1:][key[1:] == key[:-1]] >> 32, minlength=stop - at)
        at = stop
    return shared


def shared_words(owner: np.ndarray, word: np.ndarray, m: int) -> np.ndarray:
    """Words that each two of ``m`` sets share, as a square, from the rows (set, word) of all sets."""
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    out = np.zeros((m, m), np.float32)
    if not len(word):
        return out
    starts, size = _runs([word])
    for a, b in small_pairs(starts, size):
        np.add.at(out, (owner[a], owner[b]), 1)
    out += out.T
    often = np.flatnonzero(size > _SMALL)
    for at in range(0, len(often), _COLUMNS):
        some = often[at:at + _COLUMNS]
        has = np.zeros((m, len(some)), np.float32)
        has[owner[ragged(starts[some], size[some])], np.repeat(np.arange(len(some)), size[some])] = 1
        out += has @ has.T
    return out


def small_square(starts: np.ndarray, length: np.ndarray, word: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``shared_words`` for few sets given by their lists of ``word``; ``place`` has a cell for each word."""
    m = len(length)
    owner, word = np.repeat(np.arange(m), length), word[ragged(starts, length)]
    at = np.arange(len(word))
    place[word] = at  # one place of each word
    one = place[word]
    column = np.cumsum(one == at)[one] - 1
    often = np.bincount(column)[column] > 1  # the others are shared by nobody
    owner, column = owner[often], column[often]
    out = np.zeros((m, m), np.float32)
    if not len(column):
        return out
    used = np.cumsum(np.bincount(column) > 0)
    column, width = used[column] - 1, int(used[-1])
    for first in range(0, width, _DENSE // m):
        some = (column >= first) & (column < first + _DENSE // m)
        has = np.zeros((m, min(width - first, _DENSE // m)), np.float32)
        has[owner[some], column[some] - first] = 1
        out += has @ has.T
    return out


def _compare(batches):
    """Rows (root, low, high, part, doc_id, text_key, line_no, id, often, rare, earlier) sorted by clump, parts and id to (id, links, first linked line)."""
    for t in _whole_runs(batches, 3):
        # Equal rows of the table give a line more than once.
        once, _ = _runs([t.column(c).to_numpy() for c in ("root", "low", "high", "id")])
        t = t.take(pa.array(once)).combine_chunks() if len(once) < t.num_rows else t
        root, low, high, part = (t.column(c).to_numpy() for c in range(4))
        begin, length, word = _words_of(t)
        # Clumps that come before this one: a pair that shares one of them is counted there.
        before, number, earlier = _lists(t.column("earlier"))
        earlier = np.unique(earlier, return_inverse=True)[1]
        parity = np.bitwise_xor.reduceat(np.uint64(1) << (mixed(word.view(np.uint64)) >> np.uint64(58)), begin)
        of = Filters(parity, length, length)
        doc = t.column("doc_id")
        key = (t.column("line_no").to_numpy(), t.column("text_key").to_numpy(), pc.fill_null(doc, 0).to_numpy(), pc.is_valid(doc).to_numpy(zero_copy_only=False))
        order = np.lexsort(key)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        links, least = np.zeros(len(root), np.int64), np.full(len(root), len(root), np.int64)
        starts, size = _runs([root, low, high])
        place, place_earlier = (np.empty(int(x.max()) + 1 if len(x) else 0, np.int64) for x in (word, earlier))
        for a, b in small_pairs(starts, size, min(_LISTED, _SMALL)):
            met = of.fit(a, b) & ((low[a] == high[a]) | (part[a] != part[b]))
            a, b = a[met], b[met]
            good = _same_words(a, b, begin, length, word) * (NUMERATOR + DENOMINATOR) >= (length[a] + length[b]) * NUMERATOR
            a, b = a[good], b[good]
            new = _same_words(a, b, before, number, earlier) == 0
            a, b = a[new], b[new]
            for x, y in ((a, b), (b, a)):
                np.add.at(links, x, 1)
                np.minimum.at(least, x, rank[y])
        more = size > min(_LISTED, _SMALL)
        for s, m in zip(starts[more].tolist(), size[more].tolist()):
            n, own = length[s:s + m], part[s:s + m]
            e = number[s:s + m]
            if m <= _SMALL:
                shared = small_square(begin[s:s + m], n, word, place)
            else:
                shared = shared_words(np.repeat(np.arange(m), n), word[begin[s]:begin[s] + n.sum()], m)
            good = shared * (NUMERATOR + DENOMINATOR) >= (n[:, None] + n) * NUMERATOR
            if e.any():
                if m <= _SMALL:
                    same = small_square(before[s:s + m], e, earlier, place_earlier)
                else:
                    same = shared_words(np.repeat(np.arange(m), e), earlier[before[s]:before[s] + e.sum()], m)
                good &= same == 0
            if low[s] == high[s]:
                np.fill_diagonal(good, False)
            else:
                good &= own[:, None] != own
            links[s:s + m] = good.sum(1)
            least[s:s + m] = np.where(good, rank[s:s + m], len(root)).min(1)
        some = np.flatnonzero(links)
        linked = pa.array(order[least[some]])
        yield pa.RecordBatch.from_arrays(
            [t.column("id").combine_chunks().take(pa.array(some)), pa.array(links[some]),
             *(_flat(t.column(c).take(linked)) for c in ("doc_id", "text_key", "line_no"))],
            names=["id", "n_links", "doc_id", "text_key", "line_no"])


def _words_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each set begins, its length, and the words of all as numbers: places of frequent words, and numbers above for others."""
    code, owner = of_gaps(_flat(t.column("often")))
    _, number, rare = _lists(t.column("rare"))
    key = np.sort(np.concatenate((owner << 32 | code, np.repeat(np.arange(len(number)), number) << 32 | (
        MOST_WORDS + np.unique(rare, return_inverse=True)[1]))))
    length = np.bincount(key >> 32, minlength=t.num_rows)
    return np.cumsum(length) - length, length, key & 0xFFFFFFFF


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each list begins, its length, and the values of all."""
    lists = _flat(column)
    length = np.asarray(lists.value_lengths()).astype(np.int64)
    return np.cumsum(length) - length, length, lists.flatten().to_numpy().view(np.uint64)


def _flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def verified(token: DataFrame) -> DataFrame:
    """Rows (id, n_links, linked) for sets with similar ones, from ``token``: one row of a set, as ``_asked_lines`` gives them."""
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    clump = token.select("*", F.inline("roots"))
    dealt = clump.select("*", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part",
        "doc_id", "text_key", "line_no", "id", "often", "rare", "earlier")
    runs = dealt.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "id")
    found = runs.mapInArrow(tidy(_compare), "id long, n_links long, doc_id long, text_key long, line_no int")
    return found.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min(_key()).alias("linked"))


def _text_key(text: Column) -> Column:
    """With the doc_id, the name of a text."""
    return F.xxhash64(text.cast("string"))


def _key() -> Column:
    return F.struct("doc_id", "text_key", "line_no")


def similar_lines(docs: DataFrame) -> DataFrame:
    """One row for each line with a word of ``docs`` (doc_id, text; nothing else is read): doc_id, ``line_no`` (from 0),
    ``class_doc_id`` and ``class_line_no`` (the first line with an equal or similar set), ``n_links`` (different sets similar to its own) and
    ``removed`` (an earlier line has an equal or similar set).

    Lines end at ``\\n``. Lines without words, and null or empty texts, give no row and are never removed. Null doc_ids come before
    all others; of equal ids the text with the smaller hash comes first. Rows with equal id and text are one text, whose lines are
    reported for each row. An empty table gives no rows.
    """
    return _decided(docs).drop("text_key")


def _decided(docs: DataFrame) -> DataFrame:
    """``similar_lines`` with ``text_key``."""
    share_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_key(F.col("text")).alias("text_key"))
    frequent = frequent_words(texts)
    lines = written(texts.mapInArrow(tidy(_line_rows(frequent)), _LINE_DDL), "lines")
    # A line that is everywhere leads once in a slice. An aggregate of structs and lists would sort all rows before the shuffle, too.
    order = ["k1", "k2", "doc_id", "text_key", "line_no"]
    leads = lines.filter("lead").select(*order, "n", "parity", "prefix").repartition("k1", "k2").sortWithinPartitions(*order)
    sets = written(leads.mapInArrow(tidy(_first_rows), _LEAD_DDL).select(
        "k1", "k2", _key().alias("first"), "n", "parity", "prefix", F.monotonically_increasing_id().alias("id")), "sets")
    nodes = clumps(sets.filter(f"n >= {NUMERATOR}"))
    members = sets.filter(f"n >= {NUMERATOR}").select("id", "n", "first").join(nodes.withColumnRenamed("node", "id"), "id")
    sizes = members.select("n", F.explode("roots").alias("root")).groupBy("root").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / _CLUMP, F.sum("n") / _CLUMP_WORDS)).cast("int").alias("parts")).filter("parts > 1")
    sizes = written(sizes, "large-clumps")
    dealt = members.select("id", "first", "roots", F.explode("roots").alias("root")).join(sent_if_small(sizes, 24), "root", "left")
    earlier = F.filter("roots", lambda x: x < F.col("root"))
    asked = written(dealt.groupBy("id", "first").agg(F.collect_list(F.struct(
        "root", F.coalesce("parts", F.lit(1)).alias("parts"), earlier.alias("earlier"))).alias("roots")).groupBy("first.doc_id", "first.text_key").agg(
            F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "id", "roots")).alias("lines")), "asked-lines")
    few = sent_if_small(asked, 32 + 56 * F.size("lines"))
    same = texts.doc_id.eqNullSafe(few.doc_id) & (texts.text_key == few.text_key)
    found = texts.join(few, same).select(texts.doc_id, texts.text_key, "text", "lines")
    token = found.mapInArrow(tidy(_asked_lines(frequent)), _TOKEN_DDL)
    links = written(verified(token), "line-links")
    classes = sets.select("k1", "k2", "id", "first").join(links, "id", "left").drop("id")
    out = lines.select("doc_id", "text_key", "line_no", "k1", "k2").join(classes, ["k1", "k2"])
    top = F.when(F.col("linked") < F.col("first"), F.col("linked")).otherwise(F.col("first"))
    return out.select(
        "doc_id", "text_key", "line_no", top.getField("doc_id").alias("class_doc_id"), top.getField("line_no").alias("class_line_no"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), (top < _key()).alias("removed"))


def remove_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``, all columns kept. Documents that lose every line with a word go.

    Documents that lose nothing keep their text as it is, also a null one.
    """
    found = written(_decided(docs), "line-decisions")
    loss = unused("loss", docs)
    gone = written(found.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.when(F.col("removed"), F.col("line_no"))).alias("gone"), F.count(F.when(~F.col("removed"), 1)).alias("left")
    ).filter(F.size("gone") > 0).select(F.struct("*").alias(loss)), "removed-lines")
    # eqNullSafe is an equi-join; documents without losses have no partner.
    lost = F.col(loss)
    few = sent_if_small(gone, 40 + 4 * F.size(lost["gone"]))
    same = docs["doc_id"].eqNullSafe(lost["doc_id"]) & (_text_key(docs["text"]) == lost["text_key"])
    both = docs.join(few, same, "left").filter(lost.isNull() | (lost["left"] > 0))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(lost["gone"], i))
    text = F.when(lost.isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    return both.withColumn("text", text).select(docs.columns)
