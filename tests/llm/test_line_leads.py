"""The first line of each set: marked in a slice, chosen of the marked ones."""

import gc
import weakref

import numpy as np
import pyarrow as pa
import pytest

from whisperlake.llm import arrays, line_dedup, store


def _rows(docs):
    none = line_dedup.Frequent(np.empty(0, np.uint64), np.empty(0, np.int64))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([d for d, _, _ in docs], pa.int64()), pa.array([t for _, t, _ in docs]), pa.array([k for _, _, k in docs], pa.int64())],
        names=["doc_id", "text", "text_key"])
    return pa.Table.from_batches(line_dedup._line_rows(none)(iter([batch]))).to_pylist()


def test_one_line_of_a_set_leads():
    rows = _rows([(7, "a b c d\n\nx\nd c b a", 1), (3, "q\nA b c d", 9), (3, "a b c d d", 2), (None, "x\nx", 5), (1, None, 0)])
    lead = {(r["doc_id"], r["text_key"], r["line_no"]) for r in rows if r["lead"]}
    assert lead == {(3, 2, 0), (3, 9, 0), (None, 5, 0)}
    assert len(rows) == 8 and all(bool(r["prefix"]) == (r["lead"] and r["n"] >= 4) for r in rows)


def test_first_of_each_run_over_batches():
    rows = [(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (2, 2, "d"), (2, 2, "e"), (2, 2, "f"), (3, 0, "g")]
    t = pa.table([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["k1", "k2", "x"])
    for size in (1, 2, 3, 10):
        batches = [t.to_batches()[0].slice(0, 0), *t.to_batches(max_chunksize=size)]
        assert [x for b in line_dedup._first_rows(iter(batches)) for x in b.column(2).to_pylist()] == ["a", "c", "d", "g"]


def _sets_plan(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(line_dedup, "written", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().toString()) and store.written(df, label))
    out = line_dedup.similar_lines(spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e\nf")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.line_no, r.class_doc_id, r.removed) for r in out) == [(1, 0, 1, False), (2, 0, 1, True), (2, 1, 2, False)]
    return plans["sets"]


def test_sets_are_sorted_once(spark, monkeypatch):
    """An aggregate that sorts would do so before the shuffle as well as after it."""
    assert "SortAggregate" not in _sets_plan(spark, monkeypatch)


@pytest.mark.parametrize("words", [["a"], ["", "a", "x" * 64, "x" * 65, "y" * 63, "ab" * 200, "é" * 70, "q" * 129, "q" * 128, "a"]])
def test_hashes_add_one_number_for_each_byte(words):
    def plain(w):
        total = 0
        for i, byte in enumerate(w.encode()):
            far = int(arrays.mixed(np.array([i >> 6], np.uint64))[0]) | 1 if i > 63 else 1
            total += int(arrays._TABLE[(i & 63) << 8 | byte]) * far
        total += (len(w.encode()) + 1) * int(arrays._M2)
        return int(arrays.mixed(np.array([total % (1 << 64)], np.uint64))[0])

    assert arrays.hashes(pa.array(["before", *words]).slice(1)).tolist() == [plain(w) for w in words]


def test_modules_are_set_aside_and_garbage_is_not():
    class Node:
        pass

    store.give_back()
    assert gc.get_freeze_count() > len(gc.get_objects())
    node = Node()
    node.me, seen = node, weakref.ref(node)
    del node
    store.give_back()
    assert seen() is None
