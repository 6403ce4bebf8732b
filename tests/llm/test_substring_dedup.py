"""Repeated passages against a plain search for equal windows, and the query against its SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from check_oracles import compare, connect
from conftest import SMALL

from whisperlake.llm import substring_dedup
from whisperlake.session import work_dir


def plain(rows, size):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + size]) for w in texts for i in range(len(w) - size + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def passages(rng, size):
    """Texts with passages that they share, at places of all kinds."""
    letters = [f"w{i}" for i in range(30)]
    shared = [[rng.choice(letters) for _ in range(rng.randrange(size - 2, 3 * size))] for _ in range(6)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randrange(6)):
            piece = list(rng.choice(shared)) if rng.random() < 0.4 else [rng.choice(letters) for _ in range(rng.randrange(2 * size))]
            if piece and rng.random() < 0.3:
                piece[rng.randrange(len(piece)):] = [rng.choice(letters)]
            w += piece
        rows.append((i, " ".join(w)))
    few = ["a", "b"]
    rows += [(200 + i, " ".join(rng.choice(few) for _ in range(rng.randrange(60)))) for i in range(30)]
    rows += [(300, "a " * 50), (301, "b " * (size + 1)), (302, "c " * size), (303, "d " * (size - 1)), (None, None), (None, ""), (304, " \t\n\x0b"),
             (305, "A b\tc  d\n" * size), (306, "e" * 70_000 + " f g"), (307, "Ü ﬁ 𝒳 " * size), (7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]),
             (308, " ".join(rng.choice(letters) for _ in range(9000)) + " " + " ".join(shared[0]))]
    return rows + [(400 + i, " ".join(shared[1] + shared[2])) for i in range(40)]


def frame(spark, rows):
    path = work_dir(spark, "passages")
    spark.createDataFrame([(i, t, b"x", 5, [1], "y") for i, t in rows], "doc_id long, text string, name binary, row long, spans array<int>, label string").repartition(
        4).write.parquet(path)
    return spark.read.parquet(path)


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("size,prefix,leaves", [(6, 3, 20_000), (6, 2, 3), (35, 8, 20_000), (35, 8, 2), (9, 8, 5)])
def test_rows_equal_plain_ones(spark, size, prefix, leaves):
    rows = passages(random.Random(size * 100 + prefix), size)
    got = substring_dedup.repeated_passages(frame(spark, rows), size, prefix, leaves).collect()
    want = plain(rows, size)
    assert order((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == order(want)
    assert 40 < sum(r[2] > 0 for r in want) < len(want) - 20
    for r in got:
        assert len(r.spans) % 2 == 0 and sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed


def test_nodes_hold_the_leaves_with_a_common_prefix():
    rng = np.random.default_rng(2)
    symbols, length, group = rng.integers(0, 2, (300, 7)), rng.integers(0, 8, 300), rng.integers(0, 3, 300)
    order, common = substring_dedup.sorted_tree(group, symbols, length)
    for depth in range(1, 8):
        node = substring_dedup.nodes_of_depth(order, common, depth)
        deep = np.flatnonzero(length >= depth)
        for i in deep[:40]:
            for j in deep:
                assert (node[i] == node[j]) == (i == j or (group[i] == group[j] and (symbols[i, :depth] == symbols[j, :depth]).all()))


def test_nothing_and_wrong_sizes(spark):
    assert substring_dedup.repeated_passages(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.repeated_passages(frame(spark, []), size=8, prefix=8)


def test_query_equals_sql(spark):
    ok, note = compare(spark, connect(SMALL), SMALL, "op11_substring_dedup")
    assert ok, note
