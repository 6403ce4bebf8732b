"""Large groups of similar lines are compared in place and in parts, and give the links of the full comparison."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from whisperlake.llm import line_dedup
from whisperlake.llm.store import written


def near_lines(seed: int, groups: int, size: int) -> list[str]:
    """Groups of lines that differ in a few words, chains of lines that drift, and lines on their own."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{k}" if k % 3 else f"c{k}" for k in range(rng.randint(5, 30))]
        for _ in range(size):
            line = list(base)
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = f"x{rng.randint(0, 40)}"
            out.append(" ".join(line))
    chain = [f"d{k}" for k in range(20)]
    for k in range(size):
        chain = [*chain[1:], f"e{k}"]
        out.append(" ".join(chain))
    out += [" ".join(f"c{rng.randint(0, 60)}" for _ in range(rng.randint(1, 12))) for _ in range(size)]
    rng.shuffle(out)
    return out


def brute(lines: list[str]) -> list[tuple[int, int, int, bool]]:
    sets = [frozenset(x.lower().split()) for x in lines]
    different = {s: sum(1 for t in set(sets) if t != s and 5 * len(s & t) >= 4 * len(s | t)) for s in set(sets)}
    out = []
    for i, s in enumerate(sets):
        first = next(k for k, t in enumerate(sets) if 5 * len(s & t) >= 4 * len(s | t))
        out.append((i, min(first, sets.index(s)), different[s], first < i))
    return out


@pytest.mark.parametrize("clump, word_sets", [(2048, 1 << 16), (10, 1 << 16), (7, 5)])
def test_groups_give_the_links_of_all_pairs(spark, monkeypatch, clump, word_sets):
    lines = near_lines(7, 4, 40)
    docs = written(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(5), "near")
    monkeypatch.setattr(line_dedup, "_CLUMP", clump)
    monkeypatch.setattr(line_dedup, "_CLUMP_WORDS", 40 * clump)
    monkeypatch.setattr(line_dedup.clumps, "__defaults__", (word_sets,))
    got = line_dedup.similar_lines(docs).collect()
    assert sorted((r.doc_id, r.class_doc_id, r.n_links, r.removed) for r in got) == brute(lines)


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    m = 1500
    n = rng.integers(5, 60, m)
    of = line_dedup.Filters(rng.integers(0, 4, m).astype(np.uint64) << rng.integers(0, 9, m).astype(np.uint64), n, n)
    starts, size = np.array([0, 1, 41, 341]), np.array([1, 40, 300, 1159])
    a, b = line_dedup.forest(of, starts, size)
    assert len(a) < m and len(set(a.tolist())) == len(a)
    want = np.arange(m)
    for s, k in zip(starts, size):
        i, j = np.triu_indices(k, 1)
        good = of.fit(s + i, s + j)
        i, j = s + i[good], s + j[good]
        while (want[i] != want[j]).any():
            least = np.minimum(want[i], want[j])
            np.minimum.at(want, i, least)
            np.minimum.at(want, j, least)
    got = np.arange(m)
    got[a] = b
    assert (got == want).all()


@pytest.mark.parametrize("small, columns", [(64, 1024), (1, 3), (5, 2)])
def test_shared_words_of_a_square(monkeypatch, small, columns):
    monkeypatch.setattr(line_dedup, "_SMALL", small)
    monkeypatch.setattr(line_dedup, "_COLUMNS", columns)
    rng = random.Random(5)
    sets = [set(rng.sample(range(30), rng.randint(1, 20))) for _ in range(90)]
    owner = np.repeat(np.arange(90), [len(s) for s in sets])
    word = np.array([w for s in sets for w in s], np.uint64)
    got = line_dedup.shared_words(owner, word, 90)
    assert all(got[i, j] == len(sets[i] & sets[j]) for i in range(90) for j in range(90) if i != j)


@pytest.mark.parametrize("m", [2, 9, 64])
def test_small_squares_count_shared_words(monkeypatch, m):
    monkeypatch.setattr(line_dedup, "_DENSE", 3 * m)
    rng = random.Random(m)
    sets = [set(rng.sample(range(50), rng.randint(0, 30))) for _ in range(m)]
    length = np.array([len(s) for s in sets])
    word = np.array([7, *(w for s in sets for w in s)], np.int64)
    got = line_dedup.small_square(1 + np.cumsum(length) - length, length, word, np.empty(50, np.int64))
    assert all(got[i, j] == len(sets[i] & sets[j]) for i in range(m) for j in range(m) if i != j)


def test_ranks_travel_as_gaps_and_come_back():
    lists = [[], [0], [5, 127, 128, 300], [131071], [], list(range(0, 131072, 129)), [0, 1 << 20], []]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    packed = line_dedup.gap_bytes(np.array([c for x in lists for c in x], np.int64), starts)
    for first, some in ((0, packed), (2, packed.slice(2)), (3, packed.slice(3, 1))):
        code, owner = line_dedup.of_gaps(some)
        assert [code[owner == i].tolist() for i in range(len(some))] == lists[first:first + len(some)]
    assert len(line_dedup.of_gaps(packed.slice(0, 1))[0]) == 0


def test_words_travel_in_few_bytes(spark):
    """Long lines that share their words: a frequent word is sent to its clumps in a byte or two, an indexed one in less than half a row."""
    rng = random.Random(11)
    lines = [" ".join(rng.sample([f"w{k}" for k in range(400)], 120)) for _ in range(300)]
    docs = written(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string"), "long")
    frequent = line_dedup.frequent_words(docs)
    rows = docs.selectExpr("array(struct(1L as root, 1 as parts, array(0L) as earlier)) as roots", "doc_id", "doc_id as text_key", "0 as line_no", "doc_id as id", "text")
    asked = rows.selectExpr("doc_id", "text_key", "text", "array(struct(line_no, id, roots)) as lines")
    got = asked.mapInArrow(line_dedup._asked_lines(frequent), line_dedup._TOKEN_DDL).selectExpr("length(often) as a", "size(rare) as b").collect()
    assert len(got) == 300 and all(r.a <= 160 and r.b == 0 for r in got)
    packed = [x for x in line_dedup._packed(np.zeros(line_dedup._CLASSES, bool), 3)(docs.selectExpr(
        "doc_id as id", "5 as n", "doc_id as parity", "array(cast(doc_id as int), 7) as prefix").toArrow().to_batches())]
    assert sum(len(r) for x in packed for r in x.column(1).to_pylist()) == 600 * 28 and sum(x.num_rows for x in packed) <= 3 * len(packed)


def test_a_large_group_keeps_all_links(spark):
    """Every line of a group of 600 near copies has 599 links."""
    base = [f"w{k}" for k in range(30)]
    lines = [" ".join([*base[:k], f"x{k}-{v}", *base[k + 1:]]) for k in range(30) for v in range(20)]
    docs = written(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string"), "copies")
    got = line_dedup.similar_lines(docs)
    assert got.agg(F.min("n_links"), F.max("n_links"), F.sum(F.col("removed").cast("int"))).first() == (599, 599, 599)


def test_equal_rows_are_one_text(spark):
    base = [f"w{k}" for k in range(12)]
    rows = [(1, " ".join(base)), (1, " ".join(base)), (2, " ".join([*base, "more"])), (2, " ".join([*base, "more"])), (None, " ".join([*base, "else"]))] * 3
    docs = written(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "equal")
    got = {(r.doc_id, r.class_doc_id, r.n_links, r.removed) for r in line_dedup.similar_lines(docs).collect()}
    assert got == {(None, None, 2, False), (1, None, 2, True), (2, None, 2, True)}
