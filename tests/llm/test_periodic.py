"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from whisperlake.llm import arrays, periodic
from whisperlake.llm.queries import QUERIES
from whisperlake.session import work_dir


def plain_runs(w):
    found = {}
    n = len(w)
    for q in range(1, n // periodic.TIMES + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(periodic.SHORTEST, periodic.TIMES * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j
    return sorted((s, m, q) for (s, m), q in found.items())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_row(doc_id, text):
    w = words_of(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())


def some_texts(rng, n):
    for _ in range(n):
        kind, alphabet = rng.randrange(4), rng.choice(["ab", "abc", "abcdefgh"])
        piece = [rng.choice(alphabet) for _ in range(rng.randrange(1, 14))]
        if kind == 0:
            yield [rng.choice(alphabet) for _ in range(rng.randrange(80))]
        elif kind == 1:  # a run between other words
            yield ["x", *piece * rng.randrange(2, 9), *piece[:rng.randrange(len(piece))], *(rng.choice(alphabet) for _ in range(9))]
        elif kind == 2:  # runs within the period of a run
            inner = ["a"] * rng.randrange(1, 20) + piece
            yield inner * rng.randrange(3, 7) + inner[:rng.randrange(len(inner))]
        else:
            a, b = ["a"], ["a", "b"]
            for _ in range(rng.randrange(9)):
                a, b = b, b + a
            yield b


def test_runs_equal_a_plain_search():
    rng = random.Random(3)
    texts = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 200, *some_texts(rng, 1500)]
    w = arrays.words(arrays.texts_of(pa.array([" ".join(t) for t in texts])))
    found = periodic.runs(w.codes, w.starts)
    got = [[] for _ in texts]
    for t, s, e, q in zip(*(x.tolist() for x in found)):
        got[t].append((s - int(w.starts[t]), e - s, q))
    assert got == [plain_runs(t) for t in texts]
    assert sum(map(len, got)) > 500


def test_wavelet_tree_counts_and_selects():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 700)
    tree = periodic.WaveletTree(values, 6)
    low = rng.integers(0, 699, 400)
    high = low + 1 + rng.integers(0, 700 - low)
    value = rng.integers(0, 70, 400)
    assert tree.below(low, high, value).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(low, high, value)]
    k = rng.integers(0, high - low)
    assert tree.kth(low, high, k).tolist() == [int(np.sort(values[a:b])[c]) for a, b, c in zip(low, high, k)]


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    long = " ".join(rng.choice("abcdefghij") for _ in range(3000)) + " na" * 3000
    texts = [" ".join(t) for t in some_texts(rng, 300)]
    return [*enumerate(texts), (None, "a " * 40), (None, None), (7, texts[7]), (7, "a " * 30), (900, ""), (901, None), (902, long),
            (903, " \t\n\x0b "), (904, "x" * 60_000), (905, "Ü ü " * 9)]


def test_rows_equal_plain_ones(spark, rows):
    path = work_dir(spark, "periodic")
    spark.createDataFrame([(i, t, 5, "x", [1]) for i, t in rows], "doc_id long, text string, start long, runs string, seed array<int>").repartition(
        3).write.parquet(path)
    docs = spark.read.parquet(path)
    found = periodic.periodic_runs(docs, plant=True).withColumns({c: F.sha2(c, 256) for c in ("runs", "collapsed")})
    got = [tuple(r[c] for c in COLUMNS) for r in found.collect()]
    assert order(got) == order(plain_row(i, t) for i, t in rows)
    shown = {(r.doc_id, r.n_runs): r for r in periodic.periodic_runs(docs.filter("doc_id = 900 or doc_id = 905")).collect()}
    assert shown[900, 0].runs == "" and shown[900, 0].collapsed == "" and shown[905, 1].runs == "0,9,1\n" and shown[905, 1].collapsed == "Ü ü"
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_query_covers_the_whole_table(spark, tmp_path):
    rng = random.Random(2)
    texts = [(i, " ".join(t)) for i, t in enumerate(some_texts(rng, 200))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert order(map(tuple, out.collect())) == order(plain_row(*t) for t in texts)
    assert out.filter(F.col("n_runs") > 0).count() > 50
