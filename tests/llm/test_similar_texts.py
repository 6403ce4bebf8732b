"""The pipeline's near-duplicate stage on pairs of known similarity, and on null and repeated ids."""

import random

import corpus_pipeline


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}


def test_stage_reaches_similarity_four_fifths(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        copy = list(words)
        for k in rng.sample(range(300), 5 if i % 2 else 12):
            copy[k] = "changed"
        a, b = " ".join(words), " ".join(copy)
        x, y = shingle_set(a), shingle_set(b)
        rows += [(2 * i, a), (2 * i + 1, b)]
        want |= {2 * i} | (set() if len(x & y) / len(x | y) >= 0.8 else {2 * i + 1})
    assert 60 < len(want) < 120
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == want and got.columns == ["doc_id", "text"]


def test_null_and_repeated_ids_keep_different_texts(spark):
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[2]), (9, texts[4]), (None, texts[4]), (1, None), (2, "")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4]), (1, None)], key=str)


def test_empty_table(spark):
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_fingerprints_bring_candidates_that_are_verified(spark, monkeypatch):
    """Without any key of minima, equal and linked fingerprints still find near copies; a pair with few common shingles is not taken for one."""
    from pyspark.sql import functions as F
    from whisperlake.llm import similar_texts

    monkeypatch.setattr(similar_texts, "_bands", lambda text: F.array(F.xxhash64(text)))
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["end"])), (3, " ".join(reversed(words))), (4, "a b c d e"), (5, "a b c d")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == {1, 3, 4, 5}
