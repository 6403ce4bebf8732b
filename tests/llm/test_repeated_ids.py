"""Null and repeated ids: each text keeps its own lines."""

from whisperlake.llm import line_dedup, simhash

LINES = [" ".join(f"{c}{k}" for k in range(10)) for c in "abcdefgh"]


def near(line):
    return line + " more"


def test_lines_of_null_and_repeated_ids(spark):
    a, b, c, d, e, f, g, h = LINES
    rows = [(1, "\n".join([a, b])), (None, "\n".join([c, d, near(c)])), (None, e), (5, "\n".join([f, near(a)])), (5, "\n".join([g, h, near(b)])), (6, near(e))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.remove_lines(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, "\n".join([a, b])), (None, "\n".join([c, d])), (None, e), (5, f), (5, "\n".join([g, h]))], key=str)
    assert line_dedup.similar_lines(docs).columns == ["doc_id", "line_no", "class_doc_id", "class_line_no", "n_links", "removed"]


def test_simhash_keeps_different_texts_of_one_id(spark):
    a, b, c = LINES[:3]
    rows = [(7, a), (7, b), (7, b), (8, a), (3, c), (7, c), (None, a)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(7, a), (7, b), (3, c), (None, a)], key=str)
