"""Columns whose names operators might use themselves, and samples drawn by hashes."""

import random

from pyspark.sql import functions as F

from whisperlake.llm import decontaminate, line_dedup, quality_rules, simhash, similar_texts, store

NAMES = ["__id", "__node", "__gone", "__left", "__key", "__verdict", "loss", "LOSS_", "other", "verdict", "node", "gone", "line_no", "k1", "key", "name", "l", "removed"]


def crowded(spark):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(12))
    same = line()
    rows = [(i, f"{line()}\n{same}\n{line()}", "en") for i in range(20)] + [(30, None, None), (None, "", "en"), (31, same, "en"), (31, same, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES)))


def test_columns_pass_through_whatever_they_are_called(spark):
    docs = crowded(spark)
    values = [(i, n) for i, n in enumerate(NAMES)]
    benchmark = spark.createDataFrame([(1, "nothing like any of these texts at all")], "item_id long, text string")
    for out, n in ((line_dedup.remove_lines(docs), 22), (similar_texts.keep_one(docs), None), (simhash.keep_one(docs), None), (quality_rules.apply_rules(docs), None),
                   (decontaminate.drop_leaking(docs, benchmark), 24)):
        rows = out.collect()
        assert out.columns == docs.columns
        assert all(r[n] == i for r in rows for i, n in values)
        assert n is None or len(rows) == n
    assert store.unused("loss", docs) == "loss__" and store.unused("x", docs) == "x"


def test_samples_are_those_of_a_whole_sort(spark):
    rows = spark.range(30_000).select((F.col("id") % 20_000).alias("doc_id"), "id")
    whole = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "id").limit(3000)
    assert sorted(store.drawn(rows, 3000, "doc_id", "id").collect()) == sorted(whole.collect())
    assert store.drawn(rows, 5, "doc_id").count() == 5 and store.drawn(rows, 40_000, "doc_id").count() == 30_000
    assert store.drawn(rows.limit(0), 5, "doc_id").count() == 0


def test_benchmark_blocks_give_what_one_block_gives(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(12)]
    docs = [(i, " ".join(word() for _ in range(30)) + " " + items[i % 12][1]) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items * 3, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.leaked_items(d, b).collect()))
    assert one == sorted(map(tuple, decontaminate.leaked_items(d, b, block_chars=300).collect())) and len(one) == 40
    assert decontaminate.drop_leaking(d.limit(3), b, block_chars=300).count() == 0
