"""The pipeline's stages on planted cases, the registered queries, and the SQL of those that have one."""

import random

import numpy as np
import pytest
from check_oracles import compare, connect
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from whisperlake.llm import tokens
from whisperlake.llm.queries import QUERIES
from whisperlake.llm.store import written
from whisperlake.session import work_dir


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(QUERIES) <= set(names)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in entry.oracle_sql()])
def test_same_rows_as_sql(spark, name):
    ok, note = compare(spark, connect(SMALL), SMALL, name)
    assert ok, note


def test_stages(spark):
    rng = random.Random(9)
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    clean = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("lang = 'en'").collect()]
    whole = max(clean, key=lambda r: len(r.text) if len(set(r.text.split())) > 200 and "$" not in r.text and "|" not in r.text else 0)
    near = whole.text.split(" ")
    near[len(near) // 2] = "changed"
    extra = [
        (10_000, whole.text, "en"), (10_001, " ".join(near), "en"), (10_002, "short", "en"), (10_003, None, None), (10_004, "", "en"),
        (10_005, " ".join(rng.sample(whole.text.split(), 120)) + " " + items[0].text, "en"),
    ]
    path = work_dir(spark, "planted")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string").withColumn("source", F.lit("x")).withColumn("n_chars", F.length("text").cast("long"))
    docs.unionByName(more).write.parquet(path)
    docs = spark.read.parquet(path)
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality_rules":
            assert not ids & {10_002, 10_003, 10_004} and {10_000, 10_001, 10_005} <= ids
        if name == "line_dedup":
            assert whole.doc_id in ids and 10_000 not in ids
            assert docs.filter("n_chars != length(text)").count() == 0
    assert 10_005 not in ids
    rows = docs.collect()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    e = tokens.Encoder("word_bpe_49k.json")
    want = {r.doc_id: x + [2] for r, x in zip(rows, e.plain([r.text or "" for r in rows]))}
    got = {i: [0] * len(x) for i, x in want.items()}
    for p in pieces:
        got[p.doc_id][p.start:p.start + p.length] = np.frombuffer(bytes(p.ids), "<u4").tolist()
    assert got == want
