"""What the pipeline's stages store and send to Python: texts once, names only where keys are shared."""

import re

import pyarrow as pa
import pytest
from conftest import SMALL

from whisperlake.llm import doc_stats, quality_rules, similar_texts
from whisperlake.llm.arrays import strings, words


@pytest.fixture
def stored(monkeypatch):
    """The plans and rows of the tables that a module stores, by label."""
    seen = {}

    def watch(module):
        write = module.written

        def written(df, label):
            out = write(df, label)
            seen[label] = plan(df), out
            return out

        monkeypatch.setattr(module, "written", written)
        return seen

    return watch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sent(text):
    """What the functions of each ArrowEvalPython of a plan are called with."""
    return [re.findall(r"\w+\(([^()]*(?:\([^()]*\))?[^()]*)\)#", x) for x in re.findall(r"ArrowEvalPython \[(.*?)\], \[", text)]


def test_rules_send_each_text_to_python_once(spark, stored):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "word " * 60, None)], "doc_id long, text string, lang string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    want = docs.select("*", quality_rules.verdict(docs).alias("v")).filter("v.kept").drop("v")
    seen = stored(quality_rules)
    out = quality_rules.apply_rules(docs)
    assert [x for x in sent(seen["base-rules"][0]) if any("text" in y for y in x)] == sent(seen["base-rules"][0]) and len(sent(seen["base-rules"][0])) == 1
    assert sent(plan(out)) and not any("text" in y for x in sent(plan(out)) for y in x)
    assert out.count() == want.count() > 0 and out.exceptAll(want).isEmpty()


def test_common_words_as_python_lowers_them():
    texts = ["The. (the) ,OF! İn İt itİ In.. KK FÜR für là MÁS más!? ẞ", "", "not  at"]
    w = words(pa.array(texts, pa.large_string()))
    got = doc_stats.common_counts(w).tolist()
    for text, row in zip(texts, got):
        plain = [x.strip(".,;:!?").lower() for x in re.split("[\x20\x09-\x0d]+", text)]
        assert row == [plain.count(x) for x in doc_stats.ALL_COMMON]


def test_strings_as_to_pylist():
    column = pa.array(["a", None, "", "é\x00b"], pa.large_string())
    assert strings(column) == column.to_pylist() and strings(column.slice(1, 2)) == [None, ""] and strings(column.slice(0, 0)) == []


def test_text_goes_to_python_once_for_fingerprint_and_bands(spark, stored):
    docs = spark.createDataFrame([(k, f"text number {k} of some words") for k in range(5)] + [(9, None)], "doc_id long, text string")
    seen = stored(similar_texts)
    assert similar_texts.keep_one(docs).count() == 6
    (both,) = sent(seen["bands"][0])
    assert len(both) == 2 and len(set(both)) == 1


def test_names_travel_for_shared_keys_only(spark, stored):
    rows = [(k, " ".join(f"w{k}_{i}" for i in range(40))) for k in range(50)]
    twin = rows[0][1].replace("w0_39", "changed")
    docs = spark.createDataFrame([*rows, (60, twin)], "doc_id long, text string")
    seen = stored(similar_texts)
    assert sorted(r.doc_id for r in similar_texts.keep_one(docs).collect()) == list(range(50))
    several = seen["several"][1]
    assert several.count() == 2 * several.select("band").distinct().count() > 0
    assert several.select("node").distinct().count() == 2
