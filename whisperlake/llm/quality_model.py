"""A quality classifier: boosted trees over statistics of whole documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.arrays import slices, texts_of
from whisperlake.llm.boosted import Trees, fit
from whisperlake.llm.doc_stats import ALL_COMMON, CLASSES, COMMON, SLICE, statistics
from whisperlake.llm.store import drawn, share_package, written

FEATURES = [*(f"{c}_share" for c in CLASSES), "log_words", "word_length", "words_per_line", "dup_line_share", "repeat_share",
            "distinct_share", "common_share", "top_common_share"]
_LISTS = [[ALL_COMMON.index(w) for w in ws] for ws in COMMON.values()]


def features(texts: pa.Array) -> np.ndarray:
    """One row for each text (no nulls): see FEATURES. Shares of nothing are 0."""
    s = statistics(texts)
    n = np.maximum(s["n_words"], 1)
    common = np.stack([s["common"][:, i].sum(axis=1) for i in _LISTS], axis=1)
    return np.concatenate((
        s["classes"] / np.maximum(s["classes"].sum(axis=1, keepdims=True), 1),
        np.stack((np.log1p(s["n_words"]), s["word_chars"] / n, n / np.maximum(s["n_lines"], 1),
                  s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / n, s["n_distinct"] / n,
                  common.max(axis=1) / n, s["common"].max(axis=1) / n), axis=1)), axis=1)


def _feature_rows(batches):
    for batch in batches:
        for at, part in slices(texts_of(batch.column(1)), SLICE):
            x = features(part).astype(np.float64)
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), values], names=["doc_id", "x"])


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are not learnt; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_sample(rows: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``rows`` (doc_id, ...) with labels, without the held-out ones: at most ``most``, drawn by a hash of the id.

    Repeated labels of one id count once (the largest).
    """
    known = labels.filter(F.col(label).isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col(label).cast("int")).alias("label"))
    return drawn(rows.join(known, "doc_id"), most, "doc_id")


def train(rows: DataFrame, labels: DataFrame, most: int = 20_000) -> Trees:
    """Fits the trees on a bounded sample of labelled feature rows (17 numbers each) on the driver."""
    got = training_sample(rows, labels, "quality", most).select("x", "label").collect()
    x = np.array([r.x for r in got], np.float64).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r.label for r in got], np.float64))


def score(docs: DataFrame, labels: DataFrame, most: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """doc_id, ``held_out``, ``score`` (1: good) and ``predicted`` for every row of ``docs`` (doc_id, text; nothing else is read).

    ``most`` bounds the labelled rows that the trees are fitted on; the features of all documents are written once and used for both. A
    null text counts as empty and is scored like any other; a null ``doc_id`` is scored and never learnt from; repeated rows are scored
    each. Without labels every score is 0.5.
    """
    share_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = written(texts.mapInArrow(_feature_rows, "doc_id long, x array<double>"), "features")
    model = train(rows, labels, most)

    def apply(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    out = rows.mapInArrow(apply, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
