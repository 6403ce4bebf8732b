"""A toxicity classifier that is indifferent to which group a text mentions.

Logistic regression over the words that a document has (without letter case and marks around them). For every labelled document with
identity terms, counterfactual copies exchange each term for the others of its kind; the squared change of the score that this
causes is a penalty of the fit. So a group's name can't earn weight from the company it keeps in the labels.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.arrays import Words, hashes, slices, texts_of, words
from whisperlake.llm.quality_model import held_out
from whisperlake.llm.store import drawn, share_package, written

# Identity terms by kind (fixed values); a term is exchanged for the others of its line.
IDENTITY = (
    "muslim christian jewish hindu buddhist sikh atheist catholic protestant", "muslims christians jews hindus buddhists sikhs atheists",
    "man woman", "men women", "boy girl", "male female", "gay lesbian straight bisexual heterosexual homosexual",
    "transgender cisgender", "black white asian african latino hispanic arab european", "immigrant native refugee citizen",
    "deaf blind disabled", "young old", "musulman chrétien juif", "homme femme", "noir blanc", "jude christ moslem", "mann frau",
    "schwarz weiß", "musulmán cristiano judío", "hombre mujer", "negro blanco",
)
_MARKS = '!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’–—…¿¡'


def plain_hashes(w: Words) -> np.ndarray:
    """For each distinct word the hash of its plain form, as a signed number."""
    return hashes(pa.array([v.strip(_MARKS).lower() for v in w.vocab.to_pylist()], pa.large_string())).view(np.int64)


def identity_groups() -> list[np.ndarray]:
    return [hashes(pa.array(line.split(), pa.large_string())).view(np.int64) for line in IDENTITY]


def _word_rows(batches):
    for batch in batches:
        for at, part in slices(texts_of(batch.column(1))):
            w = words(part)
            value = plain_hashes(w)[w.codes] if len(w.codes) else np.empty(0, np.int64)
            order = np.lexsort((value, w.owner))
            value, owner = value[order], w.owner[order]
            new = (np.diff(value, prepend=0) != 0) | (np.diff(owner, prepend=-1) != 0)
            if len(new):
                new[0] = True
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(part))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(ends), pa.array(value[new]))], names=["label", "words"])


class Model(NamedTuple):
    """Weights of words, by sorted hash."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        w = words(texts)
        logit = np.full(len(texts), self.bias)
        if len(self.words) and len(w.codes):
            value = plain_hashes(w)
            at = np.minimum(np.searchsorted(self.words, value), len(self.words) - 1)
            known = np.where(self.words[at] == value, at, -1)[w.codes]
            keep = known >= 0
            # Each word counts once in a document.
            pairs = np.unique(w.owner[keep] * np.int64(len(self.words)) + known[keep])
            logit += np.bincount(pairs // len(self.words), self.weights[pairs % len(self.words)], len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def counterfactuals(x: np.ndarray, columns: list[list[int]]) -> np.ndarray:
    """Changes of the rows of ``x`` (0 or 1 for each word) when the terms of each group are exchanged in turn."""
    out = [np.empty((0, x.shape[1]))]
    for group in columns:
        rows = x[(x[:, group] > 0).any(axis=1)] if group else x[:0]
        for shift in range(1, len(group)):
            change = np.zeros_like(rows)
            change[:, group] = np.roll(rows[:, group], shift, axis=1) - rows[:, group]
            out.append(change)
    return np.concatenate(out)


def fit(x: np.ndarray, y: np.ndarray, changes: np.ndarray, ridge: float = 0.05, fairness: float = 10.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Newton's method on the log-loss + ridge * |w|^2 / 2 + fairness * sum of (changes w)^2 / 2. The bias is free of penalties."""
    n, width = x.shape
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (n + 2)
        return np.zeros(width), float(np.log(share / (1 - share)))
    a = np.concatenate((x, np.ones((n, 1))), axis=1)
    penalty = np.zeros((width + 1, width + 1))
    penalty[:width, :width] = ridge * np.eye(width) + fairness * changes.T @ changes
    w = np.zeros(width + 1)

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + w @ penalty @ w / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(width + 1), a.T @ (p - y) + penalty @ w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-6 * max(1.0, abs(now)):
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, most: int = 16_000, width: int = 400, least_docs: int = 5) -> Model:
    """Fits on at most ``most`` labelled documents (ids drawn by a hash; held-out ids never) and the ``width`` words that tell most.

    The sample's ids have that bound, so they are broadcast. Words are counted by Spark and ranked by the chi-square of their
    documents; what comes to the driver is the ranked words and, for each sampled document, which of them it has.
    """
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("label"))
    chosen = drawn(known, most, "doc_id")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("label", "text")
    sample = written(texts.mapInArrow(_word_rows, "label int, words array<long>"), "labelled-words")
    n, bad = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        return Model(np.empty(0, np.int64), np.empty(0), 0.0)
    counts = sample.select("label", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_docs)
    expected = F.col("n") * F.lit(bad / n)
    spread = expected * F.lit(max(1 - bad / n, 1e-9))
    telling = counts.orderBy(F.desc(F.pow(F.col("bad") - expected, 2) / F.greatest(spread, F.lit(1e-9))), "word").limit(width)
    groups = identity_groups()
    vocabulary = np.unique(np.concatenate([np.array([r.word for r in telling.select("word").collect()], np.int64), *groups]))
    has = F.array_intersect("words", F.array(*[F.lit(int(v)) for v in vocabulary]))
    rows = sample.select("label", has.alias("has")).collect()
    x, y = np.zeros((len(rows), len(vocabulary))), np.array([r.label for r in rows], np.float64)
    for i, r in enumerate(rows):
        x[i, np.searchsorted(vocabulary, np.array(r.has, np.int64))] = 1
    changes = counterfactuals(x, [np.searchsorted(vocabulary, g).tolist() for g in groups])
    weights, bias = fit(x, y, changes)
    return Model(vocabulary, weights, bias)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, ``held_out``, ``score`` (1: toxic) and ``predicted`` for every row of ``docs`` (doc_id, text; nothing else is read).

    Whole texts are scored; a null text counts as empty and gets the score of a text without telling words. A null ``doc_id`` is
    scored and never learnt from; repeated rows are scored each; repeated labels of an id count once (the largest). Without labels
    every score is 0.5.
    """
    share_package(docs.sparkSession)
    model = train(docs, labels, **options)

    def run(column: pa.Array) -> pa.Array:
        parts = [model.scores(t) for _, t in slices(texts_of(column))]
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    out = docs.select(F.col("doc_id").cast("long"), F.arrow_udf(run, "double")(F.col("text").cast("string")).alias("score"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
