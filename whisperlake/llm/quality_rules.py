"""Quality rules: documents whose character classes or common words diverge from every language's own profile go.

For each language, the profile has the usual share of each character class, and of each common word (the remaining words together
are one more share), over all its documents that pass the base rules. A document is measured against the language whose common words are nearest, by
the Jensen-Shannon distance (base 2: 0 for equal, 1 for disjoint distributions). Short texts vary by chance, so the common words are
measured from ``min_words`` words on, the characters from ``min_chars`` characters on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.arrays import slices, texts_of
from whisperlake.llm.doc_stats import ALL_COMMON, CLASSES, COMMON, SLICE, counts, statistics
from whisperlake.llm.store import share_package, unused, written


@dataclass(frozen=True)
class Limits:
    """Largest distances of a good document: of either kind alone, and of both together; and the lengths from which they hold."""

    class_alone: float = 0.28
    word_alone: float = 0.50
    class_both: float = 0.17
    word_both: float = 0.26
    min_words: int = 50
    min_chars: int = 200


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to one distribution; an empty row has distance 0."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(reference > 0, reference * np.log2(reference / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum((left + right) / 2, 0)), 0.0)


def _word_counts(common: np.ndarray, n_words: np.ndarray, lang: str) -> np.ndarray:
    """The language's common words and all others."""
    own = common[:, [ALL_COMMON.index(w) for w in COMMON[lang]]]
    return np.concatenate((own, (n_words - own.sum(axis=1))[:, None]), axis=1)


# Steps of a share's square root in the histograms that medians are read from.
_BINS = 512
_CELLS_DDL = "lang string, cell long, weight long"
Profiles = dict[str, tuple[np.ndarray, np.ndarray]]


def _shares(s: dict[str, np.ndarray], rows: np.ndarray, lang: str) -> np.ndarray:
    """Shares of character classes, then of the language's common words and the rest, for some of the texts."""
    classes, word = s["classes"][rows], _word_counts(s["common"][rows], s["n_words"][rows], lang)
    return np.concatenate([x / np.maximum(x.sum(axis=1, keepdims=True), 1) for x in (classes, word)], axis=1)


_COUNTS = [("n_words", pa.int64()), ("n_repeat_words", pa.int64()), ("classes", pa.list_(pa.int32())), ("common", pa.list_(pa.int32()))]
_COUNTS_DDL = "n_words long, n_repeat_words long, classes array<int>, common array<int>"


def _counted(text: Column) -> Column:
    """What the rules look at in a text, as a struct; null for a text that fails the base rules."""
    def run(column: pa.Array) -> pa.Array:
        parts = [counts(t) for _, t in slices(texts_of(column), SLICE)] or [counts(pa.array([], pa.large_string()))]
        s = {k: np.concatenate([p[k] for p in parts]) for k, _ in _COUNTS}
        fields = [_rows(s[k]) if pa.types.is_list(kind) else pa.array(s[k], kind) for k, kind in _COUNTS]
        return pa.StructArray.from_arrays(fields, names=[k for k, _ in _COUNTS], mask=pa.array(base_failed(s["n_words"], s["n_repeat_words"])))

    return F.arrow_udf(run, _COUNTS_DDL)(text)


def _rows(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel(), pa.int32()))


def _counts_of(column: pa.StructArray) -> dict[str, np.ndarray]:
    """The counts of texts that passed the base rules."""
    out = {}
    for (k, kind), values in zip(_COUNTS, column.flatten()):
        values = values.flatten() if pa.types.is_list(kind) else values
        out[k] = values.to_numpy(zero_copy_only=False).astype(np.int64)
    return out | {"classes": out["classes"].reshape(-1, len(CLASSES)), "common": out["common"].reshape(-1, len(ALL_COMMON))}


def _of_texts(column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    for _, part in slices(texts_of(column), SLICE):
        yield counts(part)


def _of_counts(column: pa.StructArray) -> Iterator[dict[str, np.ndarray]]:
    yield _counts_of(column)


def _profile_cells(read):
    """Rows (what ``read`` takes, lang) to the histograms of each language."""
    def run(batches):
        width = {lang: len(CLASSES) + len(ws) + 1 for lang, ws in COMMON.items()}
        total = {lang: np.zeros(width[lang] * _BINS, np.int64) for lang in COMMON}
        for batch in batches:
            langs, at = np.array(batch.column(1).to_pylist(), object), 0
            for s in read(batch.column(0)):
                n = len(s["n_words"])
                good = ~base_failed(s["n_words"], s["n_repeat_words"])
                for lang, cells in total.items():
                    rows = np.flatnonzero(good & (langs[at:at + n] == lang))
                    cell = (np.sqrt(_shares(s, rows, lang)) * (_BINS - 1)).round().astype(np.int64) + np.arange(width[lang]) * _BINS
                    cells += np.bincount(cell.ravel(), np.repeat(s["n_words"][rows], width[lang]), len(cells)).astype(np.int64)
                at += n
        for lang, cells in total.items():
            used = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(cells[used])],
                                             names=["lang", "cell", "weight"])

    return run


def profiles(docs: DataFrame) -> Profiles:
    """For each supported language in ``docs`` (text, lang): shares of character classes and of common words.

    A share is the median over all documents that pass the base rules, weighted by their words, so that junk shapes no profile
    as long as it is less than half of a language. The tasks add up all documents in histograms of a fixed number of cells, which are what
    comes to the driver.
    """
    share_package(docs.sparkSession)
    return _medians(docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(_profile_cells(_of_texts), _CELLS_DDL))


def _medians(sums: DataFrame) -> Profiles:
    """The profiles from the histograms of all tasks."""
    found: dict[str, dict[int, int]] = {lang: {} for lang in COMMON}
    for r in sums.groupBy("lang", "cell").agg(F.sum("weight").alias("weight")).collect():
        found[r.lang][r.cell] = r.weight
    out = {}
    for lang, cells in found.items():
        if cells:
            weight = np.zeros((len(CLASSES) + len(COMMON[lang]) + 1) * _BINS)
            weight[list(cells)] = list(cells.values())
            below = weight.reshape(-1, _BINS).cumsum(axis=1)
            share = ((below >= below[:, -1:] / 2).argmax(axis=1) / (_BINS - 1)) ** 2
            classes, word = share[:len(CLASSES)], share[len(CLASSES):]
            out[lang] = (classes / classes.sum(), word / word.sum())
    return out


_RESULT = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
           ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("class_distance", pa.float64()),
           ("word_distance", pa.float64())]
_RESULT_DDL = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
               "kept boolean, class_distance double, word_distance double")


def judged(s: dict[str, np.ndarray], langs: np.ndarray, known: Profiles, limits: Limits) -> dict[str, np.ndarray]:
    """The distances and the verdict of texts with these counts. Without any profile the base rules decide."""
    failed = base_failed(s["n_words"], s["n_repeat_words"])
    n = len(failed)
    word, chars = np.full(n, np.inf), np.zeros(n)
    for lang, (class_shares, word_shares) in known.items():
        d = distances(_word_counts(s["common"], s["n_words"], lang), word_shares)
        nearer = d < word
        word[nearer] = d[nearer]
        chars[nearer] = distances(s["classes"][nearer], class_shares)
    word[np.isinf(word)] = 0.0
    # No profile speaks for a language that is named and not supported.
    foreign = np.array([x is not None and x not in known for x in langs], bool)
    # A text under its minimum length counts as near.
    word_far = np.where(s["n_words"] >= limits.min_words, word, 0.0)
    char_far = np.where(s["classes"].sum(axis=1) >= limits.min_chars, chars, 0.0)
    far = (char_far > limits.class_alone) | (word_far > limits.word_alone) | (
        (char_far > limits.class_both) & (word_far > limits.word_both))
    return {
        "base_failed": failed, "kept": ~failed & (foreign | ~far), "class_distance": chars, "word_distance": word}


def verdict(docs: DataFrame, limits: Limits = Limits()) -> Column:
    """A struct column for rows of ``docs`` (text, lang): the counts, the distances, ``base_failed`` and ``kept``.

    Building it runs one job, which gathers the profiles of all of ``docs``. A null or empty text has no words and fails the base
    rules. With a null ``lang`` the nearest profile decides; a named language without profile is judged by the base rules alone.
    Repeated rows get the same result. Other columns are not read.
    """
    known = profiles(docs)

    def judge(text: pa.Array, lang: pa.Array) -> pa.Array:
        langs = np.array(lang.to_pylist(), object)
        parts = []
        for at, t in slices(texts_of(text), SLICE):
            s = statistics(t)
            parts.append(s | judged(s, langs[at:at + len(t)], known, limits))
        fields = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], kind) for k, kind in _RESULT]
        return pa.StructArray.from_arrays(fields, names=[k for k, _ in _RESULT])

    return F.arrow_udf(judge, _RESULT_DDL)(F.col("text").cast("string"), F.col("lang").cast("string"))


def apply_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` (at least text, lang) that are kept, with all their columns.

    The rows that pass the base rules are stored with what the other rules look at, so that each text goes through Python once: profiles
    and verdicts come from these columns alone.
    """
    share_package(docs.sparkSession)
    name = unused("counted", docs)
    # Behind a generator: a filter on the column itself would be pushed below the projection, with all the counting once more.
    every = docs.select("*", F.explode(F.array(_counted(F.col("text").cast("string")))).alias(name))
    passed = written(every.filter(F.col(name).isNotNull()), "base-rules")
    lang = F.col("lang").cast("string")
    known = _medians(passed.select(name, lang).mapInArrow(_profile_cells(_of_counts), _CELLS_DDL))

    def judge(counted: pa.Array, langs: pa.Array) -> pa.Array:
        return pa.array(judged(_counts_of(counted), np.array(langs.to_pylist(), object), known, limits)["kept"])

    return passed.filter(F.arrow_udf(judge, "boolean")(F.col(name), lang)).drop(name)
