"""URL filter: rules first, then the ratio of two character language models.

Two variable-order Markov models, one of accepted and one of rejected URLs, give each character of a URL a probability after
the characters before it. Orders are mixed by Witten-Bell smoothing: a context's own counts weigh as much as it was seen, the rest
of the weight goes to the next shorter context, and the shortest is uniform. A URL is rejected if the mean log-likelihood
difference per character passes a threshold, calibrated on held-out accepted URLs. All other distinct URLs are counted.

The models read the whole URL, A-Z lower-cased; rules read host and path only.

The training labels are weak: a URL that has a word, in any part, that begins with one of ``bad_words`` is an example of the
rejected ones, any other of the accepted ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whisperlake.llm.arrays import texts_of
from whisperlake.llm.store import share_package, tidy, written

# Beginnings of words of unwanted hosts and paths (fixed values).
BAD_WORDS = ("spam", "casino", "poker", "bets", "betting", "pills", "pharma", "viagra", "loan", "porn", "xxx", "sex", "escort",
             "torrent", "warez", "crack", "ads", "adserver", "clickbait", "doorway", "linkfarm")
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Characters are seven bits; anything beyond ASCII is one more symbol, and 0 stands for the beginning.
_BEYOND = 127
_SYMBOLS = 128
# Bins of a unit of score in the calibration's histogram; scores are means of log ratios, so its range is small.
_GRID = 1 << 12
# Differences are whole numbers of this part of a unit, so that sums don't depend on their order.
_UNIT = 1 << 32


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class Settings:
    """``order``: longest context. ``most``: runs of symbols that are sent to all tasks; more of them are joined, with the same scores. ``lost``: share of
    held-out accepted URLs that the calibrated threshold may reject."""

    order: int = 5
    most: int = 1 << 20
    lost: float = 0.002
    bad_words: tuple[str, ...] = field(default=BAD_WORDS)


# The rules of the query (fixed values).
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), *_LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def text_of(url: Column) -> Column:
    """What the models read: the whole URL, A-Z lower-cased; null is empty."""
    return F.translate(F.coalesce(url.cast("string"), F.lit("")), *_LOWER)


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, or null. Of rules with equal text the first counts."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def contexts(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``order`` symbols before each character and itself, packed in seven bits each, and where each text begins."""
    rows = [np.frombuffer(t.encode("ascii", "replace"), np.uint8) if t.isascii() else
            np.array([min(ord(c), _BEYOND) for c in t], np.uint8) for t in texts.to_pylist()]
    size = np.array([len(r) for r in rows], np.int64)
    starts = np.concatenate(([0], np.cumsum(size)))
    flat = np.concatenate(rows).astype(np.uint64) if rows else np.empty(0, np.uint64)
    depth = np.arange(len(flat)) - np.repeat(starts[:-1], size)
    out = flat.copy()
    for k in range(1, order + 1):
        before = np.zeros_like(flat)
        before[k:] = flat[:-k]
        out |= np.where(depth >= k, before, 0).astype(np.uint64) << np.uint64(7 * k)
    return out, starts


class Model(NamedTuple):
    """Counts of each order from 0 up: packed context with character, its count; packed context, its count, its distinct followers."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    heads: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def log_probability(self, packed: np.ndarray) -> np.ndarray:
        p = np.full(len(packed), 1 / _SYMBOLS)
        for k, ((grams, count), (heads, total, kinds)) in enumerate(zip(self.grams, self.heads)):
            gram = packed & np.uint64((1 << 7 * (k + 1)) - 1)
            c, n, t = _get(grams, gram, count), _get(heads, gram >> np.uint64(7), total), _get(heads, gram >> np.uint64(7), kinds)
            p = np.where(n > 0, (c + t * p) / np.maximum(n + t, 1), p)
        return np.log(p)


def _get(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(float)


def fit(texts: list[str], order: int) -> Model:
    """The model of a few texts at once. :func:`train` counts the texts of a table on Spark, to the same probabilities."""
    packed, _ = contexts(texts_of(pa.array(texts, pa.string())), order)
    grams, heads = [], []
    for k in range(order + 1):
        g, c = np.unique(packed & np.uint64((1 << 7 * (k + 1)) - 1), return_counts=True)
        h, first, kinds = np.unique(g >> np.uint64(7), return_index=True, return_counts=True)
        grams.append((g, c))
        heads.append((h, np.add.reduceat(c, first) if len(c) else c, kinds))
    return Model(grams, heads)


def differences(texts: pa.Array, accepted: Model, rejected: Model, order: int) -> np.ndarray:
    """Mean log-likelihood of the rejected model less that of the accepted one, per character; 0 for an empty text."""
    packed, starts = contexts(texts, order)
    each = np.concatenate(([0.0], np.cumsum(rejected.log_probability(packed) - accepted.log_probability(packed))))
    size = np.diff(starts)
    return np.where(size > 0, (each[starts[1:]] - each[starts[:-1]]) / np.maximum(size, 1), 0.0)


class Scores(NamedTuple):
    """What :func:`train` has learnt: ``runs`` (gram, value) has the difference of each run of ``order + 1`` symbols as a whole number of 1 / ``_UNIT``;
    ``texts`` are the distinct URLs (no, text, bad, held)."""

    runs: DataFrame
    texts: DataFrame
    threshold: float


def count_runs(texts: DataFrame, order: int) -> DataFrame:
    """Each run of ``order + 1`` symbols of ``texts`` (text, bad, held), with how often the accepted and the rejected texts to learn from have it."""
    def run(batches):
        for batch in batches:
            packed, starts = contexts(texts_of(batch.column(0)), order)
            bad, held = (batch.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (1, 2))
            owner = np.repeat(np.arange(len(bad)), np.diff(starts))
            grams, at = np.unique(packed, return_inverse=True)
            counts = [np.bincount(at, weights=w[owner], minlength=len(grams)).astype(np.int64) for w in (~bad & ~held, bad & ~held)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (grams.astype(np.int64), *counts)], names=["gram", "accepted", "rejected"])

    found = texts.select("text", "bad", "held").mapInArrow(tidy(run), "gram long, accepted long, rejected long")
    return found.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


def log_ratios(counts: DataFrame, order: int) -> DataFrame:
    """gram and ``value`` for each row of :func:`count_runs`: log-likelihood of the last symbol after those before it, rejected less accepted.

    The same smoothing as :class:`Model`, order by order: at most ``_SYMBOLS`` runs share a context, so its sums are a window over few rows.
    """
    kinds, shorter = ("accepted", "rejected"), None
    for k in range(order + 1):
        at = counts.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 7 * (k + 1)) - 1)).alias("gram")).agg(*(F.sum(c).alias(c) for c in kinds))
        context = Window.partitionBy(F.shiftright("gram", 7))
        at = at.select("gram", *kinds, *(F.sum(c).over(context).alias(f"{c}_n") for c in kinds), *(F.count_if(F.col(c) > 0).over(context).alias(f"{c}_t") for c in kinds))
        if shorter is None:
            at = at.select("*", *(F.lit(1 / _SYMBOLS).alias(f"{c}_p") for c in kinds))
        else:
            at = at.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << 7 * k) - 1))).join(shorter.withColumnRenamed("gram", "short"), "short")
        c, n, t, p = ({x: F.col(x + end) for x in kinds} for end in ("", "_n", "_t", "_p"))
        shorter = at.select("gram", *(F.when(n[x] > 0, (c[x] + t[x] * p[x]) / (n[x] + t[x])).otherwise(p[x]).alias(f"{x}_p") for x in kinds))
    ratio = F.log(F.col("rejected_p")) - F.log(F.col("accepted_p"))
    return shorter.select("gram", F.round(ratio * _UNIT).cast("long").alias("value"))


def _sums(texts: pa.Array, order: int, grams: np.ndarray, values: np.ndarray) -> np.ndarray:
    packed, starts = contexts(texts, order)
    each = values[np.searchsorted(grams, packed.astype(np.int64))] if len(packed) else np.empty(0, np.int64)
    each = np.concatenate((np.zeros(1, np.int64), np.cumsum(each)))
    return _mean(each[starts[1:]] - each[starts[:-1]], np.diff(starts))


def _mean(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(size > 0, total / _UNIT / np.maximum(size, 1), 0.0)


def scored(rows: DataFrame, learnt: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """``rows`` (text and others; only texts that the runs were counted over, or empty ones) with ``score``: the mean difference per character, 0 for an empty text.

    Up to ``most`` runs are looked up in the tasks; more are joined to the runs of the distinct texts. Both add whole numbers, so the scores are the same.
    """
    order = s.order
    # One more row than fits says that there are too many.
    if learnt.limit(s.most + 1).count() <= s.most:
        table = learnt.orderBy("gram").toArrow()
        grams, values = (table.column(c).to_numpy() for c in ("gram", "value"))

        def run(column: pa.Array) -> pa.Array:
            return pa.array(_sums(texts_of(column), order, grams, values), pa.float64())

        return rows.withColumn("score", F.arrow_udf(run, "double")("text"))

    def split(batches):
        for batch in batches:
            packed, starts = contexts(texts_of(batch.column(1)), order)
            no = np.repeat(batch.column(0).to_numpy(), np.diff(starts))
            yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(packed.astype(np.int64))], names=["no", "gram"])

    met = texts.select("no", "text").mapInArrow(tidy(split), "no long, gram long").join(learnt, "gram")
    means = met.groupBy("no").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("size")).select(
        "no", (F.col("total") / F.lit(float(_UNIT)) / F.col("size")).alias("score"))
    known = texts.select("no", "text").join(means, "no").select("text", "score")
    return rows.join(written(known, "url-scores"), "text", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).select(*rows.columns, "score")


def train(pages: DataFrame, s: Settings = Settings()) -> Scores:
    """Both models, as the difference that each run of symbols makes, and the threshold. The models learn from all distinct examples of their kind.

    A fifth of all distinct accepted examples, by a hash, is held out and scored: at most the share ``lost`` of them passes the
    threshold, which is an edge of a fixed grid, whatever their number. Without examples of a kind its model is uniform.
    """
    share_package(pages.sparkSession)
    text = text_of(F.col("url")).alias("text")
    bad = F.col("text").rlike("(?i)(^|[./_?&=#:@;+-])(" + "|".join(s.bad_words) + ")")
    held = ~bad & (F.pmod(F.xxhash64(F.lit("held"), "text"), F.lit(5)) == 0)
    seen = pages.select(text).filter("text != ''").distinct().withColumns({"bad": bad, "held": held, "no": F.monotonically_increasing_id()})
    seen = written(seen, "urls")
    runs = written(log_ratios(written(count_runs(seen, s.order), "url-runs"), s.order), "url-ratios")
    points = scored(seen.filter("held").select("text"), runs, seen.filter("held"), s)
    bins = points.groupBy(F.floor(F.col("score") * _GRID).alias("bin")).count().toArrow()
    return Scores(runs, seen, threshold_of(bins.column("bin").to_numpy(), bins.column("count").to_numpy(), s.lost))


def threshold_of(bins: np.ndarray, count: np.ndarray, lost: float) -> float:
    """The smallest upper edge of a bin, 0 at least, above which lie at most the share ``lost`` of all."""
    if not len(bins):
        return 0.0
    order = np.argsort(bins)
    above = count.sum() - np.cumsum(count[order])
    return max(0.0, float(bins[order][np.argmax(above <= lost * count.sum())] + 1) / _GRID)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, s: Settings = Settings()) -> DataFrame:
    """page_id, ``host``, ``path``, ``rule`` (text of the rule that fits, or null), ``verdict`` and ``score`` for every row of ``pages``
    (page_id, url; other columns are not read).

    ``score`` is the difference less the threshold (above 0: block); the verdict is the rule's where one fits. A URL
    without ``://`` has an empty host and path and is scored like any other; a null or empty one has score 0 less the threshold, and is allowed. Repeated rows are judged each.
    """
    share_package(pages.sparkSession)
    learnt = train(pages, s)
    at = pages.select(F.col("page_id").cast("long"), text_of(F.col("url")).alias("text"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = scored(at.withColumn("r", rule_for(F.col("host"), F.col("path"), rules)), learnt.runs, learnt.texts, s).withColumn(
        "score", F.col("score") - learnt.threshold)
    verdict = F.coalesce("r.verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "score")
