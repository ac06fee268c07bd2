"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete binary trees of a fixed depth in flat arrays (feature, threshold, value), so a
batch of documents walks all trees with a few numpy gathers per level.

Scale. The model is fitted on at most ``SAMPLE`` labelled rows (those with the smallest hashed ids),
whose statistics are computed in tasks: the driver sees ``SAMPLE`` short rows of numbers at any size.
Scoring is one pass over the texts without a shuffle; the model, some kilobytes, is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.rules import _CONTINUATION, _DIGITS, _LOWER, _SPACES, _SYMBOLS, _UPPER, Doc
from canopyframe.llm.textio import byte_slices

#: Bound on the labelled rows that a model is fitted on.
SAMPLE = 20_000
#: Rows with crc32(id as text) mod FOLDS = 0 are held out.
FOLDS = 5
THRESHOLD = 0.3
ROUNDS, DEPTH, BINS, RATE, L2, LEAST = 60, 4, 64, 0.15, 1.0, 5.0

FEATURES = ["log_words", "word_length", "upper", "symbols", "exclaims", "digits", "stops", "wide", "distinct", "top_word", "repeats", "dup_lines", "line_words", "other", "spaces", "top_letter"]


def statistics(text: bytes) -> list[float]:
    """Document statistics, all defined (zero) for an empty text."""
    d = Doc(text)
    n, chars = d.n_words, max(1, d.word_chars)
    letters = max(1, d.count(_UPPER) + d.count(_LOWER))
    words = max(1, n)
    same = sum(map(bytes.__eq__, d.words, d.words[1:]))
    stops = int(d.bytes[[0x2E, 0x2C, 0x3B, 0x3A, 0x3F]].sum())
    lead = d.count(np.arange(0xC0, 0x100))
    alnum = d.count(_UPPER) + d.count(_LOWER) + d.count(_DIGITS) + lead
    return [
        np.log1p(n),
        d.word_chars / words,
        d.count(_UPPER) / letters,
        d.n_symbols / words,
        int(d.bytes[0x21]) / words,
        d.count(_DIGITS) / chars,
        stops / words,
        lead / chars,
        d.distinct_words / words,
        d.top_word / words,
        same / words,
        d.n_dup_lines / max(1, len(d.lines)),
        n / max(1, len(d.lines)),
        (d.word_chars - alnum) / chars,
        d.count(_SPACES) / words,
        int(d.bytes[_LOWER].max()) / letters,
    ]


def statistics_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def kernel(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(x) for part in byte_slices(texts) for x in part], pa.list_(pa.float64()))

    return kernel(text)


@dataclass
class Trees:
    """``feature`` and ``threshold`` per inner node, ``value`` per leaf, a row for each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        trees, inner = self.feature.shape
        offset = np.arange(trees) * inner
        feature, threshold = self.feature.ravel(), self.threshold.ravel()
        node = np.zeros((len(x), trees), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            at = node + offset
            node = 2 * node + 1 + (x[rows, feature[at]] > threshold[at])
        leaf = node - inner + np.arange(trees) * self.value.shape[1]
        margin = np.clip(self.base + self.value.ravel()[leaf].sum(1), -30, 30)
        return 1 / (1 + np.exp(-margin))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Newton boosting of the logistic loss on quantile-binned statistics."""
    inner, leaves, width = 2**depth - 1, 2**depth, x.shape[1] if x.ndim == 2 else len(FEATURES)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        none = np.zeros((1, inner))
        return Trees(none.astype(np.int64), none + np.inf, np.zeros((1, leaves)), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    flat = binned + np.arange(width) * bins
    margin = np.full(len(y), base)
    found = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (width * bins) + flat).ravel()
            shape = (count, width, bins)
            gs = np.bincount(key, np.repeat(g, width), count * width * bins).reshape(shape).cumsum(2)
            hs = np.bincount(key, np.repeat(h, width), count * width * bins).reshape(shape).cumsum(2)
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
            gain[(hs < LEAST * 0.01) | (ht - hs < LEAST * 0.01)] = 0
            best = gain.reshape(count, -1).argmax(1)
            good = gain.reshape(count, -1).max(1) > 1e-6
            for k in np.flatnonzero(good):
                f, b = divmod(int(best[k]), bins)
                if b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        margin = margin + value[leaf]
        found.append((feature, threshold, value))
    return Trees(*(np.stack(z) for z in zip(*found)), base)


def held_out(key: Column) -> Column:
    """True where crc32 of the id as text is divisible by FOLDS; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Model of ``label_col``, from rows that are not held out. No labels, or one class: the prior alone."""
    rows = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("double").alias("y")).filter("k IS NOT NULL AND y IS NOT NULL")
    rows = rows.filter(~held_out(F.col("k"))).orderBy(F.xxhash64("k"), "k", "y").limit(sample)
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text"))
    # a repeated id gives several rows, so the bound is kept after the join too
    got = texts.join(F.broadcast(rows), "k").select("k", "y", statistics_column(F.col("text")).alias("x")).orderBy("k", "y", "x").limit(sample).collect()
    y = np.array([r.y for r in got], float)
    return fit_trees(np.array([r.x for r in got], float).reshape(len(got), len(FEATURES)), y)


def score_column(text: Column, model) -> Column:
    """Score of a text under a broadcast model."""

    @F.arrow_udf("double")
    def kernel(texts: pa.Array) -> pa.Array:
        out = [model.value.predict(np.array([statistics(x) for x in part]).reshape(len(part), len(FEATURES))) for part in byte_slices(texts)]
        return pa.array(np.concatenate([np.zeros(0), *out]))

    return kernel(text)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: ``id_col, held_out, score, predicted``.

    Null and empty texts get the score of an empty text; a null id is not held out. Repeated rows
    stay; repeated labels count each time. Null labels are not learned from. Other columns are not
    looked at. Empty documents give an empty result, empty labels the score 0.5. Texts are read whole.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, sample))
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score_column(F.col(text_col), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with its own columns, less the rows predicted 0."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, sample))
    return docs.filter(score_column(F.col(text_col), model) >= threshold)
