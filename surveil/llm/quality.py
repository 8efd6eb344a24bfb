"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes D statistics (logarithms of lengths, log-odds of shares). For
each class a mean and a covariance are learned from sums that executors
pre-aggregate; the covariance is shrunk towards the pooled one and towards its
own mean variance, and its Cholesky factor is computed once and sent with the
scoring tasks. A score is the logistic function of the difference of the
two log densities plus the log prior odds.

Nulls and empty texts have the statistics of a text without words. Rows with
a null label, or with an id that has no document, teach nothing. With no rows
of one class the score is the share of label 1 (0.5 without any label). Repeated
rows are scored and counted one by one. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import crc_mod, cut, table
from ._text import IS_SPACE, doc_chunks, grams, words_of

STATS = (
    "bytes", "words", "word_len", "word_len_sd", "short_words", "long_words", "digits", "upper", "symbols", "stops", "commas",
    "wide", "lines", "spaces", "distinct", "top_word", "repeated_runs", "caps_words", "symbol_words", "entropy",
)
D = len(STATS)

_CLASS = np.zeros((256, 6), np.uint8)  # digit, upper, symbol, stop, comma, non-ASCII
_CLASS[48:58, 0] = 1
_CLASS[65:91, 1] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"], 2] = True
_CLASS[ord("."), 3] = True
_CLASS[ord(","), 4] = True
_CLASS[128:, 5] = 1


def _odds(share: np.ndarray) -> np.ndarray:
    return np.log((share + 1e-3) / (1.001 - share))


def _runs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document and each of its distinct hashes: the document and how often the hash occurs."""
    bits = np.uint64(max(1, int(doc[-1]).bit_length()) if len(doc) else 1)
    key = np.sort((doc.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits))
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return (key[at] >> (np.uint64(64) - bits)).astype(np.int64), np.diff(np.append(at, len(key)))


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The D statistics of each document, as columns."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    some = np.maximum(size, 1)
    w = words_of(data, off)
    count = np.diff(w.first).astype(float)
    many = np.maximum(count, 1)
    length = (w.end - w.start).astype(float)
    doc = w.doc

    hist = np.bincount(np.repeat(np.arange(n) * 256, np.diff(off)) + data, minlength=n * 256).reshape(n, 256) / some[:, None]
    share = hist @ _CLASS

    def per_word(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, x, n) / many

    mean = per_word(length)
    sd = np.sqrt(np.maximum(per_word(length * length) - mean * mean, 0))
    h = w.hashes()
    distinct, top = np.zeros(n), np.zeros(n)
    of, run = _runs(h, doc)
    distinct = np.bincount(of, minlength=n) / many
    if len(of):
        at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        top[of[at]] = np.maximum.reduceat(run, at) / many[of[at]]
    at, g = grams(h, w.first, 5)
    of, run = _runs(g, doc[at])
    repeated = np.bincount(of, run - 1, n) / np.maximum(np.bincount(of, run, n), 1)
    held = np.zeros((2, len(length)), np.int32)
    if len(length):
        for k in (0, 1):  # upper-case letters and symbols of each word; the space up to the next one adds none
            np.add.reduceat(_CLASS[:, k + 1][data], w.start, dtype=np.int32, out=held[k])
    caps, marked = held[0] * 2 > length, held[1] > 0
    entropy = -(hist * np.log(np.where(hist > 0, hist, 1))).sum(1)
    return np.column_stack([
        np.log1p(size), np.log1p(count), np.log1p(mean), np.log1p(sd), _odds(per_word(length <= 3)), _odds(per_word(length >= 12)),
        *_odds(share).T, _odds(hist[:, 10]), _odds(hist[:, IS_SPACE].sum(1)), _odds(distinct), _odds(top), _odds(repeated),
        _odds(per_word(caps)), _odds(per_word(marked)), entropy,
    ])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats array<double>) for every row."""

    def run(batches):
        for b in batches:
            ids, text = b.column(0), b.column(1)
            for lo, hi, data, off in doc_chunks(text):
                x = statistics(data, off)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * D, x.ravel())], names=["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class Discriminant:
    prior: float  # log odds of class 1
    mean: np.ndarray | None = None  # class, D
    factor: np.ndarray | None = None  # class, D, D: inverse lower Cholesky factor
    logdet: np.ndarray | None = None

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.prior)
        far = [(((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) + self.logdet[k] for k in (0, 1)]
        return self.prior + (far[0] - far[1]) / 2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


def fit(labelled: DataFrame, shrink: float = 0.3, ridge: float = 0.05) -> Discriminant:
    """Learn from (stats, label 0 or 1). Executors send sums only: 2 * (1 + D + D * D) numbers reach the driver."""

    def sums(batches):
        total = np.zeros((2, 1 + D + D * D))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            y = b.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        k, i = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total.ravel())], names=["k", "i", "v"])

    rows = labelled.select("stats", F.col("label").cast("int")).filter("label in (0, 1)").mapInArrow(sums, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + D + D * D))
    for r in rows:
        total[r.k, r.i] = r.v
    n = total[:, 0]
    prior = float(np.log((n[1] + 0.5) / (n[0] + 0.5))) if n.sum() else 0.0
    if n.min() < 2:
        return Discriminant(prior)
    mean = total[:, 1 : 1 + D] / n[:, None]
    cov = np.array([total[k, 1 + D :].reshape(D, D) / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)])
    pooled = (cov * n[:, None, None]).sum(0) / n.sum()
    scale = np.diag(pooled).mean() + 1e-9
    cov = (1 - shrink) * cov + shrink * pooled
    cov = (1 - ridge) * cov + ridge * np.diag(np.maximum(np.diag(pooled), 1e-3 * scale))
    low = np.linalg.cholesky(cov)
    return Discriminant(prior, mean, np.linalg.inv(low), 2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1))


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of every row of document_statistics()."""

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def train_on(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", folds: int = 5) -> Discriminant:
    """Fit on the labelled documents whose crc32(id as text) mod folds is not 0."""
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).filter(crc_mod("doc_id", folds) != 0)
    return fit(stats.join(y, "doc_id").select("stats", "label"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Every row of docs: doc_id, held_out, score, predicted."""
    stats = cut(document_statistics(docs))
    scored = score(stats, train_on(stats, labels))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that the classifier rejects; scored in place, so no row moves."""
    model = train_on(document_statistics(docs), labels)  # only the statistics are shuffled to meet the labels
    schema, place = docs.schema, docs.columns.index("text")

    def run(batches):
        for b in batches:
            for lo, hi, data, off in doc_chunks(b.column(place)):
                keep = model.score(statistics(data, off)) >= threshold
                yield b.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
