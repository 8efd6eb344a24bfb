"""Substring dedup by super-k-mer partitioning.

A window is `k` consecutive words of one document. Its super-k-mer travels as one
packed string to the bucket of its minimiser; there the windows are hashed and sorted, equal
neighbours are confirmed byte by byte, and every window that also starts in a document with
a smaller id is marked. A word in a marked window is removed. Windows are judged
on the input, not on what is left of it.

Null texts have no words. A null id counts as the last document; windows of rows that
share an id do not remove one another. Repeated rows give repeated rows. Texts of fewer than k words
stay whole. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import table
from ._text import grams, words_of
from ._windows import NO_ID, Bucket, Scheme, buckets, equal_spans, hot_minimisers, hot_spans, inflate, keyed, merged, per_bucket, with_spans, word_units

WINDOW, MINIMISER, HOT_RUNS = 50, 8, 50_000


def earlier_windows(b: Bucket, k: int) -> tuple[np.ndarray, ...]:
    """Spans (doc, text_key, first word, end word) of the windows of a bucket that also start in a smaller document."""
    w = words_of(b.data, b.off)
    at, h = grams(w.hashes(), w.first, k)
    run = np.searchsorted(w.first, at, "right") - 1
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    new = np.append(True, ~same)
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    doc = b.doc[run[order]]
    if not len(doc):
        return (np.zeros(0, np.int64),) * 4
    least = np.minimum.reduceat(doc, head)
    is_least = np.flatnonzero(doc == least[group])
    pick = np.zeros(len(head), np.int64)
    pick[group[is_least][::-1]] = order[is_least[::-1]]  # the first window of the smallest document
    late = np.flatnonzero(doc > least[group])
    me, other = order[late], pick[group[late]]
    s = np.argsort(me, kind="stable")
    me, other = me[s], other[s]
    chain = np.append(True, (me[1:] != me[:-1] + 1) | (other[1:] != other[:-1] + 1) | (run[me[1:]] != run[me[:-1]]) | (run[other[1:]] != run[other[:-1]])) if len(me) else np.zeros(0, bool)
    lo = np.flatnonzero(chain)
    hi = np.append(lo[1:], len(me)) - 1 if len(lo) else lo
    a, z = at[me[lo]], at[me[hi]] + k - 1
    x, y = at[other[lo]], at[other[hi]] + k - 1
    size = w.end[z] - w.start[a]
    if (size != w.end[y] - w.start[x]).any() or not equal_spans(b.data, w.start[a], w.start[x], size).all():
        return _by_bytes(b, w, at, run, k)
    first = b.pos[run[me[lo]]] + a - w.first[run[me[lo]]]
    return b.doc[run[me[lo]]], b.text[run[me[lo]]], first, first + (z - a) + 1


def _by_bytes(b: Bucket, w, at: np.ndarray, run: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The same by the bytes themselves, for a bucket in which two windows share a hash."""
    raw, least, spans = b.data.tobytes(), {}, []
    text = [raw[w.start[i] : w.end[i + k - 1]] for i in at.tolist()]
    for t, r in zip(text, run.tolist()):
        least[t] = min(least.get(t, NO_ID), int(b.doc[r]))
    for t, i, r in zip(text, at.tolist(), run.tolist()):
        if b.doc[r] > least[t]:
            first = int(b.pos[r] + i - w.first[r])
            spans.append((b.doc[r], b.text[r], first, first + k))
    return tuple(np.array(spans, np.int64).reshape(-1, 4).T)


def _in_smaller(windows: DataFrame) -> DataFrame:
    least = windows.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").drop("most")
    return windows.join(least, ["h1", "h2"]).filter("doc > least")


def removed_spans(texts: DataFrame, k: int = WINDOW, m: int = MINIMISER, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc, text_key, s, e): words to remove."""
    scheme = Scheme(word_units, k, m, 1 << 22, hot_runs)
    hot = hot_minimisers(texts, scheme)
    spans = per_bucket(buckets(texts, scheme, hot), lambda b: earlier_windows(b, k))
    return spans.unionByName(hot_spans(texts, scheme, hot, _in_smaller)) if len(hot) else spans


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = MINIMISER, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Every row: doc_id, n_words, n_removed, kept_text (words kept, joined by one space)."""
    texts = keyed(docs, id_col, text_col)

    def run(batches):
        for b in batches:
            n, gone, kept = [], [], []
            for z, spans in zip(b.column(1), b.column(2).to_pylist()):
                words = inflate(z.as_py()).split()
                n.append(len(words))
                out, last = [], 0
                for s, e in merged(((x["s"], x["e"]) for x in spans or ()), len(words)):
                    out += words[last:s]
                    last = e
                out += words[last:]
                gone.append(len(words) - len(out))
                kept.append(b" ".join(out).decode())
            doc = b.column(0)
            yield pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    out = with_spans(texts, removed_spans(texts, k, m, hot_runs)).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op2_super_kmers(spark, sf_dir: str) -> DataFrame:
    return dedup_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
