"""Retrieval: sparse and dense scores and top-k lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Pairs of a query and one of its words that are sent to all tasks; more are joined by shuffle.
SENT = 1_000_000


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key), F.explode(F.split(F.lower(text), "[^a-z]+")).alias("w")).filter("w <> ''")


def bm25(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query_text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, score) of all pairs that share a term. Only words that are asked for leave the task that reads them; corpus statistics cover all documents."""
    # a document's words stay in one task from here on: counts, sizes and sums by document need no further shuffle
    words = docs.select(doc_id, text).repartition(doc_id).select(doc_id, F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "").alias("ws"))
    size = words.groupBy(doc_id).agg(F.sum(F.size("ws")).alias("n")).filter("n > 0")
    corpus = size.agg(F.count("*").alias("nd"), F.avg("n").alias("av"))
    asked = terms(queries, query_id, query_text).distinct()
    sent = F.broadcast if asked.count() <= SENT else lambda d: d
    hit = words.select(doc_id, F.explode("ws").alias("w")).join(sent(asked.select("w").distinct()), "w", "left_semi").groupBy(doc_id, "w").agg(F.count("*").alias("tf"))
    df = hit.groupBy("w").agg(F.count("*").alias("df"))
    rows = hit.join(sent(df), "w").join(size.hint("merge"), doc_id).join(sent(asked), "w").crossJoin(F.broadcast(corpus))
    idf = F.log(1 + (F.col("nd") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * ((1 - b) + b * F.col("n") / F.col("av")))
    return rows.groupBy(query_id, doc_id).agg(F.sum(idf * gain).alias("score"))


def top(scores: DataFrame, group: str, item: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), item)
    return scores.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def _packs(df: DataFrame, key: str, vector: str, name: str, pack: int) -> DataFrame:
    """One row per `pack` vectors of one length: ids and components end to end. Vectors that are null, zero or hold nulls are left out."""
    v = F.col(vector).cast("array<double>")
    fine = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.forall("v", lambda e: e.isNotNull()) & F.exists("v", lambda e: e != 0))

    def run(batches):
        for b in batches:
            size = np.diff(b.column(1).offsets.to_numpy())
            for d in np.unique(size).tolist():
                part = b.filter(pa.array(size == d))
                for lo in range(0, part.num_rows, pack):
                    some = part.slice(lo, pack)
                    yield pa.RecordBatch.from_arrays([pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([some.column(1).flatten().to_numpy()], pa.list_(pa.float64()))], names=[f"{name}_ids", name])

    return fine.mapInArrow(run, f"{name}_ids array<long>, {name} array<double>")


def nearest(rows: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int, digits: int = 6, pack: int = 2048) -> DataFrame:
    """(query, id, score): each query's k rows of highest cosine, rounded to `digits`, on ties of lowest id.

    Queries and rows meet in packs. A pair of packs is a group of its own, so that a worker holds one at a time however many fall
    to its task; it is multiplied by a few queries at once, and only the k best for each query leave the task.
    """

    def run(pair: pa.Table) -> pa.Table:
        out = [pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        for q_ids, q, x_ids, x in zip(*(pair.column(c) for c in ("q_ids", "q", "x_ids", "x"))):
            qi, xi = (np.array(i.values) for i in (q_ids, x_ids))
            q_, x_ = (np.array(m.values).reshape(len(i), -1) for m, i in ((q, qi), (x, xi)))
            if q_.shape[1] != x_.shape[1]:
                continue
            order = np.argsort(xi, kind="stable")  # so that ties go to the lowest id
            xi, x_ = xi[order], x_[order]
            size = (x_ * x_).sum(1)
            for lo in range(0, len(qi), 256):
                some, ids = q_[lo : lo + 256], qi[lo : lo + 256]
                score = np.round((some @ x_.T) / np.sqrt(np.outer((some * some).sum(1), size)), digits)
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                out.append(pa.table({"query": np.repeat(ids, best.shape[1]), "id": xi[best.ravel()], "score": np.take_along_axis(score, best, 1).ravel()}))
        return pa.concat_tables(out)

    pairs = _packs(rows, key, vector, "x", pack).crossJoin(_packs(queries, query_key, query_vector, "q", pack))  # a stated query set, in blocks
    each = pairs.groupBy(F.element_at("q_ids", 1).alias("_q"), F.element_at("x_ids", 1).alias("_x"))
    return top(each.applyInArrow(run, "query long, id long, score double"), "query", "id", k)
