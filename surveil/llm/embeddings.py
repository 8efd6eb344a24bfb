"""Embedding near-dedup by cross-polytope hashing after fast Hadamard rotations.

Vectors are scaled to length one in double precision and padded to a power of two. A
table's hash turns a vector `parts` times (three rounds of random signs and a
Hadamard transform) and takes each turn's nearest signed axis. `parts` follows the number of vectors, so that a bucket
stays small, and `tables` follows from the recall wanted at the threshold. Each vector lives in the bucket of its hash
and visits those of its `probes` next best axes. Pairs of which one lives in a bucket are verified by their cosine.

Equal vectors form a class first and are compared once. A pair that meets more than once is counted where it meets first, which
both sides can tell from their keys; so links are counted in the bucket and never listed. A large bucket is dealt to
blocks, and pairs of blocks to tasks. From each task goes a count per vector and a spanning forest of what it
linked, which become components.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of different lengths
never link. Rows without id are returned with themselves only; rows that share an id count as copies if equal
and otherwise as one vertex. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components, forest
from ._spark import cut, table
from ._text import mix64, stream64

COSINE, RECALL, PROBES, BLOCK = 0.95, 0.999, 2, 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, not scaled."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def keys(x: np.ndarray, tables: int, parts: int, probes: int) -> np.ndarray:
    """(rows, tables, 1 + probes): the key where a vector lives and those it visits."""
    n, d = x.shape
    wide = 1 << max(2, (probes).bit_length(), (d - 1).bit_length())
    base = np.zeros((n, wide))
    base[:, :d] = x
    out = np.zeros((n, tables, 1 + probes), np.uint64)
    rows = np.arange(n)
    for t in range(tables):
        axis, margin, other = [], [], []
        for p in range(parts):
            y = base
            for r in range(3):
                sign = (stream64(1000 + (t * parts + p) * 3 + r, wide) >> np.uint64(63)).astype(float) * 2 - 1
                y = hadamard(y * sign)
            a = np.abs(y)
            near = np.argpartition(-a, probes, axis=1)[:, : probes + 1]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(a, near, 1), 1, kind="stable"), 1)
            signed = near * 2 + (np.take_along_axis(y, near, 1) > 0)
            size = np.take_along_axis(a, near, 1)
            axis.append(signed[:, 0])
            other.append(signed[:, 1:])
            margin.append((size[:, :1] - size[:, 1:]) / np.maximum(size[:, :1], 1e-300))

        def key(axes, t=t):
            k = np.full(n, np.uint64(t + 1))
            for a in axes:
                k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + a.astype(np.uint64))
            return k

        out[:, t, 0] = key(axis)
        gap = np.concatenate(margin, 1)  # the closest calls over all parts are probed
        best = np.argsort(gap, 1, kind="stable")[:, :probes]
        for j in range(probes):
            part, alt = np.divmod(best[:, j], probes)
            axes = [np.where(part == p, other[p][rows, np.where(part == p, alt, 0)], axis[p]) for p in range(parts)]
            out[:, t, 1 + j] = key(axes)
    return out


def _unit(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one in double precision, and which rows they are. All rows have the same length."""
    x = np.array([[math.nan if v is None else v for v in row] for row in col.to_pylist()], float)
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    ok = F.size(v).cast("int") > 0
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    key = F.transform(v, lambda e: F.when(e == 0, F.lit(0.0)).otherwise(e))  # -0.0 is 0.0
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.coalesce(ok & fine, F.lit(False)), key).alias("v")).select("id", "v", F.when(F.col("v").isNotNull(), F.sha2(F.array_join(F.transform("v", lambda e: e.cast("string")), ","), 256)).alias("h"))


def _meet(ka: np.ndarray, kb: np.ndarray) -> np.ndarray:
    """For pairs of (tables, 1 + probes) keys: the first table where they meet, twice that plus 1 if in the second one's home only."""
    tables = ka.shape[1]
    out = np.full(len(ka), 2 * tables)
    for t in range(tables - 1, -1, -1):
        b_visits = (kb[:, t, :] == ka[:, t, :1]).any(1)  # in a's home
        a_visits = (ka[:, t, :] == kb[:, t, :1]).any(1)
        out[a_visits] = 2 * t + 1
        out[b_visits] = 2 * t
    return out


def linked(reps: DataFrame, tables: int, parts: int, probes: int, cosine: float, block: int) -> DataFrame:
    """(id, n, to): per task and vector, the copies it newly links to and a vertex of the forest. reps: id, copies, v."""

    def place(batches):
        for b in batches:
            size = np.array([len(x) for x in b.column(2)])
            for d in np.unique(size).tolist():
                part = b.filter(pa.array(size == d))
                x, _ = _unit(part.column(2))
                k = keys(x, tables, parts, probes) ^ np.uint64(d)
                n = len(x)
                homes = k.reshape(n, -1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(i := pa.array(np.repeat(np.arange(n), homes.shape[1]))), part.column(1).take(i), pa.array(np.tile(np.arange(homes.shape[1]) % (1 + probes) == 0, n)), pa.array(homes.ravel().view(np.int64)), pa.array([r.tobytes() for r in k], pa.binary()).take(i), pa.array([r.tobytes() for r in x], pa.binary()).take(i)], names=["id", "copies", "home", "key", "keys", "x"])

    dealt = reps.mapInArrow(place, "id long, copies long, home boolean, key long, keys binary, x binary")
    sizes = dealt.groupBy("key").agg(F.count("*").alias("size"), F.max("home").alias("any_home")).filter("size > 1 and any_home").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    many = dealt.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block i meets each block j >= i in a task of its own
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "copies", "home", "keys", "x")

    def task(group: tuple, t: pa.Table) -> pa.Table:
        ids, copies, mine = (t[c].to_numpy() for c in ("id", "copies", "mine"))
        home = t["home"].to_numpy()
        here = group[0].as_py()
        i, j = group[1].as_py(), group[2].as_py()
        k = np.frombuffer(b"".join(t["keys"].to_pylist()), np.uint64).reshape(len(ids), tables, 1 + probes)
        x = np.frombuffer(b"".join(t["x"].to_pylist()), float).reshape(len(ids), -1)
        first, second = (mine == i, mine == j)
        left, right = np.flatnonzero(first), np.flatnonzero(second)
        pa_, pb = [], []
        for s in range(0, len(left), 256):
            rows = left[s : s + 256]
            a, b = np.nonzero(x[rows] @ x[right].T >= cosine)
            a, b = rows[a], right[b]
            keep = (home[a] | home[b]) & (ids[a] < ids[b] if i == j else ids[a] != ids[b])
            pa_.append(a[keep])
            pb.append(b[keep])
        a, b = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (pa_, pb))
        a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
        meet = _meet(k[a], k[b])
        at = np.where(meet % 2 == 0, k[a, np.minimum(meet // 2, tables - 1), 0], k[b, np.minimum(meet // 2, tables - 1), 0]).view(np.int64)
        a, b = a[at == here], b[at == here]
        n = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        root = forest(len(ids), a, b)
        some = np.flatnonzero(n > 0)
        return pa.table({"id": ids[some], "n": n[some].astype(np.int64), "to": ids[root[some]]})

    return many.groupBy("key", "i", "j").applyInArrow(task, "id long, n long, to long")


def plan(n: int, dim: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Tables and parts for n vectors: buckets of a few vectors, and the recall wanted at the threshold."""
    parts = max(1, round(math.log(max(n, 2)) / math.log(2 * max(dim, 2))))
    one = 0.72 if cosine >= 0.95 else 0.5  # measured: a pair at the threshold shares a signed axis
    found = 1 - (1 - one**parts) * (1 - one ** max(parts - 1, 1) * (1 - one) * 0.8) ** 2
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - min(found, 0.99)))), parts


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """Every row: vec_id, n_links, component_id, kept."""
    rows = cut(_classes(vectors, id_col, vector_col))
    reps = cut(rows.filter("h is not null and id is not null").groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")))
    n, dim = reps.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    tables, parts = plan(n, dim, cosine, recall)
    found = cut(linked(reps.select("id", "copies", "v"), tables, parts, probes, cosine, block))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    parent = components(found.select(F.col("id").alias("u"), F.col("to").alias("v")))
    class_ = reps.select("h", F.col("id").alias("rep"), "copies").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(parent.withColumnRenamed("id", "rep"), "rep", "left")
    class_ = class_.select("h", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("h")).alias("h")).join(class_, "h", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op7_cross_polytope(spark, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))
