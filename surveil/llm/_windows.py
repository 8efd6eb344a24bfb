"""Super-k-mers: consecutive fixed-length windows that share a minimiser, packed as one string.

The minimiser of a window of k units is the smallest hash of its runs of m units. Equal
windows have equal minimisers, so a bucket keyed by the minimiser holds all copies of each of its windows. A
bucket gets one compressed blob per batch, not one row per window.

A minimiser with more than max(HOT_RUNS, all runs / HOT_KEYS) super-k-mers would overload its bucket. Such keys (HOT_KEYS at
most) are found by a count first; their windows go by their own 128-bit hash instead, combined before the shuffle and joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, shuffle_parts
from ._text import doc_chunks, grams, spread, words_of

HOT_KEYS = 1_000_000
NO_ID = (1 << 63) - 1  # stands for a null id: after all others
_ZSTD = pa.Codec("zstd", 3)
_FLUSH = 24 << 20  # packed bytes held before blobs are sent
BUCKETS_PER_PARTITION = 16


@dataclass
class Units:
    """Units of a run of texts: their hash values, byte spans in data, and each text's first unit."""

    data: np.ndarray
    value: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


@dataclass
class Runs:
    """Super-k-mers: text row, first unit (in the batch), number of windows, minimiser."""

    row: np.ndarray
    unit: np.ndarray
    windows: np.ndarray
    mini: np.ndarray


def super_kmers(u: Units, k: int, m: int) -> Runs:
    size = np.diff(u.first)
    count = np.maximum(size - k + 1, 0)
    row, place = spread(count)
    if not len(row):
        z = np.zeros(0, np.int64)
        return Runs(z, z, z, z.astype(np.uint64))
    at = u.first[row] + place
    _, g = grams(u.value, np.array([0, len(u.value)]), m)
    low, width, span = g, k - m + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    mini = low[at]
    head = np.flatnonzero(np.concatenate([[True], (mini[1:] != mini[:-1]) | (row[1:] != row[:-1])]))
    return Runs(row[head], at[head], np.diff(np.append(head, len(row))), mini[head])


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many spans end to end."""
    if not len(start):
        return np.zeros(0, np.uint8)
    step = np.ones(int(size.sum()), np.int32 if len(data) < 1 << 31 else np.int64)
    begin = np.cumsum(size) - size
    step[0] = start[0]
    step[begin[1:]] = start[1:] - (start[:-1] + size[:-1] - 1)
    return data[np.cumsum(step)]


_FIELDS = (("doc", np.int64), ("text", np.int64), ("pos", np.int64), ("windows", np.int64), ("mini", np.uint64), ("size", np.int64))


@dataclass
class Bucket:
    """Super-k-mers of one bucket: fields by run, and the packed bytes end to end."""

    doc: np.ndarray
    text: np.ndarray
    pos: np.ndarray
    windows: np.ndarray
    mini: np.ndarray
    size: np.ndarray
    data: np.ndarray

    @property
    def off(self) -> np.ndarray:
        return np.append(0, np.cumsum(self.size))

    def pack(self) -> bytes:
        raw = b"".join([np.int64(len(self.doc)).tobytes(), *(getattr(self, f).astype(t).tobytes() for f, t in _FIELDS), self.data.tobytes()])
        return np.int64(len(raw)).tobytes() + _ZSTD.compress(raw, asbytes=True)

    @staticmethod
    def unpack(blobs: list[bytes]) -> Bucket:
        parts: list[list[np.ndarray]] = [[] for _ in range(7)]
        for b in blobs:
            raw = _ZSTD.decompress(b[8:], int(np.frombuffer(b[:8], np.int64)[0]), asbytes=True)
            n, at = int(np.frombuffer(raw[:8], np.int64)[0]), 8
            for part, (_, t) in zip(parts, _FIELDS):
                part.append(np.frombuffer(raw, t, n, at))
                at += 8 * n
            parts[6].append(np.frombuffer(raw, np.uint8, offset=at))
        return Bucket(*map(np.concatenate, parts))

    def take(self, which: np.ndarray) -> Bucket:
        return Bucket(*(getattr(self, f)[which] for f, _ in _FIELDS), gather(self.data, self.off[which], self.size[which]))


@dataclass
class Scheme:
    """What a window is. units(data, off) cuts texts to units; a window has k of them, a minimiser m."""

    units: Callable[[np.ndarray, np.ndarray], Units]
    k: int
    m: int
    chunk: int  # bytes of text worked on at once
    hot_runs: int


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text_key, text): a row's id and a hash of its text tell rows apart; rows equal in both fare alike."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _batches(batches, scheme: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray, Units, Runs]]:
    for b in batches:
        doc, key = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for lo, hi, data, off in doc_chunks(b.column(2), scheme.chunk):
            u = scheme.units(data, off)
            yield doc[lo:hi], key[lo:hi], u, super_kmers(u, scheme.k, scheme.m)


def hot_minimisers(texts: DataFrame, scheme: Scheme, hot_keys: int = HOT_KEYS) -> np.ndarray:
    """Sorted minimisers of too many super-k-mers; at most hot_keys of them."""

    def run(batches):
        for _, _, _, r in _batches(batches, scheme):
            mini, n = np.unique(r.mini, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(mini.view(np.int64)), pa.array(n)], names=["mini", "n"])

    counts = cut(texts.mapInArrow(run, "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n")).filter(F.col("n") > scheme.hot_runs))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return np.zeros(0, np.uint64)
    # those left out of the sum have few runs each; the bound on the number of keys holds all the more
    hot = counts.filter(F.col("n") > max(scheme.hot_runs, total // hot_keys)).select("mini").toArrow()["mini"]
    return np.sort(hot.to_numpy().view(np.uint64))


def _is_in(x: np.ndarray, few: np.ndarray) -> np.ndarray:
    if not len(few):
        return np.zeros(len(x), bool)
    return few[np.minimum(np.searchsorted(few, x), len(few) - 1)] == x


def buckets(texts: DataFrame, scheme: Scheme, hot: np.ndarray) -> DataFrame:
    """(bucket, blob), dealt by bucket and sorted: all super-k-mers but those of hot minimisers."""
    parts = shuffle_parts(texts.sparkSession)
    n = np.uint64(parts * BUCKETS_PER_PARTITION)

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        bytes_held = 0

        def flush():
            b = Bucket(*map(np.concatenate, zip(*held)))
            which = (b.mini % n).astype(np.int64)
            order = np.argsort(which, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(which[order]) != 0))
            ids, blobs = which[order][cuts], [b.take(x).pack() for x in np.split(order, cuts[1:])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for doc, key, u, r in _batches(batches, scheme):
            cold = np.flatnonzero(~_is_in(r.mini, hot))
            if not len(cold):
                continue
            row, unit, windows = r.row[cold], r.unit[cold], r.windows[cold]
            start = u.start[unit]
            size = u.end[unit + windows + scheme.k - 2] - start
            held.append((doc[row], key[row], unit - u.first[row], windows, r.mini[cold], size, gather(u.data, start, size)))
            bytes_held += int(size.sum())
            if bytes_held > _FLUSH:
                yield flush()
                bytes_held = 0
        if held:
            yield flush()

    return texts.mapInArrow(run, "bucket int, blob binary").repartition(parts, "bucket").sortWithinPartitions("bucket")


def per_bucket(dealt: DataFrame, work: Callable[[Bucket], tuple[np.ndarray, ...]]) -> DataFrame:
    """Spans (doc, text_key, s, e) in units that work() finds in each bucket, one bucket in memory at a time."""

    def spans(blobs):
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in work(Bucket.unpack(blobs))], names=["doc", "text_key", "s", "e"])

    def run(batches):
        at, blobs = None, []
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if k != at and blobs:
                    yield spans(blobs)
                    blobs = []
                at = k
                blobs.append(blob.as_py())
        if blobs:
            yield spans(blobs)

    return dealt.mapInArrow(run, "doc long, text_key long, s long, e long")


def hot_spans(texts: DataFrame, scheme: Scheme, hot: np.ndarray, repeated: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Spans of the windows of hot minimisers that repeated() keeps.

    repeated() gets one row per window (h1, h2, doc, text_key, pos) and gives those to remove.
    """

    def run(batches):
        for doc, key, u, r in _batches(batches, scheme):
            which = np.flatnonzero(_is_in(r.mini, hot))
            group, place = spread(r.windows[which])
            at = r.unit[which][group] + place
            row = r.row[which][group]
            if not len(at):
                continue
            whole = np.array([0, len(u.value)])
            h1, h2 = (grams(u.value, whole, scheme.k, seed)[1][at].view(np.int64) for seed in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, doc[row], key[row], at - u.first[row])], names=["h1", "h2", "doc", "text_key", "pos"])

    found = repeated(texts.mapInArrow(run, "h1 long, h2 long, doc long, text_key long, pos long"))
    return found.select("doc", "text_key", F.col("pos").alias("s"), (F.col("pos") + scheme.k).alias("e"))


def deflate(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def inflate(z: bytes) -> bytes:
    return _ZSTD.decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True)


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, z, spans): each row of texts, its text deflated, and the spans to remove from it, in no order, perhaps overlapping."""

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([deflate(t.as_py().encode()) for t in b.column(2)], pa.binary())], names=["doc", "text_key", "z"])

    by_doc = spans.groupBy("doc", "text_key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    packed = texts.select("doc", "text_key", "text").mapInArrow(pack, "doc long, text_key long, z binary")
    return packed.join(by_doc, ["doc", "text_key"], "left").select("doc", "z", "spans")


def merged(spans, n: int) -> list[tuple[int, int]]:
    """Sorted spans joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, step: int = 1 << 22) -> np.ndarray:
    """Whether the spans of the given sizes at a and b hold the same bytes."""
    out = np.ones(len(a), bool)
    lo = 0
    ends = np.cumsum(size)
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, "right")))
        differ = gather(data, a[lo:hi], size[lo:hi]) != gather(data, b[lo:hi], size[lo:hi])
        begin = np.cumsum(size[lo:hi]) - size[lo:hi]
        out[lo:hi] = ~np.logical_or.reduceat(differ, begin)
        lo = hi
    return out


def word_units(data: np.ndarray, off: np.ndarray) -> Units:
    w = words_of(data, off).canonical()
    return Units(w.data, w.hashes(), w.start, w.end, w.first)
