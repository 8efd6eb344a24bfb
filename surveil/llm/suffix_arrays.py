"""Substring dedup by blockwise suffix sorting with a difference cover.

Texts are UTF-8 bytes; a window is `k` of them inside one text. Windows reach the bucket of
their minimiser as packed super-k-mers, and a bucket's suffixes are sorted one block of
minimisers at a time, so memory follows the block and not the corpus:

1. super-k-mers with the same bytes are repeats of one another, and one of them stands for all;
2. suffixes that begin at the others' windows are sorted by their first bytes (ranks of V bytes, by doubling);
3. ties are resolved by ranks of a cover sample, precomputed for the block: positions whose residue modulo V is in a difference cover.
   For any two suffixes some shift brings both onto the sample, so one comparison of ranks stands for hundreds of bytes.
   Groups split three ways around a pivot until each holds equal windows only.

Windows that start in more than one place, in any text, are marked, and each byte that a marked window
covers is removed. Windows are judged on the input, not on what is left. Null texts have no bytes; repeated rows
are copies of one another; texts under k bytes stay whole; a null id is an id like any other. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import table
from ._text import BYTE_VALUE, grams, spread
from ._windows import NO_ID, Bucket, Scheme, Units, buckets, gather, hot_minimisers, hot_spans, inflate, keyed, merged, per_bucket, with_spans

WINDOW, MINIMISER, HOT_RUNS = 400, 48, 20_000
BLOCK = 3 << 20


def cover(r: int) -> tuple[int, np.ndarray]:
    """V and a difference cover of V by the construction of Colbourn and Ling: 6 r + 4 residues for V up to 24 r^2 + 36 r + 13."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.append(0, np.cumsum(steps))


class Cover:
    """A difference cover and, for residues a and b, the least shift that brings both into it."""

    def __init__(self, r: int):
        self.v, at = cover(r)
        self.held = np.zeros(self.v, bool)
        self.held[at % self.v] = True
        v = np.arange(self.v)
        self.shift = np.array([[np.argmax(self.held[(a + v) % self.v] & self.held[(b + v) % self.v]) for b in v] for a in v], np.int32)


_COVERS = [Cover(0), Cover(1)]  # of 13 and of 73


def _ranks(key: np.ndarray) -> np.ndarray:
    """Each key's place among the distinct keys."""
    order = np.argsort(key)
    new = np.zeros(len(key), np.int32)
    if len(key):
        s = key[order]
        new[1:] = s[1:] != s[:-1]
    out = np.empty(len(key), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _ranks((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))


def prefix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the `length` bytes from each position; the text is followed by zeros."""
    n = len(text)
    pad = np.zeros(n + 8, np.uint8)
    pad[:n] = text
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | pad[k : k + n]
    rank, size = _ranks(word), 8
    while size < length:
        step = min(size, length - size)
        ahead = np.full(n, 0, np.int32)  # beyond the end: as if zeros
        ahead[: max(0, n - step)] = rank[step:] + 1
        rank, size = _pair(rank, ahead), size + step
    return rank


def sample_ranks(rank: np.ndarray, c: Cover, doublings: int) -> np.ndarray:
    """Ranks of the V * 2^doublings bytes from each position of the cover sample; 0 elsewhere."""
    at = np.flatnonzero(c.held[np.arange(len(rank)) % c.v])
    out = np.zeros(len(rank), np.int32)
    now, size = _ranks(rank[at].astype(np.uint64)) + 1, c.v
    for _ in range(doublings):
        out[at] = now
        ahead = np.zeros(len(at), np.int32)
        ok = at + size < len(rank)
        ahead[ok] = out[at[ok] + size]
        now, size = _pair(now, ahead) + 1, size * 2
    out[at] = now
    return out


def sort_windows(text: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of k bytes in sorted groups: an order of `start`, and the group of each in that order; equal windows share a group."""
    c = _COVERS[k >= 219]
    V, doublings = c.v, 0  # noqa: N806
    if k < 3 * V:
        raise ValueError(f"windows must have {3 * V} bytes at least")
    rank = prefix_ranks(text, V)
    while V << (doublings + 1) <= k - V:  # a longer rank could reach beyond the window
        doublings += 1
    reach = V << doublings
    # the cover must span what ranks of prefixes at these places leave open
    firm = [0, *range(V, k - V - reach + 1, V)]
    ahead = firm[-1] + V - 1  # shifts from here on: the V residues follow
    ahead = min(ahead, k - reach - V + 1)
    ends = [*range(ahead + reach, k - V, V), k - V]
    group = rank[start]
    for p in sorted({*firm[1:], *(max(0, ahead - 1),), *ends} - {0}):
        group = _pair(group, rank[start + p])
    order = np.argsort(group, kind="stable")
    group = group[order]
    sample = sample_ranks(rank, c, doublings)
    place = start[order] + ahead
    open_ = np.ones(len(order), bool)
    while True:
        size = np.bincount(group)
        live = np.flatnonzero(open_ & (size[group] > 1))
        if not len(live):
            break
        g = group[live]
        head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        many = np.diff(np.append(head, len(g)))
        pivot = np.repeat(place[live][head + many // 2], many)
        here = place[live]
        shift = c.shift[here % V, pivot % V]
        side = np.sign(sample[here + shift] - sample[pivot + shift]) + 1
        move = np.lexsort((side, g))
        order[live], place[live], side = order[live][move], here[move], side[move]
        cell = np.zeros(len(order), np.int64)
        cell[live] = side
        open_[live] = side != 1  # equal to the pivot: done
        both = group.astype(np.int64) * 3 + cell
        group = (np.cumsum(np.append(0, both[1:] != both[:-1]))).astype(np.int32)
    return order, group


def _repeat_inside(b: Bucket, m: int) -> np.ndarray:
    """Super-k-mers in which the minimiser occurs more than once: only these can repeat a window of their own."""
    out, off, lo = np.zeros(len(b.mini), bool), b.off, 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 20), "right")) - 1)
        at, g = grams(BYTE_VALUE[1][b.data[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo], m)
        run = np.searchsorted(off[lo:hi] - off[lo], at, "right") - 1
        out[lo:hi] = np.bincount(run[g == b.mini[lo:hi][run]], minlength=hi - lo) > 1
        lo = hi
    return out


def repeated_windows(b: Bucket, k: int, m: int, block: int = BLOCK) -> tuple[np.ndarray, ...]:
    """Spans (doc, text_key, first byte, end byte) of the bucket's windows that start in more than one place."""
    if not len(b.mini):
        return (np.zeros(0, np.int64),) * 4
    _, of, many = np.unique(b.mini, return_inverse=True, return_counts=True)
    inside = _repeat_inside(b, m)
    taken = np.flatnonzero((many[of] > 1) | inside)
    b, inside = b.take(taken), inside[taken]
    raw, off = b.data.tobytes(), b.off
    seen: dict[bytes, int] = {}
    stands = np.array([seen.setdefault(raw[off[i] : off[i + 1]], i) for i in range(len(b.mini))], np.int64)
    copies = np.bincount(stands, minlength=len(stands))
    dup = [np.ones(n, bool) if copies[s] > 1 else None for n, s in zip(b.windows.tolist(), stands.tolist())]
    single = np.flatnonzero(stands == np.arange(len(stands)))
    _, of, many = np.unique(b.mini[single], return_inverse=True, return_counts=True)
    single = single[(many[of] > 1) | inside[single]]  # where all of a minimiser are the same bytes, none is left to compare
    single = single[np.argsort(b.mini[single], kind="stable")]
    volume = np.cumsum(b.size[single])
    edge = np.append(np.flatnonzero(np.append(True, b.mini[single][1:] != b.mini[single][:-1])), len(single)) if len(single) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(single):
        upto = np.searchsorted(volume, (volume[lo - 1] if lo else 0) + block, "right")
        hi = int(max(edge[np.searchsorted(edge, upto, "right") - 1], edge[np.searchsorted(edge, lo, "right")]))
        part = single[lo:hi]
        lo = hi
        size = b.size[part]
        begin = np.cumsum(size) - size
        run, place = spread(b.windows[part])
        start = begin[run] + place
        order, group = sort_windows(gather(b.data, off[:-1][part], size), start, k)
        twice = np.zeros(len(start), bool)
        twice[order] = np.bincount(group)[group] > 1
        for j in np.unique(run[twice]).tolist():
            i = part[j]
            if dup[i] is None:
                first = int(np.searchsorted(run, j))
                dup[i] = twice[first : first + b.windows[i]]
    out = []
    for i, flags in enumerate(dup):
        if flags is not None:
            edge_ = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
            out += [(b.doc[i], b.text[i], b.pos[i] + s, b.pos[i] + e + k - 1) for s, e in edge_.reshape(-1, 2).tolist()]
    return tuple(np.array(out, np.int64).reshape(-1, 4).T)


def byte_units(data: np.ndarray, off: np.ndarray) -> Units:
    at = np.arange(len(data))
    return Units(data, BYTE_VALUE[1][data], at, at + 1, off)


def _more_than_once(windows: DataFrame) -> DataFrame:
    n = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return windows.join(n, ["h1", "h2"])


def removed_spans(texts: DataFrame, k: int = WINDOW, m: int = MINIMISER, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc, text_key, s, e): bytes to remove."""
    scheme = Scheme(byte_units, k, m, 1 << 20, hot_runs)
    hot = hot_minimisers(texts, scheme)
    spans = per_bucket(buckets(texts, scheme, hot), lambda b: repeated_windows(b, k, m))
    return spans.unionByName(hot_spans(texts, scheme, hot, _more_than_once)) if len(hot) else spans


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = MINIMISER, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Every row: doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    texts = keyed(docs, id_col, text_col)

    def run(batches):
        for b in batches:
            size, gone, count, kept = [], [], [], []
            for z, spans in zip(b.column(1), b.column(2).to_pylist()):
                raw = inflate(z.as_py())
                cut = merged(((x["s"], x["e"]) for x in spans or ()), len(raw))
                last, out = 0, []
                for s, e in cut:
                    out.append(raw[last:s])
                    last = e
                out.append(raw[last:])
                kept.append(b"".join(out))
                size.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                count.append(len(cut))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, count)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = with_spans(texts, removed_spans(texts, k, m, hot_runs)).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op5_suffix_blocks(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
