"""Benchmark decontamination by greedy string tiling.

Tokens are runs of ASCII letters and digits and of non-ASCII bytes, A-Z lower-cased.
Token runs of length `seed` that a document shares with a benchmark item (the
seeds) nominate pairs; a pair whose seeds cover less than `threshold` of the item
cannot reach it and is dropped. For the others, tiles are laid: Karp-Rabin hashes
of ever shorter windows find all common runs outside earlier tiles, and the
longest are marked first, so that no token of either side is in two tiles.
The share of the item's tokens in tiles is its coverage; order of tiles is
free, so a reordered passage is caught.

The benchmark is dealt to blocks of about `block_tokens` tokens, each sent to all
tasks in turn, so memory is bounded whatever its size; the documents
never move. Nulls and empty texts match nothing, items of fewer than `seed` tokens are left
out, repeated rows of either table give repeated rows, other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import table
from ._text import IS_MARK, LOWER, Rolling, doc_chunks, grams, spread, text_bytes, words_of

SEED, THRESHOLD, BLOCK_TOKENS = 5, 0.5, 1_000_000
_WINDOW = Rolling(31)
_PAIRS = 1 << 21  # window pairs held at once


def token_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = words_of(LOWER[data], off, IS_MARK)
    return w.hashes(), w.first


def _common_runs(p: np.ndarray, t: np.ndarray, p_free: np.ndarray, t_free: np.ndarray, s: int) -> np.ndarray:
    """Rows (length, start in p, start in t) of all maximal common runs of at least s unmarked tokens."""

    def windows(x, free):
        taken = np.zeros(len(x) + 1, np.int64)
        np.cumsum(~free, out=taken[1:])
        at = np.flatnonzero(taken[s:] == taken[:-s])
        return at, _WINDOW.of(_WINDOW.sums(x), at, at + s)

    if min(len(p), len(t)) < s:
        return np.zeros((0, 3), np.int64)
    pa_, ph = windows(p, p_free)
    ta, th = windows(t, t_free)
    ta, th = ta[keep := np.isin(th, ph)], th[keep]
    order = np.argsort(ph, kind="stable")
    pa_, ph = pa_[order], ph[order]
    found = [np.zeros((0, 3), np.int64)]
    step = max(1, _PAIRS // max(1, len(p)))
    for k in range(0, len(ta), step):
        at, h = ta[k : k + step], th[k : k + step]
        lo, hi = np.searchsorted(ph, h), np.searchsorted(ph, h, "right")
        which, place = spread(hi - lo)
        x, y = pa_[lo[which] + place], at[which]
        order = np.lexsort((x, y - x))
        x, y = x[order], y[order]
        if len(x):
            head = np.flatnonzero(np.append(True, (np.diff(x) != 1) | (np.diff(y) != 1)))
            found.append(np.column_stack([np.diff(np.append(head, len(x))) + s - 1, x[head], y[head]]))
    runs = np.concatenate(found)
    if len(found) > 2:  # runs cut at a block's edge join again
        runs = runs[np.lexsort((runs[:, 1], runs[:, 2] - runs[:, 1]))]
        joins = (runs[1:, 2] - runs[1:, 1] == runs[:-1, 2] - runs[:-1, 1]) & (runs[1:, 1] == runs[:-1, 1] + runs[:-1, 0] - s + 1)
        head = np.flatnonzero(np.append(True, ~joins))
        last = np.append(head[1:], len(runs)) - 1
        runs = np.column_stack([runs[last, 1] + runs[last, 0] - runs[head, 1], runs[head, 1:]])
    same = [np.array_equal(p[x : x + n], t[y : y + n]) for n, x, y in runs]
    return runs[np.array(same, bool)] if len(runs) else runs


def tile(p: np.ndarray, t: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, start in p, start in t) of at least `least` tokens, longest first."""
    p_free, t_free = np.ones(len(p), bool), np.ones(len(t), bool)
    tiles, s = [], least
    while s * 2 <= len(p):
        s *= 2
    while True:
        runs = _common_runs(p, t, p_free, t_free, s)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], -runs[:, 0]))]
        cut = False
        for n, x, y in runs.tolist():
            if p_free[x : x + n].all() and t_free[y : y + n].all():
                p_free[x : x + n] = t_free[y : y + n] = False
                tiles.append((n, x, y))
            else:
                cut = True  # what is left of it may still be long enough
        if len(runs) and cut:
            continue
        if s == least:
            return tiles
        s = max(least, s // 2)


class Items:
    """A block of benchmark items as token hashes, with an index of their seeds."""

    def __init__(self, ids: list, data: np.ndarray, off: np.ndarray, seed: int):
        self.ids, self.seed = ids, seed
        self.tokens, self.first = token_hashes(data, off)
        self.size = np.diff(self.first)
        at, h = grams(self.tokens, self.first, seed)
        order = np.argsort(h, kind="stable")
        self.at, self.h = at[order], h[order]
        self.item = np.searchsorted(self.first, self.at, "right") - 1

    def matches(self, data: np.ndarray, off: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """(row, item, tokens in tiles, tiles, coverage) of the pairs at or above the threshold."""
        tokens, first = token_hashes(data, off)
        at, h = grams(tokens, first, self.seed)
        lo = np.searchsorted(self.h, h)
        hit = np.flatnonzero((lo < len(self.h)) & (self.h[np.minimum(lo, len(self.h) - 1)] == h)) if len(self.h) else np.zeros(0, np.int64)
        if not len(hit):
            return []
        doc = np.searchsorted(first, at[hit], "right") - 1
        key, row = np.unique(np.column_stack([doc.astype(np.uint64), h[hit]]), axis=0, return_index=True)
        lo = lo[hit][row]
        which, place = spread(np.searchsorted(self.h, key[:, 1], "right") - lo)
        x = lo[which] + place
        pair = key[which, 0].astype(np.int64) * len(self.ids) + self.item[x]
        order = np.lexsort((self.at[x], pair))
        pair, start = pair[order], self.at[x][order]
        gain = np.full(len(pair), self.seed)  # tokens that each seed newly covers
        gain[1:] = np.where(pair[1:] == pair[:-1], np.minimum(np.diff(start), self.seed), self.seed)
        head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        out = []
        for k, most in zip(pair[head].tolist(), np.add.reduceat(gain, head).tolist()):
            d, i = divmod(k, len(self.ids))
            if most >= threshold * self.size[i]:
                tiles = tile(self.tokens[self.first[i] : self.first[i + 1]], tokens[first[d] : first[d + 1]], self.seed)
                inside = sum(n for n, _, _ in tiles)
                if inside >= threshold * self.size[i]:
                    out.append((d, i, inside, len(tiles), inside / int(self.size[i])))
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", seed: int = SEED, block_tokens: int = BLOCK_TOKENS):
    """The benchmark in blocks whose size is known before any of them is fetched."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // (6 * block_tokens)) or 1
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        yield Items(part["item_id"].to_pylist(), *text_bytes(part["text"]), seed)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED, threshold: float = THRESHOLD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Contaminated pairs: doc_id, item_id, item_tokens, matched_tokens, n_tiles, coverage."""
    schema = "doc_id long, item_id long, item_tokens long, matched_tokens long, n_tiles long, coverage double"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def search(items: Items) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches):
            items = sent.value
            for b in batches:
                ids = b.column(0)
                for lo, _, data, off in doc_chunks(b.column(1)):
                    found = items.matches(data, off, threshold)
                    if found:
                        d, i, inside, n, share = zip(*found)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([lo + x for x in d])), pa.array([items.ids[x] for x in i], pa.int64()), pa.array([int(items.size[x]) for x in i]), pa.array(inside), pa.array(n), pa.array(share)], names=["doc_id", "item_id", "item_tokens", "matched_tokens", "n_tiles", "coverage"])

        return texts.mapInArrow(run, schema)

    found = [search(x) for x in blocks(benchmark, item_col, item_text_col, seed, block_tokens)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op1_greedy_tiling(spark, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that overlap a benchmark item; no row moves."""
    schema, place = docs.schema, docs.columns.index("text")
    for items in blocks(benchmark, seed=seed):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            for b in batches:
                for lo, hi, data, off in doc_chunks(b.column(place)):
                    keep = np.ones(hi - lo, bool)
                    keep[[d for d, *_ in sent.value.matches(data, off, threshold)]] = False
                    yield b.slice(lo, hi - lo).filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
