"""Joins that Spark has no operator for, as equi-joins and windows that shuffle on a key and never pair everything with everything."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, take: list[str]) -> DataFrame:
    """left with the latest row of right at or before left_time: both sides in one sorted stream per key, the last value carried on."""
    a = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), *(F.lit(None).cast(right.schema[c].dataType).alias(f"_r_{c}") for c in take))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), *(F.col(c).alias(f"_r_{c}") for c in take))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct(*(F.col(f"_r_{c}").alias(c) for c in take))), ignorenulls=True).over(w)
    return both.withColumn("_m", last).filter("_side = 1").select(*left.columns, *(F.col("_m")[c].alias(c) for c in take))


def within(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, reach: int) -> DataFrame:
    """Pairs whose integer positions differ by reach at most, of equal keys: each left row goes to its cell and both neighbours."""
    cell = F.floor(F.col(left_pos) / reach)
    a = left.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    b = right.withColumn("_cell", F.floor(F.col(right_pos) / reach))
    return a.join(b, [*keys, "_cell"]).filter(F.abs(F.col(left_pos) - F.col(right_pos)) <= reach).drop("_cell")


def near_places(left: DataFrame, right: DataFrame, la: str, lo: str, la2: str, lo2: str, high: float, wide: float, near: Column) -> DataFrame:
    """Pairs of distinct places of left and right (columns la and lo of both; right's come as la2 and lo2) for which `near` holds.

    No pair that is near may be further apart than `high` degrees of latitude or `wide` of longitude: the cells that places meet in.
    """
    cell = lambda c, size: F.floor(F.col(c) / size)
    around = F.explode(F.array(*(F.struct((cell(la, high) + i).alias("i"), (cell(lo, wide) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = left.select(la, lo).distinct().select(la, lo, around.alias("_c")).select(la, lo, F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j"))
    b = right.select(F.col(la).alias(la2), F.col(lo).alias(lo2)).distinct().withColumns({"_i": cell(la2, high), "_j": cell(lo2, wide)})
    return a.join(b, ["_i", "_j"]).filter(near).drop("_i", "_j")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int) -> DataFrame:
    """An inner join in which each key of left is spread over so many tasks, equal rows too; right is repeated as often.

    Both sides are shuffled: Spark's estimate of right's size leaves its repeats out, so it would be sent whole through the driver."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns, F.monotonically_increasing_id()), F.lit(salts)))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b.hint("merge"), [key, "_salt"]).drop("_salt")


def split_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.05, salts: int = 16) -> DataFrame:
    """Rows of keys that hold more than `share` of left are joined salted, the others plainly. At most 1 / share keys are hot."""
    total = left.count()
    hot = [r[0] for r in left.groupBy(key).count().filter(F.col("count") > share * total).select(key).collect()]
    if not hot:
        return left.join(right, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.filter(~is_hot).join(right.filter(~is_hot), key).unionByName(salted_join(left.filter(is_hot), right.filter(is_hot), key, salts))


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity 0..100 of two names, whatever the order of their words."""
    x, y = _sorted_words(a), _sorted_words(b)
    size = F.greatest(F.length(x), F.length(y), F.lit(1))
    return 100.0 * (1 - F.levenshtein(x, y) / size)


# ---------------------------------------------------------------- similar names

_SLOTS = 4096


def _sorted_words(c: Column) -> Column:
    x = F.lower(F.trim(c))
    return F.when(~x.rlike(r"\s"), x).otherwise(F.array_join(F.array_sort(F.split(x, r"\s+")), " "))


def _met(left: DataFrame, right: DataFrame, keys: list[str], left_name: str, right_name: str, off: float, q: int) -> tuple[DataFrame, DataFrame]:
    """Both sides, each row once for each length that the other name may have and each of its rare runs of q letters; pairs meet by keys, lengths and run."""

    def worded(df: DataFrame, name: str) -> DataFrame:
        x = F.concat(F.lit("\u0001" * (q - 1)), _sorted_words(F.col(name)))
        size = F.length(x) - (q - 1)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(x, i, F.lit(q)))
        return df.filter(F.col(name).isNotNull()).select("*", _sorted_words(F.col(name)).alias("_x"), size.alias("_size"), runs.alias("_runs"))

    a, b = worded(left, left_name), worded(right, right_name)
    slot = lambda g: F.pmod(F.xxhash64(g), F.lit(_SLOTS)).cast("int")
    found = {r.s: r.n for r in a.select("_runs").unionByName(b.select("_runs")).select(F.explode("_runs").alias("g")).groupBy(slot(F.col("g")).alias("s")).agg(F.count("*").alias("n")).collect()}
    sizes = sorted({r[0] for d in (a, b) for r in d.select("_size").distinct().collect()})
    common = F.broadcast(left.sparkSession.createDataFrame([([found.get(k, 0) for k in range(_SLOTS)], sizes)], "_often array<long>, _sizes array<int>"))

    def dealt(df: DataFrame, side: str) -> DataFrame:
        tokens = F.array_sort(F.transform("_runs", lambda g: F.struct(F.element_at("_often", slot(g) + 1).alias("n"), g.alias("g"))))
        longer = lambda p: F.greatest(p, F.col("_size"))
        others = F.filter("_sizes", lambda p: F.abs(p - F.col("_size")) <= F.floor(longer(p) * off + 1e-9))
        d = df.crossJoin(common).withColumn("_tokens", F.transform(tokens, lambda x: x["g"])).withColumn("_other", F.explode(others))  # common is one row
        edits = F.floor(longer(F.col("_other")) * off + 1e-9).cast("int")
        # where edits can touch every run, all names of these lengths meet
        rare = F.when(q * F.col("_edits") < longer(F.col("_other")), F.array_distinct(F.slice("_tokens", F.lit(1), q * F.col("_edits") + 1))).otherwise(F.array(F.lit("")))
        d = d.withColumn("_edits", edits).withColumn("_rare", rare).withColumn("_g", F.explode("_rare"))
        mine, other = ("_size", "_other") if side == "a" else ("_other", "_size")
        keep = [F.col(c) for c in df.columns if c not in ("_x", "_size", "_runs")]
        extra = [F.col("_x").alias("_x" if side == "a" else "_y"), F.col("_rare").alias(f"_rare_{side}")]
        return d.select(*keep, *extra, F.col(mine).alias("_size_a"), F.col(other).alias("_size_b"), "_g", *(["_edits"] if side == "a" else []))

    return dealt(a, "a"), dealt(b, "b")


def similar_candidates(left: DataFrame, right: DataFrame, keys: list[str], left_name: str, right_name: str, least: float = 85.0, only: str = "true") -> DataFrame:
    """Pairs of equal keys, for which `only` holds, whose names can agree by `least` of 100; none that do is missing. A pair may come more than once.

    Names that are t edits apart at most share one of their q * t + 1 rarest runs of q letters, and t follows from their lengths. So rows meet by
    lengths and rare runs, not by key alone. Runs of two or of three letters, whichever make fewer rows meet. Adds _x, _y (sorted words), _edits (t)
    and the run they met by. Rarity is counted in slots by a hash of the run: 4096 numbers and the lengths go through the driver, whatever the names.
    """
    by = [*keys, "_size_a", "_size_b", "_g"]
    best, fewest = None, None
    for q in (2, 3):
        a, b = _met(left, right, keys, left_name, right_name, 1 - least / 100, q)
        counts = [d.groupBy(*by).agg(F.count("*").alias(n)) for d, n in ((a, "_na"), (b, "_nb"))]
        n = counts[0].join(counts[1], by).agg(F.coalesce(F.sum(F.col("_na") * F.col("_nb")), F.lit(0))).first()[0]
        if fewest is None or n < fewest:
            best, fewest = (a, b), n
    return best[0].join(best[1], by).filter(only).drop("_size_a", "_size_b")


#: Names of equal keys are compared outright where that makes so few pairs a row, and so few pairs and rows of one side in one cell of keys.
PAIRS_A_ROW, PAIRS_A_CELL, ROWS_A_CELL = 200, 20_000_000, 10_000


def _few_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> bool:
    counts = [d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in ((left, "_na"), (right, "_nb"))]
    both = counts[0].join(counts[1], keys, "full").fillna(0, ["_na", "_nb"])
    pairs = F.col("_na").cast("double") * F.col("_nb")
    most, total, rows, side = both.agg(F.max(pairs), F.sum(pairs), F.sum(F.col("_na") + F.col("_nb")), F.max(F.greatest("_na", "_nb"))).first()
    return most is None or (most <= PAIRS_A_CELL and side <= ROWS_A_CELL and total <= PAIRS_A_ROW * rows)


#: Pairs of words that a task compares at once, and those whose results it gives back at once.
_AT_ONCE, _A_BATCH = 1 << 18, 4_000_000


def _distances(x: list[np.ndarray], y: list[np.ndarray], most: int) -> np.ndarray:
    """Edit distances of pairs of words, given as the columns of their letters; more than `most` where they are beyond it."""
    m, n, pairs = len(x), len(y), len((x or y or [()])[0])
    kind = np.uint8 if m + n < 250 else np.int32
    full = lambda v: np.full(pairs, v, kind)
    row = {j: full(j) for j in range(min(n, most) + 1)}
    for i in range(1, m + 1):
        last, row = row, {}
        for j in range(max(0, i - most), min(n, i + most) + 1):
            if j == 0:
                row[j] = full(i)
                continue
            d = last[j - 1] + (x[i - 1] != y[j - 1])
            for beside in (last.get(j), row.get(j - 1)):
                if beside is not None:
                    np.minimum(d, beside + kind(1), out=d)
            row[j] = d
    return row[n]


def _blocks(work: np.ndarray, most: int) -> list[int]:
    """Edges of runs of about so much work each."""
    return np.flatnonzero(np.diff(np.cumsum(work) // most, prepend=-1, append=-1)).tolist()


class _Side:
    """Of lists of words, given as codes, each list's different words in order, and the places of each."""

    def __init__(self, lists: pa.ListArray, codes: np.ndarray, kinds: int):
        n = np.diff(lists.offsets.to_numpy())
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = np.repeat(np.arange(len(n)), n) * kinds + codes
        order = np.argsort(key, kind="stable")
        found, self.at, self.times = np.unique(key[order], return_index=True, return_counts=True)
        self.places, self.code = place[order], found % kinds
        self.cell = found // kinds
        self.n = np.bincount(self.cell, minlength=len(n))
        self.start = np.cumsum(self.n) - self.n

    def lists(self, which: np.ndarray) -> pa.ListArray:
        at, times = self.at[which], self.times[which]
        ends = np.cumsum(times)
        flat = self.places[np.repeat(at - (ends - times), times) + np.arange(times.sum())]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat, pa.int32()))


def _alike(off: float):
    """Of two lists of words the pairs that are alike: where the words of a pair stand in either list, the edits and the score. Different words are compared once a row."""

    def compared(xs: pa.Array, ys: pa.Array) -> pa.Array:
        coded = pa.concat_arrays([xs.flatten(), ys.flatten()]).dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        size = np.array([len(w) for w in words], np.int64)
        same = len(os.path.commonprefix(words))  # what all begin with makes no difference
        wide = max(1, int(size.max(initial=0)) - same)
        letters = np.array([w[same:] for w in words], dtype=f"U{wide}").view(np.uint32).reshape(len(words), wide).T
        letters = np.ascontiguousarray(letters, np.uint8 if letters.max(initial=0) < 256 else np.uint32)
        a, b = _Side(xs, codes[: len(xs.flatten())], len(words)), _Side(ys, codes[len(xs.flatten()) :], len(words))
        # each word of a meets the words of b in its cell, which lie one behind the other
        times, first = b.n[a.cell], b.start[a.cell]
        letters_a, letters_b = letters[:, a.code], letters[:, b.code]
        lengths = [(int(m), int(n)) for m in np.unique(size) for n in np.unique(size)]
        out = [(np.zeros(0, np.int64),) * 4]
        for lo, hi in pairwise(_blocks(times, _AT_ONCE)):
            n = times[lo:hi]
            ends = np.cumsum(n)
            q = np.arange(n.sum(), dtype=np.int32) - np.repeat((ends - n - first[lo:hi]).astype(np.int32), n)
            for x, y in lengths:
                most = int(np.floor(max(x, y) * off + 1e-9))
                if abs(x - y) > most:
                    continue
                every = len(lengths) == 1
                some = slice(None) if every else np.flatnonzero(np.repeat(size[a.code[lo:hi]] == x, n) & (size[b.code] == y)[q])
                at = q[some]
                if x == y == same:
                    apart = np.zeros(len(at), np.uint8)
                else:
                    apart = _distances([np.repeat(c[lo:hi], n)[some] for c in letters_a[: x - same]], [c[at] for c in letters_b[: y - same]], most)
                near = np.flatnonzero(apart <= most)
                p = lo + np.searchsorted(ends, near if every else some[near], side="right")
                out.append((a.cell[p], p, at[near].astype(np.int64), apart[near].astype(np.int64)))
        cell, p, q, apart = (np.concatenate(c) for c in zip(*out))
        order = np.argsort(cell, kind="stable")
        score = 100.0 * (1 - apart / np.maximum(np.maximum(size[a.code[p]], size[b.code[q]]), 1))
        found = pa.StructArray.from_arrays([a.lists(p[order]), b.lists(q[order]), pa.array(apart[order], pa.int32()), pa.array(score[order])], names=["i", "j", "apart", "score"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(cell, minlength=len(xs)))], pa.int32()), found)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for xs, ys in batches:
            m, n = (np.diff(lists.offsets.to_numpy()).astype(np.int64) for lists in (xs, ys))
            for lo, hi in pairwise(_blocks(m * n + m + n, _A_BATCH)):
                yield compared(xs.slice(lo, hi - lo), ys.slice(lo, hi - lo))

    return F.arrow_udf(run, "array<struct<i: array<int>, j: array<int>, apart: int, score: double>>")


def similar_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_name: str, right_name: str, least: float = 85.0, only: str = "true", digits: int | None = None) -> DataFrame:
    """Pairs of equal keys, for which `only` holds, whose names agree by `least` of 100 (token_sort_ratio), with that score, rounded to `digits` if given. Null names agree with none.

    Where keys leave few pairs, each cell of keys is a row, and its different names are compared all at once; elsewhere names meet by rare runs (similar_candidates).
    """
    if _few_pairs(left, right, keys):
        cells = []
        for df, name, words, rows in ((left, left_name, "_x", "_as"), (right, right_name, "_y", "_bs")):
            d = df.filter(F.col(name).isNotNull()).withColumn(words, _sorted_words(F.col(name)))
            cells.append(d.groupBy(*keys).agg(F.collect_list(F.struct(*(c for c in d.columns if c not in keys))).alias(rows)))
        d = cells[0].join(cells[1].hint("merge"), keys).withColumn("_pairs", _alike(1 - least / 100)(F.col("_as._x"), F.col("_bs._y")))
        d = d.withColumn("_p", F.explode("_pairs")).filter(F.col("_p.score") >= least)
        # worked out for a pair of names, before its rows are paired
        d = d.withColumn("score", F.col("_p.score") if digits is None else F.round("_p.score", digits)).withColumn("_i", F.explode("_p.i")).withColumn("_j", F.explode("_p.j"))
        fields = [F.col(rows)[F.col(at)][c].alias(c) for df, rows, at in ((left, "_as", "_i"), (right, "_bs", "_j")) for c in df.columns if c not in keys]
        return d.select(*keys, *fields, "score").filter(only)
    d = similar_candidates(left, right, keys, left_name, right_name, least, only)
    d = d.filter(F.expr("levenshtein(_x, _y, _edits) >= 0")).filter(F.element_at(F.array_intersect("_rare_a", "_rare_b"), 1) == F.col("_g"))  # the distance, then each pair once
    edits = F.levenshtein("_x", "_y")
    size = F.greatest(F.length("_x"), F.length("_y"), F.lit(1))
    d = d.withColumn("score", 100.0 * (1 - edits / size)).filter(F.col("score") >= least).drop("_x", "_y", "_edits", "_g", "_rare_a", "_rare_b")
    return d if digits is None else d.withColumn("score", F.round("score", digits))
