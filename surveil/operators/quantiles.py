"""Exact quantiles of groups of any size, by selection on ranks.

A group of few values goes to `percentile`. Of a larger one only counts are taken: its range is
cut into cells, the cell that holds an asked rank becomes the new range, and so on until it
holds few values, or one; then just these are looked at. Counts are summed where the rows are,
so what is shuffled is one row for each task and cell, whatever the size of a group; rows stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._helpers import cut

#: Values of a group, or of a range of it, that one task may hold.
FEW = 200_000
CELLS = 4096
#: Ranges that are sent to all tasks; more are joined by shuffle.
SENT = 10_000


def _same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def _in_range(data: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Each value with each range of its group that holds it."""
    held = F.broadcast(ranges) if ranges.count() <= SENT else ranges
    inside = F.col("d._v").between(F.col("r._lo"), F.col("r._hi"))
    return data.alias("d").join(held.alias("r"), _same("d", "r", keys) & inside).select(*(F.col(f"d.{k}").alias(k) for k in keys), "d._v", "r._lo", "r._hi")


def _ranks(data: DataFrame, sizes: DataFrame, keys: list[str], probs: list[float], few: int, cells: int) -> DataFrame:
    """(keys, _rank, _v): the values at the ranks that probs need, in groups of the given sizes (_n, _lo, _hi)."""
    at = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*(f(x).cast("long") + 1 for x in at for f in (F.floor, F.ceil))))
    # _below: how many values of the group lie before _lo; _n: how many lie from _lo to _hi
    todo = cut(sizes.select(*keys, F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_below"), "_n", "_lo", "_hi"))
    found = todo.select(*keys, "_rank", F.col("_lo").alias("_v")).filter("_lo = _hi")
    open_ = todo.filter("_lo < _hi")
    while (wide := open_.filter(F.col("_n") > few)).limit(1).count():
        ranges = wide.select(*keys, "_lo", "_hi").distinct()
        part = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        # the ends are cells of their own, so that a range always shrinks, between infinities too
        cell = F.when(F.col("_v") == F.col("_lo"), -1).when(F.col("_v") == F.col("_hi"), cells).otherwise(F.least(F.floor(F.nanvl(part, F.lit(0.0)) * cells), F.lit(cells - 1)))
        counts = _in_range(data, ranges, keys).groupBy(*keys, "_lo", "_hi", cell.alias("_cell")).agg(F.count("*").alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "_lo", "_hi").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # rows: the cells of a range
        counts = counts.withColumn("_before", before)
        place = F.col("d._rank") - F.col("d._below")
        hit = _same("d", "r", [*keys, "_lo", "_hi"]) & (place > F.col("r._before")) & (place <= F.col("r._before") + F.col("r._c"))
        nearer = wide.alias("d").join(counts.alias("r"), hit).select(*(F.col(f"d.{k}").alias(k) for k in keys), "d._rank", (F.col("d._below") + F.col("r._before")).alias("_below"), F.col("r._c").alias("_n"), F.col("r._from").alias("_lo"), F.col("r._to").alias("_hi"))
        todo = cut(nearer.unionByName(open_.filter(F.col("_n") <= few)))
        found = found.unionByName(todo.filter("_lo = _hi").select(*keys, "_rank", F.col("_lo").alias("_v")))
        open_ = todo.filter("_lo < _hi")
    if open_.limit(1).count():
        near = _in_range(data, open_.select(*keys, "_lo", "_hi").distinct(), keys).groupBy(*keys, "_lo", "_hi").agg(F.sort_array(F.collect_list("_v")).alias("_vs"))  # few values
        last = open_.alias("d").join(near.alias("r"), _same("d", "r", [*keys, "_lo", "_hi"]))
        found = found.unionByName(last.select(*(F.col(f"d.{k}").alias(k) for k in keys), "d._rank", F.element_at("r._vs", (F.col("d._rank") - F.col("d._below")).cast("int")).alias("_v")))
    return found


def quantiles(df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float], few: int = FEW, cells: int = CELLS) -> DataFrame:
    """One row for each group: keys, and under each name of probs the quantile, between two values by linear interpolation.

    Nulls and NaN are left out; a group without values has null quantiles. Without keys there is one row, of an empty table too.
    """
    groups = keys or ["_all"]
    v = F.col(value) if isinstance(value, str) else value
    data = (df if keys else df.withColumn("_all", F.lit(0))).select(*groups, v.cast("double").alias("_v"))
    data = data.withColumn("_v", F.when(~F.isnan("_v"), F.col("_v")))
    sizes = cut(data.groupBy(*groups).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    names, asked = list(probs), list(probs.values())
    q = F.percentile("_v", F.array(*(F.lit(float(p)) for p in asked)))
    many = sizes.filter(F.col("_n") > few)
    if not many.limit(1).count():
        out = data.groupBy(*groups).agg(q.alias("_q")).select(*groups, *(F.col("_q")[i].alias(n) for i, n in enumerate(names)))
    else:
        small = sizes.filter(F.col("_n") <= few).select(*groups)
        rest = data.alias("d").join(small.alias("r"), _same("d", "r", groups)).select("d.*")
        out = rest.groupBy(*groups).agg(q.alias("_q")).select(*groups, *(F.col("_q")[i].alias(n) for i, n in enumerate(names)))
        at = _ranks(data, many, groups, asked, few, cells).groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"))
        large = at.alias("d").join(many.alias("r"), _same("d", "r", groups)).select(*(F.col(f"d.{k}").alias(k) for k in groups), "d._m", "r._n")
        cols = []
        for n, p in probs.items():
            x = (F.col("_n") - 1) * F.lit(float(p))
            low, high = F.col("_m")[F.floor(x).cast("long") + 1], F.col("_m")[F.ceil(x).cast("long") + 1]
            part = x - F.floor(x)
            cols.append(F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(n))
        out = out.unionByName(large.select(*groups, *cols))
    if keys:
        return out
    none = df.sparkSession.range(1).select(F.lit(0).alias("_all"))
    return none.join(out, "_all", "left").select(*names)


def with_medians(df: DataFrame, keys: list[str], value: str | Column, name: str, few: int = FEW) -> DataFrame:
    """df with the median of each row's group."""
    med = quantiles(df, keys, value, {name: 0.5}, few)
    if not keys:
        return df.crossJoin(F.broadcast(med))
    return df.alias("d").join(med.alias("r"), _same("d", "r", keys)).select("d.*", F.col(f"r.{name}").alias(name))
