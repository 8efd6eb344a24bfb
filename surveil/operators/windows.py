"""Window operators that need more than one Spark window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._helpers import cut
from .quantiles import quantiles


def totals_below(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """df with below_c for each c of cols: its total over the rows of the same keys that come before in `order`, 0 at first.

    Rows must differ in (keys, order). One key may hold all rows: they are dealt by ranges, and of each range only its totals (a row per key in it)
    are summed up in turn.
    """
    dealt = cut(df.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()))
    inner = Window.partitionBy("_range", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy("_range", *keys).agg(*(F.sum(c).alias(f"_all_{c}") for c in cols))
    outer = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # rows: the ranges of a key
    start = whole.select(*(F.col(k).alias(f"_k_{k}") for k in ["_range", *keys]), *(F.coalesce(F.sum(f"_all_{c}").over(outer), F.lit(0)).alias(f"_start_{c}") for c in cols))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in ["_range", *keys]))
    here = dealt.select("*", *(F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_in_{c}") for c in cols))
    return here.join(start, same).select(*df.columns, *((F.col(f"_in_{c}") + F.col(f"_start_{c}")).alias(f"below_{c}") for c in cols))


def days_covered(spans: DataFrame, key: str, start: str, end: str, first: str, last: str) -> DataFrame:
    """Per key the days from first to last that any span covers: spans are merged, days are never listed."""
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    d = spans.select(key, F.greatest(F.col(start), lo).alias("s"), F.least(F.col(end), hi).alias("e")).filter("s <= e")
    before = F.max("e").over(Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.datediff("e", F.greatest(F.date_sub("s", 1), F.coalesce(before, F.date_sub("s", 1))))
    return d.withColumn("n", F.greatest(fresh, F.lit(0))).groupBy(key).agg(F.sum("n").alias("days"))


def anchored_groups(events: DataFrame, keys: list[str], day: str, reach: int) -> DataFrame:
    """Each distinct day with the first day of its group: a day beyond reach of the group's first one begins a new group."""
    days = events.groupBy(*keys).agg(F.array_sort(F.collect_set(day)).alias("ds"))
    step = F.aggregate(
        "ds",
        F.array().cast("array<struct<d:date,anchor:date>>"),
        lambda acc, d: F.concat(acc, F.array(F.struct(d.alias("d"), F.when(F.datediff(d, F.try_element_at(acc, F.lit(-1))["anchor"]) <= reach, F.try_element_at(acc, F.lit(-1))["anchor"]).otherwise(d).alias("anchor")))),
    )
    return days.select(*keys, F.explode(step).alias("x")).select(*keys, F.col("x.d").alias(day), F.col("x.anchor").alias("anchor"))


def robust_z(df: DataFrame, group: str, value: str) -> DataFrame:
    """df with z = 0.6745 (x - median) / MAD by group; where MAD is 0 the standard deviation serves."""
    med = df.groupBy(group).agg(F.stddev(value).alias("_sd")).join(quantiles(df, [group], value, {"_med": 0.5}), group)
    dev = df.join(med, group)
    mad = quantiles(dev, [group], F.abs(F.col(value) - F.col("_med")), {"_mad": 0.5})
    gap = F.col(value) - F.col("_med")
    z = F.when(F.col("_mad") > 0, 0.6745 * gap / F.col("_mad")).when(F.col("_sd") > 0, gap / F.col("_sd")).otherwise(0.0)
    return dev.join(mad, group).withColumn("z", z).drop("_med", "_sd", "_mad")


def seasonal(df: DataFrame, series: list[str], day: str, value: str, period: int) -> DataFrame:
    """Trend (centred mean of one period), seasonal part (median of what is left, by place in the period), and residual."""
    half = period // 2
    w = Window.partitionBy(*series).orderBy(day).rowsBetween(-half, half)
    trend = df.withColumn("trend", F.when(F.count("*").over(w) == period, F.avg(value).over(w))).withColumn("_k", F.pmod(F.unix_date(day), F.lit(period)))
    part = trend.filter("trend is not null").groupBy(*series, "_k").agg(F.median(F.col(value) - F.col("trend")).alias("seasonal"))
    return trend.join(part, [*series, "_k"]).withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_k")
