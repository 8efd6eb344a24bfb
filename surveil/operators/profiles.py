"""Column profiles and long-form summaries: one pass over the rows, whatever the number of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def long_form(one_row: DataFrame, names: list[str], measures: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """Turn columns name__measure of an aggregate into rows (name, measures...)."""
    keys = keys or []
    item = F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), *(F.col(f"{n}__{m}").cast(kind).alias(m) for m, kind in measures.items())) for n in names)))
    return one_row.select(*keys, item.alias("x")).select(*keys, "x.*")


def missing(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Rows, missing values and their share of each named column."""
    agg = [F.count("*").alias("_n"), *(F.count_if(c.isNull()).alias(f"{n}__missing") for n, c in cols.items())]
    return long_form(df.agg(*agg), list(cols), {"missing": "long"}, ["_n"]).select("column_name", F.col("_n").alias("n"), "missing", F.round(100.0 * F.col("missing") / F.col("_n"), 6).alias("pct_missing"))


def numbers(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """Count, nulls, mean, standard deviation, extremes and exact quartiles of numeric columns; all columns take their quartiles from the same passes."""
    keys = keys or []
    agg = []
    for c in cols:
        agg += [F.count(c).alias(f"{c}__n"), F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.avg(c).alias(f"{c}__mean"), F.stddev(c).alias(f"{c}__sd"), F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    grouped = long_form(df.groupBy(*keys).agg(*agg) if keys else df.agg(*agg), cols, {"n": "long", "nulls": "long", **dict.fromkeys(("mean", "sd", "min", "max"), "double")}, keys)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("_x")) for c in cols)))
    tall = df.select(*keys, cells.alias("_c")).select(*keys, "_c.*")
    q = quantiles(tall, [*keys, "column_name"], "_x", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    same = reduce(lambda a, b: a & b, (F.col(f"g.{k}").eqNullSafe(F.col(f"q.{k}")) for k in [*keys, "column_name"]))
    return grouped.alias("g").join(q.alias("q"), same, "left").select("g.*", "q.q1", "q.median", "q.q3")


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, n_distinct, mode, mode_n) of each column, as text; of equally frequent values the least is the mode. Values are counted where they are, then by value."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols)))
    counts = df.select(cells.alias("c")).select("c.*").filter("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    found = counts.groupBy("column_name").agg(F.count("*").alias("n_distinct"), F.max("n").alias("mode_n"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return names.join(found, "column_name", "left").select("column_name", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "mode", "mode_n")


def repeated_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row: n rows, and how many are equal to another one that is counted already, in all columns or in some."""
    g = df.groupBy(*(cols or df.columns)).agg(F.count("*").alias("_n"))
    return g.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated"))
