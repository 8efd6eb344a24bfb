"""Data-quality checks: each is an aggregate with a verdict, and all checks of a table are one pass over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Check:
    """A named aggregate, what it must satisfy, and how bad it is otherwise."""

    name: str
    value: Column
    ok: Column  # of the column "value"
    severity: str = "ERROR"


def rows(name: str, at_least: int = 1) -> Check:
    return Check(name, F.count("*"), F.col("value") >= at_least)


def failing(name: str, bad: Column, mostly: float = 0.0, severity: str = "ERROR") -> Check:
    """The share of rows for which `bad` holds is at most `mostly`."""
    return Check(name, F.avg(F.when(F.coalesce(bad, F.lit(False)), 1.0).otherwise(0.0)), F.col("value") <= mostly, severity)


def not_null(name: str, c: Column, mostly: float = 0.0) -> Check:
    return failing(name, c.isNull(), mostly)


def unique(name: str, *cols: Column) -> Check:
    return Check(name, F.count("*") - F.countDistinct(F.struct(*cols)), F.col("value") == 0)


def between(name: str, value: Column, low: float, high: float, severity: str = "WARNING") -> Check:
    return Check(name, value, F.col("value").between(low, high), severity)


def run(df: DataFrame, checks: list[Check]) -> DataFrame:
    """(check_name, value, status, severity), one row per check."""
    one = df.agg(*(c.value.cast("double").alias(f"c{i}") for i, c in enumerate(checks)))
    items = F.array(*(F.struct(F.lit(c.name).alias("check_name"), F.col(f"c{i}").alias("value"), F.lit(i).alias("i"), F.lit(c.severity).alias("severity")) for i, c in enumerate(checks)))
    out = one.select(F.explode(items).alias("x")).select("x.*")
    ok = None
    for i, c in enumerate(checks):
        ok = F.when(F.col("i") == i, c.ok) if ok is None else ok.when(F.col("i") == i, c.ok)
    return out.select("check_name", F.round("value", 6).alias("value"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("status"), "severity")


def scorecard(results: DataFrame) -> DataFrame:
    """Checks passed, warned and failed, the share passed, and a grade."""
    bad = F.col("status") != "PASS"
    s = results.agg(F.count("*").alias("checks"), F.count_if(~bad).alias("passed"), F.count_if(bad & (F.col("severity") == "WARNING")).alias("warned"), F.count_if(bad & (F.col("severity") != "WARNING")).alias("failed"))
    pct = 100.0 * F.col("passed") / F.col("checks")
    grade = F.when(pct >= 95, "A").when(pct >= 90, "B").when(pct >= 80, "C").when(pct >= 70, "D").otherwise("F")
    return s.withColumn("score", F.round(pct, 4)).withColumn("grade", grade)


def change(pre: DataFrame, post: DataFrame, key: str, measures: dict[str, Column]) -> DataFrame:
    """Measures before and after, with the relative change in per cent."""
    a, b = (d.select(key, *(c.alias(f"{side}_{n}") for n, c in measures.items())) for d, side in ((pre, "pre"), (post, "post")))
    out = a.join(b, key, "full")
    for n in measures:
        x, y = F.col(f"pre_{n}"), F.col(f"post_{n}")
        out = out.withColumn(f"{n}_change_pct", F.round(100.0 * F.try_divide(y - x, x), 6))
    return out


def verdict(off: Column, warn: float, fail: float) -> Column:
    """PASS up to warn, WARNING up to fail, FAIL beyond; a change that cannot be told fails."""
    return F.when(F.abs(off) <= warn, "PASS").when(F.abs(off) <= fail, "WARNING").otherwise("FAIL")


def prepost_score(row_change_pct: Column, missing_columns: Column, issues: Column, null_changes: Column, numeric_changes: Column) -> Column:
    """100 points less deductions for row changes, missing columns, issues, null and mean shifts."""
    r = F.abs(row_change_pct)
    lost = F.when(r > 50, 10).when(r > 20, 5).when(r > 5, 2).otherwise(0)
    return F.greatest(100.0 - lost - F.least(missing_columns * 5, F.lit(20)) - F.least(issues * 3, F.lit(30)) - F.least(null_changes * 4, F.lit(20)) - F.least(numeric_changes * 4, F.lit(20)), F.lit(0.0))
