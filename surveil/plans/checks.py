"""Data-quality checks and scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as K
from ..operators import profiles as P
from ..operators import quantiles as Q
from .registry import Tables, query

C = F.col


def _sql(rows: list[tuple[str, str, str, str, str]]) -> str:
    """(name, aggregate, table, condition on v, severity) -> the long form."""
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, round(CAST({a} AS DOUBLE), 6) AS value, CASE WHEN coalesce({c.replace('v', f'CAST({a} AS DOUBLE)')}, false) THEN 'PASS' ELSE 'FAIL' END AS status, '{s}' AS severity FROM {t}" for n, a, t, c, s in rows)


def _share(cond: str) -> str:
    return f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)"


@query("dq_not_null", _sql([("id", _share("event_id IS NULL"), "events", "v <= 0.0", "ERROR"), ("mostly", _share("event_type = 'error'"), "events", "v <= 0.05", "ERROR"), ("kind", _share("event_type IS NULL"), "events", "v <= 0.0", "ERROR")]))
def dq_not_null(t: Tables):
    return K.run(t.events, [K.not_null("id", C("event_id")), K.not_null("mostly", F.when(C("event_type") != "error", C("event_id")), 0.05), K.not_null("kind", C("event_type"))])


@query("dq_unique", _sql([("event_id", "count(*) - count(DISTINCT event_id)", "events", "v = 0", "ERROR")]) + " UNION ALL " + _sql([("line", "count(*) - count(DISTINCT (l_orderkey, l_linenumber))", "lineitem", "v = 0", "ERROR")]))
def dq_unique(t: Tables):
    return K.run(t.events, [K.unique("event_id", C("event_id"))]).unionByName(K.run(t.lineitem, [K.unique("line", C("l_orderkey"), C("l_linenumber"))]))


@query("dq_columns", "SELECT true AS ordered, CAST(6 AS INTEGER) AS n_columns, true AS count_ok, count(*) AS n_rows, true AS ts_is_time, true AS value_is_number FROM events")
def dq_columns(t: Tables):
    want = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    kinds = dict(t.events.dtypes)
    return t.events.agg(F.lit(t.events.columns == want).alias("ordered"), F.lit(len(kinds)).alias("n_columns"), F.lit(len(kinds) == len(want)).alias("count_ok"), F.count("*").alias("n_rows"), F.lit(kinds["ts"].startswith("timestamp")).alias("ts_is_time"), F.lit(kinds["value"] == "double").alias("value_is_number"))


@query("dq_distribution", _sql([("mean", "avg(value)", "events", "v BETWEEN 20 AND 80", "WARNING"), ("sd", "stddev(value)", "events", "v BETWEEN 1 AND 60", "WARNING"), ("max", "max(value)", "events", "v BETWEEN 0 AND 200", "WARNING"), ("median", "median(value)", "events", "v BETWEEN 10 AND 90", "WARNING"), ("q95", "quantile_cont(value, 0.95)", "events", "v BETWEEN 10 AND 190", "WARNING")]))
def dq_distribution(t: Tables):
    q = Q.quantiles(t.events, [], "value", {"median": 0.5, "q95": 0.95})
    ranks = K.run(q, [K.between("median", F.first("median"), 10, 90), K.between("q95", F.first("q95"), 10, 190)])
    return K.run(t.events, [K.between("mean", F.avg("value"), 20, 80), K.between("sd", F.stddev("value"), 1, 60), K.between("max", F.max("value"), 0, 200)]).unionByName(ranks)


@query("dq_in_set", _sql([("kinds", "count(DISTINCT event_type)", "events", "v BETWEEN 3 AND 6", "WARNING"), ("in_set", _share("event_type NOT IN ('click','view','purchase','signup')"), "events", "v <= 0.0", "ERROR")]))
def dq_in_set(t: Tables):
    return K.run(t.events, [K.between("kinds", F.countDistinct("event_type"), 3, 6), K.failing("in_set", ~C("event_type").isin("click", "view", "purchase", "signup"))])


@query("dq_range", _sql([("range", _share("event_type = 'click' AND value NOT BETWEEN 0 AND 100"), "events", "v <= 0.0", "ERROR"), ("dates", _share("ts NOT BETWEEN TIMESTAMP '1900-01-01' AND TIMESTAMP '2100-01-01'"), "events", "v <= 0.0", "ERROR"), ("expression", _share("NOT (value >= 0 AND user_id >= 0)"), "events", "v <= 0.0", "ERROR")]))
def dq_range(t: Tables):
    return K.run(t.events, [K.failing("range", (C("event_type") == "click") & ~C("value").between(0, 100)), K.failing("dates", ~C("ts").between(F.lit("1900-01-01").cast("timestamp_ntz"), F.lit("2100-01-01").cast("timestamp_ntz"))), K.failing("expression", ~((C("value") >= 0) & (C("user_id") >= 0)))])


@query("dq_pair_order", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def dq_pair_order(t: Tables):
    return t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).filter("l_shipdate < o_orderdate").select("l_orderkey", "l_linenumber")


@query("dq_relationship", "SELECT count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dq_relationship(t: Tables):
    return t.orders.join(t.customer.filter("c_acctbal > 0").select(C("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").agg(F.count("*").alias("orphans"))


_DAY = "(SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)"


@query("dq_volume_anomaly", f"SELECT d, n, round((n - m) / s, 5) AS z FROM {_DAY}, (SELECT avg(n) AS m, stddev(n) AS s FROM {_DAY}) WHERE abs((n - m) / s) > 2")
def dq_volume_anomaly(t: Tables):
    day = t.orders.groupBy(C("o_orderdate").cast("date").alias("d")).agg(F.count("*").alias("n"))
    z = (C("n") - C("m")) / C("s")
    return day.crossJoin(F.broadcast(day.agg(F.avg("n").alias("m"), F.stddev("n").alias("s")))).filter(F.abs(z) > 2).select("d", "n", F.round(z, 5).alias("z"))


@query("dq_positivity", "SELECT event_type, CAST(ts AS DATE) AS d, round(avg(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY 1, 2 HAVING count(*) >= 10 AND avg(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END) > 0.6")
def dq_positivity(t: Tables):
    g = t.events.groupBy("event_type", C("ts").cast("date").alias("d")).agg(F.avg(F.when(C("value") > 30, 1.0).otherwise(0.0)).alias("rate"), F.count("*").alias("n"))
    return g.filter("n >= 10 and rate > 0.6").select("event_type", "d", F.round("rate", 6).alias("rate"))


@query("dq_genome", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5 OR l_discount > 0.09")
def dq_genome(t: Tables):
    return t.lineitem.filter("l_quantity < 5 or l_discount > 0.09").select("l_orderkey", "l_linenumber")


_POST = "(SELECT o_orderkey, CASE WHEN o_orderkey % 20 <> 1 THEN o_custkey END AS o_custkey, o_totalprice * 1.08 AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 50 <> 0)"


def post_orders(t: Tables):
    """The orders after a load that drops some, loses some keys and scales the prices."""
    return t.orders.filter("o_orderkey % 50 <> 0").select("o_orderkey", F.when(C("o_orderkey") % 20 != 1, C("o_custkey")).alias("o_custkey"), (C("o_totalprice") * 1.08).alias("o_totalprice"), "o_orderstatus")


@query("dq_row_count_change", f"SELECT a AS pre, b AS post, round(100.0 * (b - a) / a, 6) AS pct, CASE WHEN abs(100.0 * (b - a) / a) > 5 THEN 'FAIL' WHEN a <> b THEN 'WARNING' ELSE 'PASS' END AS status FROM (SELECT count(*) AS a FROM orders), (SELECT count(*) AS b FROM {_POST})")
def dq_row_count_change(t: Tables):
    d = t.orders.agg(F.count("*").alias("pre")).crossJoin(post_orders(t).agg(F.count("*").alias("post")))
    pct = 100.0 * (C("post") - C("pre")) / C("pre")
    return d.select("pre", "post", F.round(pct, 6).alias("pct"), F.when(F.abs(pct) > 5, "FAIL").when(C("pre") != C("post"), "WARNING").otherwise("PASS").alias("status"))


@query("dq_null_change", f"SELECT column_name, round(pre, 6) AS pre, round(post, 6) AS post, CASE WHEN post - pre > 5 THEN 'FAIL' WHEN post > pre THEN 'WARNING' ELSE 'PASS' END AS status FROM (SELECT 'o_custkey' AS column_name, (SELECT 100.0 * (count(*) - count(o_custkey)) / count(*) FROM orders) AS pre, (SELECT 100.0 * (count(*) - count(o_custkey)) / count(*) FROM {_POST}) AS post UNION ALL SELECT 'o_totalprice', 0.0, 0.0)")
def dq_null_change(t: Tables):
    cols = {c: C(c) for c in ("o_custkey", "o_totalprice")}
    a = P.missing(t.orders, cols).select("column_name", C("pct_missing").alias("pre"))
    b = P.missing(post_orders(t), cols).select("column_name", C("pct_missing").alias("post"))
    return a.join(b, "column_name").withColumn("status", F.when(C("post") - C("pre") > 5, "FAIL").when(C("post") > C("pre"), "WARNING").otherwise("PASS"))


@query("dq_numeric_change", f"SELECT 'o_totalprice' AS column_name, round(a.m, 4) AS pre_mean, round(b.m, 4) AS post_mean, round(100.0 * (b.m - a.m) / a.m, 5) AS mean_change_pct, round(100.0 * (b.md - a.md) / a.md, 5) AS median_change_pct FROM (SELECT avg(o_totalprice) AS m, median(o_totalprice) AS md FROM orders) a, (SELECT avg(o_totalprice) AS m, median(o_totalprice) AS md FROM {_POST}) b")
def dq_numeric_change(t: Tables):
    ch = K.change(P.numbers(t.orders, ["o_totalprice"]), P.numbers(post_orders(t), ["o_totalprice"]), "column_name", {"mean": C("mean"), "median": C("median")})
    return ch.select("column_name", F.round("pre_mean", 4).alias("pre_mean"), F.round("post_mean", 4).alias("post_mean"), F.round("mean_change_pct", 5).alias("mean_change_pct"), F.round("median_change_pct", 5).alias("median_change_pct"))


def _spread_sql(table: str) -> str:
    return f"(SELECT stddev(o_totalprice) AS sd, CAST(min(o_totalprice) AS DOUBLE) AS min, CAST(max(o_totalprice) AS DOUBLE) AS max, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM {table})"


@query("dq_numeric_spread", " UNION ALL ".join(f"SELECT 'o_totalprice' AS column_name, '{c}' AS measure, round(a.{c}, 3) AS pre, round(b.{c}, 3) AS post, round(100.0 * (b.{c} - a.{c}) / nullif(a.{c}, 0), 5) AS pct, CASE WHEN abs(100.0 * (b.{c} - a.{c}) / nullif(a.{c}, 0)) <= 5 THEN 'PASS' WHEN abs(100.0 * (b.{c} - a.{c}) / nullif(a.{c}, 0)) <= 20 THEN 'WARNING' ELSE 'FAIL' END AS status FROM {_spread_sql('orders')} a, {_spread_sql(_POST)} b" for c in ("sd", "min", "max", "iqr")))
def dq_numeric_spread(t: Tables):
    """Standard deviation, extremes and interquartile range before and after a load, each with a verdict."""
    names = ("sd", "min", "max", "iqr")
    measures = {"sd": C("sd"), "min": C("min"), "max": C("max"), "iqr": C("q3") - C("q1")}
    ch = K.change(P.numbers(t.orders, ["o_totalprice"]), P.numbers(post_orders(t), ["o_totalprice"]), "column_name", measures)
    items = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), C(f"pre_{c}").alias("pre"), C(f"post_{c}").alias("post")) for c in names)))
    pct = 100.0 * F.try_divide(C("post") - C("pre"), C("pre"))
    return ch.select("column_name", items.alias("x")).select("column_name", "x.*").select("column_name", "measure", F.round("pre", 3).alias("pre"), F.round("post", 3).alias("post"), F.round(pct, 5).alias("pct"), K.verdict(pct, 5, 20).alias("status"))


@query("dq_categorical_change", f"SELECT *, post - pre AS difference, CASE WHEN pre = post THEN 'PASS' WHEN abs(post - pre) <= 5 THEN 'WARNING' ELSE 'FAIL' END AS status FROM (SELECT 'o_orderstatus' AS column_name, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS pre, (SELECT count(DISTINCT o_orderstatus) FROM {_POST}) AS post UNION ALL SELECT 'o_custkey', (SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(DISTINCT o_custkey) FROM {_POST}))")
def dq_categorical_change(t: Tables):
    cols = ["o_orderstatus", "o_custkey"]
    d = t.orders.agg(*(F.countDistinct(c).alias(f"a_{c}") for c in cols)).crossJoin(post_orders(t).agg(*(F.countDistinct(c).alias(f"b_{c}") for c in cols)))
    items = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), C(f"a_{c}").alias("pre"), C(f"b_{c}").alias("post")) for c in cols)))
    change = C("post") - C("pre")
    return d.select(items.alias("x")).select("x.*").select("*", change.alias("difference"), K.verdict(change, 0, 5).alias("status"))


_TWICE = f"(SELECT * FROM {_POST} UNION ALL SELECT * FROM {_POST} WHERE o_orderkey % 500 = 1)"


@query("dq_duplicates", f"SELECT pre, post, CASE WHEN post = 0 THEN 'PASS' WHEN post <= 10 THEN 'WARNING' ELSE 'FAIL' END AS status FROM (SELECT count(*) - count(DISTINCT o_orderkey) AS pre FROM orders), (SELECT count(*) - count(DISTINCT o_orderkey) AS post FROM {_TWICE})")
def dq_duplicates(t: Tables):
    """Repeated keys before and after a load that has written some rows twice."""
    post = post_orders(t)
    more = F.count("*") - F.countDistinct("o_orderkey")
    d = t.orders.agg(more.alias("pre")).crossJoin(post.unionByName(post.filter("o_orderkey % 500 = 1")).agg(more.alias("post")))
    return d.select("pre", "post", K.verdict(C("post"), 0, 10).alias("status"))


_SIZE = "sum(16 + length(o_orderstatus) + CASE WHEN o_custkey IS NULL THEN 0 ELSE 8 END)"


@query("dq_size", f"SELECT pre, post, round(100.0 * (post - pre) / pre, 6) AS pct, CASE WHEN abs(100.0 * (post - pre) / pre) <= 20 THEN 'PASS' WHEN abs(100.0 * (post - pre) / pre) <= 50 THEN 'WARNING' ELSE 'FAIL' END AS status FROM (SELECT CAST({_SIZE} AS BIGINT) AS pre FROM orders), (SELECT CAST({_SIZE} AS BIGINT) AS post FROM {_POST})")
def dq_size(t: Tables):
    """Bytes of the values of the columns that both sides have: eight for a number, one for a letter, none for a null."""
    size = F.sum(16 + F.length("o_orderstatus") + F.when(C("o_custkey").isNull(), 0).otherwise(8))
    d = t.orders.agg(size.alias("pre")).crossJoin(post_orders(t).agg(size.alias("post")))
    pct = 100.0 * (C("post") - C("pre")) / C("pre")
    return d.select("pre", "post", F.round(pct, 6).alias("pct"), K.verdict(pct, 20, 50).alias("status"))


@query("dq_column_check", f"SELECT CAST(6 AS INTEGER) AS pre, CAST(4 AS INTEGER) AS post, CAST(-2 AS INTEGER) AS difference, 'WARNING' AS status, (SELECT count(*) FROM orders) AS pre_rows, (SELECT count(*) FROM {_POST}) AS post_rows")
def dq_column_check(t: Tables):
    post = post_orders(t)
    a, b = len(t.orders.columns), len(post.columns)
    rows = t.orders.agg(F.count("*").alias("pre_rows")).crossJoin(post.agg(F.count("*").alias("post_rows")))
    return rows.select(F.lit(a).alias("pre"), F.lit(b).alias("post"), F.lit(b - a).alias("difference"), K.verdict(F.lit(b - a), 0, 2).alias("status"), "pre_rows", "post_rows")


_RULES = [("age", "avg(CASE WHEN l_quantity NOT BETWEEN 0 AND 120 THEN 1.0 ELSE 0.0 END)", "lineitem", "v <= 0.0", "ERROR"), ("dates", "avg(CASE WHEN l_shipdate > TIMESTAMP '1999-01-01' THEN 1.0 ELSE 0.0 END)", "lineitem", "v <= 0.0", "ERROR"), ("freshness", "date_diff('day', max(CAST(l_shipdate AS DATE)), DATE '2001-12-31')", "lineitem", "v BETWEEN 0 AND 60", "WARNING")]


def _rules():
    return [K.failing("age", ~C("l_quantity").between(0, 120)), K.failing("dates", C("l_shipdate") > F.lit("1999-01-01").cast("timestamp_ntz")), K.between("freshness", F.datediff(F.lit("2001-12-31").cast("date"), F.max(C("l_shipdate").cast("date"))), 0, 60)]


@query("dq_business_rule", _sql(_RULES))
def dq_business_rule(t: Tables):
    return K.run(t.lineitem, _rules())


@query("dq_outliers", "SELECT event_type, CAST(sum(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS outliers FROM events JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) USING (event_type) GROUP BY 1")
def dq_outliers(t: Tables):
    q = Q.quantiles(t.events, ["event_type"], "value", {"q1": 0.25, "q3": 0.75})
    w = 1.5 * (C("q3") - C("q1"))
    return t.events.join(q, "event_type").groupBy("event_type").agg(F.count_if((C("value") < C("q1") - w) | (C("value") > C("q3") + w)).alias("outliers"))


@query("dq_scorecard", f"SELECT count(*) AS checks, CAST(sum(CASE WHEN status = 'PASS' THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN status <> 'PASS' AND severity = 'WARNING' THEN 1 ELSE 0 END) AS BIGINT) AS warned, CAST(sum(CASE WHEN status <> 'PASS' AND severity <> 'WARNING' THEN 1 ELSE 0 END) AS BIGINT) AS failed, round(100.0 * avg(CASE WHEN status = 'PASS' THEN 1.0 ELSE 0.0 END), 4) AS score, CASE WHEN avg(CASE WHEN status = 'PASS' THEN 1.0 ELSE 0.0 END) >= 0.95 THEN 'A' WHEN avg(CASE WHEN status = 'PASS' THEN 1.0 ELSE 0.0 END) >= 0.9 THEN 'B' WHEN avg(CASE WHEN status = 'PASS' THEN 1.0 ELSE 0.0 END) >= 0.8 THEN 'C' WHEN avg(CASE WHEN status = 'PASS' THEN 1.0 ELSE 0.0 END) >= 0.7 THEN 'D' ELSE 'F' END AS grade FROM ({_sql(_RULES)})")
def dq_scorecard(t: Tables):
    return K.scorecard(K.run(t.lineitem, _rules()))


@query("dq_prepost_score", f"""SELECT round(100.0 - CASE WHEN abs(r) > 50 THEN 10 WHEN abs(r) > 20 THEN 5 WHEN abs(r) > 5 THEN 2 ELSE 0 END - 10 - least((nul + num) * 3, 30) - least(nul * 4, 20) - least(num * 4, 20), 4) AS score FROM
 (SELECT 100.0 * ((SELECT count(*) FROM {_POST}) - count(*)) / count(*) AS r, CASE WHEN (SELECT 100.0 * (count(*) - count(o_custkey)) / count(*) FROM {_POST}) > 5 THEN 1 ELSE 0 END AS nul, CASE WHEN abs(100 * ((SELECT avg(o_totalprice) FROM {_POST}) / avg(o_totalprice) - 1)) > 10 THEN 1 ELSE 0 END AS num FROM orders)""")
def dq_prepost_score(t: Tables):
    def stats(df, side):
        return df.agg(F.count("*").alias(f"{side}_n"), (100.0 * F.count_if(C("o_custkey").isNull()) / F.count("*")).alias(f"{side}_null"), F.avg("o_totalprice").alias(f"{side}_mean"))

    post = post_orders(t)
    gone = len(set(t.orders.columns) - set(post.columns))
    d = stats(t.orders, "a").crossJoin(stats(post, "b"))
    nulls = F.when(F.abs(C("b_null") - C("a_null")) > 5, 1).otherwise(0)
    means = F.when(F.abs(100 * (C("b_mean") / C("a_mean") - 1)) > 10, 1).otherwise(0)
    return d.select(F.round(K.prepost_score(100.0 * (C("b_n") - C("a_n")) / C("a_n"), F.lit(gone), nulls + means, nulls, means), 4).alias("score"))


@query("dq_bronze4", "SELECT CAST(sum(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_ids, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, CAST(sum(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END) AS BIGINT) AS extreme, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans FROM orders")
def dq_bronze4(t: Tables):
    one = t.orders.agg(F.count_if(C("o_custkey").isNull()).alias("null_ids"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"), F.count_if(C("o_totalprice") > 400000).alias("extreme"))
    orphans = t.orders.join(t.customer.select(C("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").agg(F.countDistinct("o_custkey").alias("orphans"))
    return one.crossJoin(orphans)


@query("dq_ct_consistent", "SELECT user_id FROM (SELECT user_id, min(value) AS lo, avg(value) AS m, max(value) AS hi FROM events GROUP BY 1) WHERE NOT (lo <= m AND m <= hi) OR hi > 350")
def dq_ct_consistent(t: Tables):
    g = t.events.groupBy("user_id").agg(F.min("value").alias("lo"), F.avg("value").alias("m"), F.max("value").alias("hi"))
    return g.filter("not (lo <= m and m <= hi) or hi > 350").select("user_id")


@query("dq_lineage_consistent", "SELECT p_partkey FROM part WHERE (p_brand LIKE 'Brand#1%') <> (p_size % 2 = 1)")
def dq_lineage_consistent(t: Tables):
    return t.part.filter(C("p_brand").like("Brand#1%") != (C("p_size") % 2 == 1)).select("p_partkey")


@query("dq_stream_columns", _sql([("numeric", _share("try_cast(value AS DOUBLE) IS NULL"), "events", "v <= 0.0", "ERROR"), ("non_negative", _share("value < 0"), "events", "v <= 0.0", "ERROR"), ("percentage", _share("value > 100"), "events", "v <= 0.0", "ERROR")]))
def dq_stream_columns(t: Tables):
    return K.run(t.events, [K.not_null("numeric", C("value").try_cast("double")), K.failing("non_negative", C("value") < 0), K.failing("percentage", C("value") > 100)])


@query("dq_migration", "SELECT CAST(sum(CASE WHEN l_partkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates, (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)) AS most_of_a_key FROM lineitem")
def dq_migration(t: Tables):
    one = t.lineitem.agg(F.count_if(C("l_partkey").isNull()).alias("nulls"), (F.count("*") - F.countDistinct("l_orderkey", "l_linenumber")).alias("duplicates"))
    return one.crossJoin(t.lineitem.groupBy("l_suppkey").count().agg(F.max("count").alias("most_of_a_key")))


@query("dq_stream_rules", _sql([("not_null", _share("user_id IS NULL"), "events", "v <= 0.0", "ERROR"), ("uniqueness", "count(*) - count(DISTINCT event_id)", "events", "v = 0", "ERROR"), ("freshness", "date_diff('second', max(ts), TIMESTAMP '2024-01-31') / 3600", "events", "v BETWEEN 0 AND 1", "WARNING")]))
def dq_stream_rules(t: Tables):
    exact = (F.unix_timestamp(F.lit("2024-01-31").cast("timestamp")) - F.unix_timestamp(F.max("ts").cast("timestamp"))) / 3600
    return K.run(t.events, [K.not_null("not_null", C("user_id")), K.unique("uniqueness", C("event_id")), K.between("freshness", exact, 0, 1)])
