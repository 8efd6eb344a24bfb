"""Window functions, sorting, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clinical as X
from ..operators import joins as J
from ..operators import windows as O
from .registry import Tables, query

C = F.col
DAILY_SQL = "(SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n, sum(value) AS v, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS err FROM events GROUP BY 1, 2)"


def daily(t: Tables):
    return t.events.groupBy("user_id", C("ts").cast("date").alias("d")).agg(F.count("*").alias("n"), F.sum("value").alias("v"), F.count_if(C("event_type") == "error").alias("err"))


def daily_in_order(t: Tables):
    """Each user's days with the sum of their values, added in the order of events however rows are dealt to files and tasks.

    Sums in another order can differ in their last digit, and days that are equal would then have a spread above zero.
    """
    e = t.events.select("user_id", C("ts").cast("date").alias("d"), "event_id", "value")
    return e.repartition("user_id", "d").sortWithinPartitions("user_id", "d", "event_id", "value").groupBy("user_id", "d").agg(F.sum("value").alias("v"))


def days(lo: int, hi: int, by: str = "user_id"):
    return W.partitionBy(by).orderBy(F.unix_date("d")).rangeBetween(lo, hi)


_R = "PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL {} DAYS PRECEDING AND {}"


@query("win_latest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def win_latest(t: Tables):
    return J.newest(t.events, ["user_id"], C("ts").desc(), C("event_id").desc()).select("user_id", "event_id")


@query("win_roll_sum", f"SELECT user_id, d, round(sum(err) OVER w / (sum(n) OVER w + 1.0), 6) AS rate FROM {DAILY_SQL} WINDOW w AS ({_R.format(7, 'CURRENT ROW')})")
def win_roll_sum(t: Tables):
    w = days(-7, 0)
    return daily(t).select("user_id", "d", F.round(F.sum("err").over(w) / (F.sum("n").over(w) + 1.0), 6).alias("rate"))


@query("win_roll_avg", f"SELECT user_id, d, round(avg(v) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW), 9) AS a7, round(avg(v) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW), 9) AS a30, round(avg(v) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW), 9) AS a90 FROM {DAILY_SQL}")
def win_roll_avg(t: Tables):
    return daily(t).select("user_id", "d", *(F.round(F.avg("v").over(days(-k, 0)), 9).alias(f"a{k}") for k in (7, 30, 90)))


@query("win_roll_z", f"SELECT user_id, d, round(CASE WHEN s > 0 THEN (v - m) / s END, 5) AS z, coalesce(abs((v - m) / nullif(s, 0)) > 2, false) AS outlier FROM (SELECT user_id, d, v, avg(v) OVER w AS m, stddev(v) OVER w AS s FROM {DAILY_SQL} WINDOW w AS ({_R.format(90, 'CURRENT ROW')}))")
def win_roll_z(t: Tables):
    w = days(-90, 0)
    z = F.when(F.stddev("v").over(w) > 0, (C("v") - F.avg("v").over(w)) / F.stddev("v").over(w))
    return daily_in_order(t).withColumn("z", z).select("user_id", "d", X.rounded("z", 5).alias("z"), F.coalesce(F.abs("z") > 2, F.lit(False)).alias("outlier"))


@query("win_shift_z", f"SELECT user_id, d, round(CASE WHEN s > 0 THEN (v - m) / s END, 5) AS z FROM (SELECT user_id, d, v, avg(v) OVER w AS m, stddev(v) OVER w AS s FROM {DAILY_SQL} WINDOW w AS ({_R.format(90, 'INTERVAL 1 DAY PRECEDING')}))")
def win_shift_z(t: Tables):
    w = days(-90, -1)
    return daily_in_order(t).select("user_id", "d", X.rounded(F.when(F.stddev("v").over(w) > 0, (C("v") - F.avg("v").over(w)) / F.stddev("v").over(w)), 5).alias("z"))


@query("win_lag_n", f"SELECT user_id, d, n - lag(n, 7) OVER (PARTITION BY user_id ORDER BY d) AS delta FROM {DAILY_SQL}")
def win_lag_n(t: Tables):
    return daily(t).select("user_id", "d", (C("n") - F.lag("n", 7).over(W.partitionBy("user_id").orderBy("d"))).alias("delta"))


_WEEKLY = "(SELECT user_id % 25 AS state, CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS DATE) AS w, count(*) AS n FROM events GROUP BY 1, 2)"


def weekly(t: Tables):
    return t.events.groupBy((C("user_id") % 25).alias("state"), X.week_start(C("ts").cast("date")).alias("w")).agg(F.count("*").alias("n"))


@query("win_wow", f"SELECT state, w, n - p AS change, round(100.0 * (n - p) / p, 6) AS pct, CASE WHEN n > 2 * p THEN 'spike' WHEN n > 1.5 * p THEN 'rise' ELSE 'normal' END AS level FROM (SELECT state, w, n, lag(n) OVER (PARTITION BY state ORDER BY w) AS p FROM {_WEEKLY})")
def win_wow(t: Tables):
    d = weekly(t).withColumn("p", F.lag("n").over(W.partitionBy("state").orderBy("w")))
    return d.select("state", "w", (C("n") - C("p")).alias("change"), F.round(100.0 * (C("n") - C("p")) / C("p"), 6).alias("pct"), F.when(C("n") > 2 * C("p"), "spike").when(C("n") > 1.5 * C("p"), "rise").otherwise("normal").alias("level"))


@query("win_share", "SELECT event_type, w, round(100.0 * n / sum(n) OVER (PARTITION BY w), 4) AS pct FROM (SELECT event_type, CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS DATE) AS w, count(*) AS n FROM events GROUP BY 1, 2)")
def win_share(t: Tables):
    d = t.events.groupBy("event_type", X.week_start(C("ts").cast("date")).alias("w")).agg(F.count("*").alias("n"))
    return d.select("event_type", "w", F.round(100.0 * C("n") / F.sum("n").over(W.partitionBy("w")), 4).alias("pct"))


@query("win_rank_share", "SELECT event_type, w, n, r, r = 1 AS dominant FROM (SELECT event_type, w, n, CAST(row_number() OVER (PARTITION BY w ORDER BY n DESC, event_type) AS INTEGER) AS r FROM (SELECT event_type, CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS DATE) AS w, count(*) AS n FROM events GROUP BY 1, 2)) WHERE n >= 5")
def win_rank_share(t: Tables):
    d = t.events.groupBy("event_type", X.week_start(C("ts").cast("date")).alias("w")).agg(F.count("*").alias("n"))
    return d.withColumn("r", F.row_number().over(W.partitionBy("w").orderBy(C("n").desc(), "event_type"))).filter("n >= 5").withColumn("dominant", C("r") == 1)


@query("win_avg_rank", "SELECT c_custkey, r FROM (SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 100) DESC) + (count(*) OVER (PARTITION BY c_nationkey, floor(c_acctbal / 100)) - 1) / 2.0 AS r FROM customer) WHERE r <= 10")
def win_avg_rank(t: Tables):
    d = t.customer.withColumn("b", F.floor(C("c_acctbal") / 100))
    r = F.rank().over(W.partitionBy("c_nationkey").orderBy(C("b").desc())) + (F.count("*").over(W.partitionBy("c_nationkey", "b")) - 1) / 2.0
    return d.select("c_custkey", r.alias("r")).filter("r <= 10")


@query("win_retest", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) > 0 AS is_retest FROM events")
def win_retest(t: Tables):
    # microseconds since the epoch as whole numbers, so the frame is exact
    w = W.partitionBy("user_id").orderBy("us").rangeBetween(-14 * 86_400_000_000, -86_400_000_000)
    return t.events.withColumn("us", F.unix_micros(C("ts").cast("timestamp"))).select("event_id", (F.count("*").over(w) > 0).alias("is_retest"))


@query("win_roll_rows", f"SELECT user_id, d, round(avg(v) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 5) AS mean7, round(v - lag(v) OVER (PARTITION BY user_id ORDER BY d), 5) AS diff FROM {DAILY_SQL}")
def win_roll_rows(t: Tables):
    w = W.partitionBy("user_id").orderBy("d")
    return daily(t).select("user_id", "d", F.round(F.avg("v").over(w.rowsBetween(-6, 0)), 5).alias("mean7"), X.rounded(C("v") - F.lag("v").over(w), 5).alias("diff"))


@query("win_first_last", "SELECT l_orderkey, l_linenumber, CAST(n AS BIGINT) AS n, CAST(r AS INTEGER) AS r FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS r FROM lineitem) WHERE n > 1")
def win_first_last(t: Tables):
    w = W.partitionBy("l_orderkey", "l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")).alias("r")).filter("n > 1")


@query("win_gap", "SELECT o_custkey, s, CAST(date_diff('day', e, s) AS INTEGER) AS gap FROM (SELECT o_custkey, s, max(e0) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS s, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS DATE) AS e0 FROM orders)) WHERE date_diff('day', e, s) > 7")
def win_gap(t: Tables):
    s = C("o_orderdate").cast("date")
    d = t.orders.select("o_orderkey", "o_custkey", s.alias("s"), F.date_add(s, (C("o_orderkey") % 90).cast("int")).alias("e0"))
    e = F.max("e0").over(W.partitionBy("o_custkey").orderBy("s", "o_orderkey").rowsBetween(W.unboundedPreceding, -1))
    return d.withColumn("gap", F.datediff("s", e)).filter("gap > 7").select("o_custkey", "s", "gap")


@query("win_inactive", f"SELECT user_id, d, CAST(date_diff('day', p, d) AS INTEGER) - 1 AS idle FROM (SELECT user_id, d, lag(d) OVER (PARTITION BY user_id ORDER BY d) AS p FROM {DAILY_SQL}) WHERE date_diff('day', p, d) - 1 >= 3")
def win_inactive(t: Tables):
    idle = F.datediff("d", F.lag("d").over(W.partitionBy("user_id").orderBy("d"))) - 1
    return daily(t).withColumn("idle", idle).filter("idle >= 3").select("user_id", "d", "idle")


@query("win_pdc", "SELECT k, round(count(DISTINCT d) / 365.0, 6) AS pdc, count(DISTINCT d) >= 0.8 * 365 AS adherent FROM (SELECT o_custkey AS k, unnest(generate_series(CAST(l_shipdate AS DATE), CAST(l_shipdate AS DATE) + CAST(l_quantity - 1 AS INTEGER), INTERVAL 1 DAY)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE d >= DATE '1997-01-01' AND d < DATE '1998-01-01' GROUP BY 1")
def win_pdc(t: Tables):
    s = C("l_shipdate").cast("date")
    fills = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).select(C("o_custkey").alias("k"), s.alias("s"), F.date_add(s, (C("l_quantity") - 1).cast("int")).alias("e"))
    return O.days_covered(fills, "k", "s", "e", "1997-01-01", "1997-12-31").select("k", F.round(C("days") / 365.0, 6).alias("pdc"), (C("days") >= 0.8 * 365).alias("adherent"))


@query("win_readmit", "SELECT o_orderkey, coalesce(date_diff('day', p, CAST(o_orderdate AS DATE)) <= 30, false) AS readmit FROM (SELECT o_orderkey, o_orderdate, CAST(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS p FROM orders)")
def win_readmit(t: Tables):
    p = F.lag("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("date")
    return t.orders.select("o_orderkey", F.coalesce(F.datediff(C("o_orderdate").cast("date"), p) <= 30, F.lit(False)).alias("readmit"))


@query("readmit_flags", "SELECT o_orderkey, coalesce(g <= 30, false) AS readmit, coalesce(g <= 30, false) AND o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AS preventable FROM (SELECT *, date_diff('day', CAST(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE), CAST(o_orderdate AS DATE)) AS g FROM orders)")
def readmit_flags(t: Tables):
    """Within 30 days of the one before; preventable if also of a related cause and kind."""
    before = F.lag("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("date")
    again = F.coalesce(F.datediff(C("o_orderdate").cast("date"), before) <= 30, F.lit(False))
    d = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", again.alias("readmit"))
    return d.select("o_orderkey", "readmit", (C("readmit") & (C("o_orderstatus") == "F") & C("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("preventable"))


@query("win_anchor_group", """WITH RECURSIVE e AS (SELECT user_id, d, CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS BIGINT) AS r FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error')),
 g AS (SELECT user_id, d, r, d AS anchor FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.d, e.r, CASE WHEN date_diff('day', g.anchor, e.d) <= 7 THEN g.anchor ELSE e.d END FROM g JOIN e ON e.user_id = g.user_id AND e.r = g.r + 1) SELECT user_id, d, anchor FROM g""")
def win_anchor_group(t: Tables):
    d = t.events.filter("event_type = 'error'").select("user_id", C("ts").cast("date").alias("d")).distinct()
    return O.anchored_groups(d, ["user_id"], "d", 7)


@query("win_mad_z", """WITH m AS (SELECT event_type, median(value) AS med, stddev(value) AS sd FROM events GROUP BY 1), a AS (SELECT e.event_type, median(abs(e.value - m.med)) AS mad FROM events e JOIN m USING (event_type) GROUP BY 1)
 SELECT e.event_id, round(CASE WHEN mad > 0 THEN 0.6745 * (e.value - med) / mad WHEN sd > 0 THEN (e.value - med) / sd ELSE 0 END, 6) AS z FROM events e JOIN m USING (event_type) JOIN a USING (event_type)""")
def win_mad_z(t: Tables):
    return O.robust_z(t.events.select("event_id", "event_type", "value"), "event_type", "value").select("event_id", X.rounded("z", 6).alias("z"))


@query("win_anomaly", """WITH m AS (SELECT event_type, median(value) AS med, stddev(value) AS sd FROM events GROUP BY 1), a AS (SELECT e.event_type, median(abs(e.value - m.med)) AS mad FROM events e JOIN m USING (event_type) GROUP BY 1), z AS (SELECT e.event_id, e.event_type, round(CASE WHEN mad > 0 THEN 0.6745 * (e.value - med) / mad WHEN sd > 0 THEN (e.value - med) / sd ELSE 0 END, 6) AS z, CASE event_type WHEN 'click' THEN 3.5 WHEN 'view' THEN 3.0 WHEN 'purchase' THEN 3.5 ELSE 4.0 END / 3 AS k FROM events e JOIN m USING (event_type) JOIN a USING (event_type))
 SELECT event_id, abs(z) > k AS is_anomaly, round(least(abs(z) / (2 * k), 1.0), 4) AS confidence FROM z WHERE abs(z) > 0.7 * k""")
def win_anomaly(t: Tables):
    k = F.when(C("event_type").isin("click", "purchase"), 3.5).when(C("event_type") == "view", 3.0).otherwise(4.0) / 3
    d = O.robust_z(t.events.select("event_id", "event_type", "value"), "event_type", "value").withColumn("k", k).withColumn("z", F.round("z", 6))
    return d.filter(F.abs("z") > 0.7 * C("k")).select("event_id", (F.abs("z") > C("k")).alias("is_anomaly"), F.round(F.least(F.abs("z") / (2 * C("k")), F.lit(1.0)), 4).alias("confidence"))


@query("win_seasonal", """WITH d AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1), t AS (SELECT d, n, CASE WHEN count(*) OVER w = 7 THEN avg(n) OVER w END AS trend FROM d WINDOW w AS (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), s AS (SELECT dayofweek(d) AS k, median(n - trend) AS seasonal FROM t WHERE trend IS NOT NULL GROUP BY 1)
 SELECT d, round(trend, 5) AS trend, round(seasonal, 5) AS seasonal, round(n - trend - seasonal, 5) AS residual FROM t JOIN s ON dayofweek(t.d) = s.k""")
def win_seasonal(t: Tables):
    day = t.events.groupBy(C("ts").cast("date").alias("d")).agg(F.count("*").alias("n")).withColumn("series", F.lit("all"))
    return O.seasonal(day, ["series"], "d", "n", 7).select("d", *(F.round(c, 5).alias(c) for c in ("trend", "seasonal", "residual")))


@query("win_half_trend", f"SELECT user_id, CASE WHEN b - a > 1 THEN 'worsening' WHEN a - b > 1 THEN 'improving' ELSE 'stable' END AS trend FROM (SELECT user_id, round(avg(CASE WHEN h = 1 THEN n END), 9) AS a, round(avg(CASE WHEN h = 2 THEN n END), 9) AS b FROM (SELECT user_id, n, ntile(2) OVER (PARTITION BY user_id ORDER BY d) AS h FROM {DAILY_SQL}) GROUP BY 1)")
def win_half_trend(t: Tables):
    d = daily(t).withColumn("h", F.ntile(2).over(W.partitionBy("user_id").orderBy("d"))).groupBy("user_id").agg(*(F.round(F.avg(F.when(C("h") == k, C("n"))), 9).alias(c) for k, c in ((1, "a"), (2, "b"))))
    return d.select("user_id", F.when(C("b") - C("a") > 1, "worsening").when(C("a") - C("b") > 1, "improving").otherwise("stable").alias("trend"))


@query("win_batch_id")
def win_batch_id(t: Tables):
    """Batches by a hash of the key instead of a numbering that would pass through one task."""
    return t.orders.select("o_orderkey", F.pmod(F.xxhash64("o_orderkey"), F.lit(16)).alias("batch")).groupBy("batch").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- order, top-k, sets


@query("sort_multi", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 ORDER BY 1, 3 DESC, 2")
def sort_multi(t: Tables):
    return t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).orderBy("c_nationkey", C("n").desc(), "c_mktsegment")


@query("topk_group_count", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def topk_group_count(t: Tables):
    return t.customer.filter("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count("*").alias("n")).orderBy(C("n").desc(), "c_nationkey").limit(5)


@query("topk_first", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def topk_first(t: Tables):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(C("n").desc(), "l_partkey").limit(1)


@query("topk_recent", "SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 10")
def topk_recent(t: Tables):
    return t.events.filter("event_type = 'error'").orderBy(C("ts").desc(), "event_id").select("event_id", "ts").limit(10)


@query("topk_per_group", "SELECT c_nationkey, c_custkey, CAST(r AS INTEGER) AS r FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 10")
def topk_per_group(t: Tables):
    return t.customer.select("c_nationkey", "c_custkey", F.row_number().over(W.partitionBy("c_nationkey").orderBy(C("c_acctbal").desc(), "c_custkey")).alias("r")).filter("r <= 10")


@query("set_union_all", "SELECT 'customer' AS source, CAST(c_nationkey AS INTEGER) AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier")
def set_union_all(t: Tables):
    return t.customer.select(F.lit("customer").alias("source"), C("c_nationkey").alias("nation")).unionByName(t.supplier.select(F.lit("supplier").alias("source"), C("s_nationkey").alias("nation")))


@query("set_union_missing", "SELECT event_id, user_id, NULL::INTEGER AS retry_count FROM events WHERE event_type = 'signup' UNION ALL SELECT event_id, NULL, CAST(user_id % 5 AS INTEGER) FROM events WHERE event_type = 'error'")
def set_union_missing(t: Tables):
    fresh = t.events.filter("event_type = 'signup'").select("event_id", "user_id")
    return fresh.unionByName(t.events.filter("event_type = 'error'").select("event_id", (C("user_id") % 5).cast("int").alias("retry_count")), allowMissingColumns=True)


@query("set_distinct", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def set_distinct(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber").dropDuplicates()


@query("set_schema_diff", "SELECT 'common' AS kind, 'o_orderkey' AS column_name, count(*) AS n FROM orders UNION ALL SELECT 'missing', 'o_totalprice', count(*) FROM orders UNION ALL SELECT 'added', 'price', count(*) FROM orders")
def set_schema_diff(t: Tables):
    before, after = t.orders.select("o_orderkey", "o_totalprice"), t.orders.select("o_orderkey", C("o_totalprice").alias("price"))
    a, b = set(before.columns), set(after.columns)
    rows = [(k, c) for k, s in (("common", a & b), ("missing", a - b), ("added", b - a)) for c in sorted(s)]
    return t.spark.createDataFrame(rows, "kind string, column_name string").crossJoin(t.orders.agg(F.count("*").alias("n")))


@query("set_except_rows", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except_rows(t: Tables):
    return t.customer.select(C("c_nationkey").alias("k")).exceptAll(t.supplier.select(C("s_nationkey").alias("k")))


@query("set_intersect_rows", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def set_intersect_rows(t: Tables):
    return t.customer.select(C("c_nationkey").alias("k")).intersectAll(t.supplier.select(C("s_nationkey").alias("k")))
