"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clinical as X
from ..operators import joins as J
from ..operators import profiles as P
from ..operators import quantiles as Q
from .registry import Tables, query
from .windows import DAILY_SQL, daily

C = F.col
LINES_SQL = "(SELECT o_custkey AS member, l_orderkey, l_linenumber, l_suppkey AS provider, l_partkey AS drug, CAST(l_shipdate AS DATE) AS d, l_extendedprice * (1 - l_discount) AS paid, l_quantity, o_orderpriority LIKE '1-%' AS er, o_orderstatus = 'F' AS inpatient FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def lines(t: Tables):
    j = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey"))
    return j.select(C("o_custkey").alias("member"), "l_orderkey", "l_linenumber", C("l_suppkey").alias("provider"), C("l_partkey").alias("drug"), C("l_shipdate").cast("date").alias("d"), (C("l_extendedprice") * (1 - C("l_discount"))).alias("paid"), "l_quantity", C("o_orderpriority").like("1-%").alias("er"), (C("o_orderstatus") == "F").alias("inpatient"))


@query("agg_util", f"SELECT member, count(*) AS claims, count(DISTINCT d) AS days, round(sum(paid), 6) AS total, round(avg(paid), 8) AS mean, round(max(paid), 8) AS most, CAST(sum(CASE WHEN er THEN 1 ELSE 0 END) AS BIGINT) AS er_visits, round(avg(CASE WHEN inpatient THEN paid END), 8) AS inpatient_mean FROM {LINES_SQL} WHERE d >= DATE '1997-08-01' GROUP BY 1")
def agg_util(t: Tables):
    return lines(t).filter(C("d") >= F.lit("1997-08-01").cast("date")).groupBy("member").agg(F.count("*").alias("claims"), F.countDistinct("d").alias("days"), F.round(F.sum("paid"), 6).alias("total"), F.round(F.avg("paid"), 8).alias("mean"), F.round(F.max("paid"), 8).alias("most"), F.count_if("er").alias("er_visits"), F.round(F.avg(F.when(C("inpatient"), C("paid"))), 8).alias("inpatient_mean"))


@query("agg_flags_pivot", "SELECT o_custkey AS member, max(CASE WHEN p_type LIKE '%A%' THEN 1 ELSE 0 END) AS has_a, max(CASE WHEN p_brand LIKE '%#1%' THEN 1 ELSE 0 END) AS has_b, max(CASE WHEN p_size > 40 THEN 1 ELSE 0 END) AS has_c, count(DISTINCT p_brand) AS kinds FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1")
def agg_flags_pivot(t: Tables):
    j = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).join(t.part, C("l_partkey") == C("p_partkey"))
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    return j.groupBy(C("o_custkey").alias("member")).agg(flag(C("p_type").like("%A%")).alias("has_a"), flag(C("p_brand").like("%#1%")).alias("has_b"), flag(C("p_size") > 40).alias("has_c"), F.countDistinct("p_brand").alias("kinds"))


@query("agg_mutation_flags", "SELECT user_id, max(CASE WHEN props LIKE '%1%' THEN 1 ELSE 0 END) AS m1, max(CASE WHEN props LIKE '%22%' THEN 1 ELSE 0 END) AS m2, count(DISTINCT props) AS n FROM events GROUP BY 1")
def agg_mutation_flags(t: Tables):
    return t.events.groupBy("user_id").agg(F.max(F.when(C("props").like("%1%"), 1).otherwise(0)).alias("m1"), F.max(F.when(C("props").like("%22%"), 1).otherwise(0)).alias("m2"), F.countDistinct("props").alias("n"))


@query("agg_multitarget", "SELECT user_id, min(value) AS lo, max(value) AS hi, round(avg(value), 9) AS mean, count(DISTINCT event_type) AS targets, CAST(sum(CASE WHEN value <= 40 THEN 1 ELSE 0 END) AS BIGINT) AS detected, min(CASE WHEN event_type = 'click' THEN value END) AS click, min(CASE WHEN event_type = 'view' THEN value END) AS view FROM events GROUP BY 1")
def agg_multitarget(t: Tables):
    of = lambda k: F.min(F.when(C("event_type") == k, C("value")))
    return t.events.groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 9).alias("mean"), F.countDistinct("event_type").alias("targets"), F.count_if(C("value") <= 40).alias("detected"), of("click").alias("click"), of("view").alias("view"))


@query("agg_pivot", "SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS view FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY 1")
def agg_pivot(t: Tables):
    last = F.max_by("value", F.struct("ts", "event_id"))
    return t.events.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(last)


@query("agg_period", f"SELECT member, round(sum(CASE WHEN d >= DATE '1998-02-01' THEN paid ELSE 0 END), 6) AS recent, round(sum(CASE WHEN d < DATE '1998-02-01' THEN paid ELSE 0 END), 6) AS prior, round(100 * (sum(CASE WHEN d >= DATE '1998-02-01' THEN paid ELSE 0 END) / 181 / nullif(sum(CASE WHEN d < DATE '1998-02-01' THEN paid ELSE 0 END) / 184, 0) - 1), 8) AS trend_pct FROM {LINES_SQL} WHERE d BETWEEN DATE '1997-08-01' AND DATE '1998-07-31' GROUP BY 1")
def agg_period(t: Tables):
    at = F.lit("1998-02-01").cast("date")
    d = lines(t).filter(C("d").between(F.lit("1997-08-01").cast("date"), F.lit("1998-07-31").cast("date")))
    g = d.groupBy("member").agg(F.sum(F.when(C("d") >= at, C("paid")).otherwise(0)).alias("a"), F.sum(F.when(C("d") < at, C("paid")).otherwise(0)).alias("b"))
    return g.select("member", F.round("a", 6).alias("recent"), F.round("b", 6).alias("prior"), X.rounded(100 * (F.try_divide(C("a") / 181, F.nullif(C("b") / 184, F.lit(0.0))) - 1), 8).alias("trend_pct"))


@query("agg_recency", f"SELECT member, CAST(date_diff('day', max(d), DATE '2001-12-01') AS INTEGER) AS any_, CAST(date_diff('day', max(CASE WHEN er THEN d END), DATE '2001-12-01') AS INTEGER) AS er_, CAST(date_diff('day', max(CASE WHEN inpatient THEN d END), DATE '2001-12-01') AS INTEGER) AS inpatient_ FROM {LINES_SQL} GROUP BY 1")
def agg_recency(t: Tables):
    at = F.lit("2001-12-01").cast("date")
    since = lambda c: F.datediff(at, F.max(c))
    return lines(t).groupBy("member").agg(since(C("d")).alias("any_"), since(F.when(C("er"), C("d"))).alias("er_"), since(F.when(C("inpatient"), C("d"))).alias("inpatient_"))


@query("agg_device_daily", "SELECT user_id, CAST(ts AS DATE) AS d, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN value > 75 THEN 1 ELSE 0 END) AS BIGINT) AS warnings, count(*) AS volume, max(CASE WHEN event_type = 'signup' THEN ts END) AS last_calibration FROM events GROUP BY 1, 2")
def agg_device_daily(t: Tables):
    return t.events.groupBy("user_id", C("ts").cast("date").alias("d")).agg(F.count_if(C("event_type") == "error").alias("errors"), F.count_if(C("value") > 75).alias("warnings"), F.count("*").alias("volume"), F.max(F.when(C("event_type") == "signup", C("ts"))).alias("last_calibration"))


@query("agg_qc_daily", "SELECT user_id % 10 AS device, CAST(ts AS DATE) AS d, round(avg(CASE WHEN value BETWEEN 10 AND 90 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM events GROUP BY 1, 2")
def agg_qc_daily(t: Tables):
    return t.events.groupBy((C("user_id") % 10).alias("device"), C("ts").cast("date").alias("d")).agg(F.round(F.avg(F.when(C("value").between(10, 90), 1.0).otherwise(0.0)), 6).alias("pass_rate"))


@query("agg_positivity_daily", "SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS tests, CAST(sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) AS BIGINT) AS positives, round(100.0 * sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) / count(*), 4) AS pct FROM events GROUP BY 1, 2")
def agg_positivity_daily(t: Tables):
    hits = F.count_if(C("value") < 20)
    return t.events.groupBy("event_type", C("ts").cast("date").alias("d")).agg(F.count("*").alias("tests"), hits.alias("positives"), F.round(100.0 * hits / F.count("*"), 4).alias("pct"))


@query("agg_two_level", "SELECT event_type, round(var_samp(m), 5) AS between_var FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def agg_two_level(t: Tables):
    return t.events.groupBy("event_type", "user_id").agg(F.avg("value").alias("m")).groupBy("event_type").agg(F.round(F.var_samp("m"), 5).alias("between_var"))


@query("agg_geo_levels", "SELECT CASE WHEN GROUPING(n_name) = 0 THEN 'county' WHEN GROUPING(r_name) = 0 THEN 'state' ELSE 'national' END AS level, r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())")
def agg_geo_levels(t: Tables):
    j = t.customer.join(F.broadcast(t.nation), C("c_nationkey") == C("n_nationkey")).join(F.broadcast(t.region), C("n_regionkey") == C("r_regionkey"))
    level = F.when(F.grouping("n_name") == 0, "county").when(F.grouping("r_name") == 0, "state").otherwise("national")
    return j.rollup("r_name", "n_name").agg(level.alias("level"), F.count("*").alias("n")).select("level", "r_name", "n_name", "n")


@query("agg_variant_mix", "SELECT p_brand, count(*) AS n, round(avg(l_quantity), 5) AS coverage, round(avg(l_discount), 7) AS ct FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def agg_variant_mix(t: Tables):
    return t.lineitem.join(t.part, C("l_partkey") == C("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 5).alias("coverage"), F.round(F.avg("l_discount"), 7).alias("ct"))


_W = "CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS DATE)"
_WK = "count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 9) AS mean, round(stddev(value), 7) AS sd, min(value) AS lo, max(value) AS hi, median(value) AS med, count(DISTINCT user_id) AS facilities"


def _weekly(t: Tables, *keys):
    d = t.events.select(*keys, X.week_start(C("ts").cast("date")).alias("w"), "value", "user_id")
    by = [c for c in d.columns if c not in ("value", "user_id")]
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 9).alias("mean"), F.round(F.stddev("value"), 7).alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.countDistinct("user_id").alias("facilities"))
    return g.join(Q.quantiles(d, by, "value", {"med": 0.5}), by)


@query("agg_weekly_facility", f"SELECT user_id AS facility, {_W} AS w, {_WK} FROM events GROUP BY 1, 2")
def agg_weekly_facility(t: Tables):
    return _weekly(t, C("user_id").alias("facility"))


@query("agg_weekly_state", f"SELECT user_id % 25 AS state, {_W} AS w, {_WK} FROM events GROUP BY 1, 2")
def agg_weekly_state(t: Tables):
    return _weekly(t, (C("user_id") % 25).alias("state"))


@query("agg_weekly_region", f"SELECT user_id % 5 AS region, {_W} AS w, {_WK} FROM events GROUP BY 1, 2")
def agg_weekly_region(t: Tables):
    return _weekly(t, (C("user_id") % 5).alias("region"))


@query("agg_baseline", f"SELECT state, round(avg(n), 6) AS mean, round(stddev(n), 6) AS sd, median(n) AS med FROM (SELECT user_id % 25 AS state, {_W} AS w, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 4")
def agg_baseline(t: Tables):
    d = t.events.groupBy((C("user_id") % 25).alias("state"), X.week_start(C("ts").cast("date")).alias("w")).agg(F.count("*").alias("n"))
    return d.groupBy("state").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev("n"), 6).alias("sd"), F.median("n").alias("med"), F.count("*").alias("k")).filter("k >= 4").drop("k")


@query("agg_iqr", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM events GROUP BY 1")
def agg_iqr(t: Tables):
    q = Q.quantiles(t.events, ["event_type"], "value", {"q1": 0.25, "q3": 0.75})
    return q.select("event_type", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"), F.round(C("q3") - C("q1"), 6).alias("iqr"))


@query("agg_baseline_pct")
def agg_baseline_pct(t: Tables):
    """Approximate quartiles, as the feature asks for; bounded memory per group."""
    return t.events.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev("value").alias("sd"), F.percentile_approx("value", [0.25, 0.5, 0.75], 10000).alias("quartiles"))


_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, count(*) - count({c}) AS nulls, round(avg({c}), 4) AS mean, round(stddev({c}), 4) AS sd, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3 FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount"))


@query("agg_profile", _PROFILE)
def agg_profile(t: Tables):
    p = P.numbers(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return p.withColumns({c: F.round(c, 4) for c in ("mean", "sd", "q1", "median", "q3")})


_MODE = " UNION ALL ".join(f"SELECT '{c}' AS column_name, (SELECT count(DISTINCT {c}) FROM lineitem) AS n_distinct, v AS mode, n AS mode_n FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)" for c in ("l_returnflag", "l_linenumber", "l_partkey"))


@query("agg_profile_modes", _MODE)
def agg_profile_modes(t: Tables):
    """Distinct values and the commonest value of each column."""
    return P.modes(t.lineitem, ["l_returnflag", "l_linenumber", "l_partkey"])


@query("agg_repeated_rows", "SELECT 'all columns' AS within, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n - 1) AS BIGINT) AS repeated FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) UNION ALL SELECT 'order and part', CAST(sum(n) AS BIGINT), CAST(sum(n - 1) AS BIGINT) FROM (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def agg_repeated_rows(t: Tables):
    return P.repeated_rows(t.lineitem).select(F.lit("all columns").alias("within"), "n", "repeated").unionByName(P.repeated_rows(t.lineitem, ["l_orderkey", "l_partkey"]).select(F.lit("order and part").alias("within"), "n", "repeated"))


@query("agg_completeness", "SELECT 'ts' AS column_name, count(*) AS n, CAST(0 AS BIGINT) AS missing, 0.0 AS pct_missing FROM events UNION ALL SELECT 'buyer', count(*), CAST(sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) AS BIGINT), round(100.0 * sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) / count(*), 6) FROM events")
def agg_completeness(t: Tables):
    return P.missing(t.events, {"ts": C("ts"), "buyer": F.when(C("event_type") == "purchase", C("user_id"))})


@query("agg_range_violations", "SELECT 'value_high' AS violation, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events WHERE value > 90 UNION ALL SELECT 'value_low', count(*), min(value), max(value) FROM events WHERE value < 1")
def agg_range_violations(t: Tables):
    rules = {"value_high": C("value") > 90, "value_low": C("value") < 1}
    one = t.events.agg(*(f(F.when(c, C("value"))).alias(f"{n}__{m}") for n, c in rules.items() for m, f in (("n", F.count), ("lo", F.min), ("hi", F.max))))
    return P.long_form(one, list(rules), {"n": "long", "lo": "double", "hi": "double"}).withColumnRenamed("column_name", "violation")


@query("agg_dataset_summary", "SELECT count(*) AS n, count(DISTINCT user_id) AS facilities, count(DISTINCT user_id % 25) AS states, count(DISTINCT user_id % 5) AS regions, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def agg_dataset_summary(t: Tables):
    return t.events.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("facilities"), F.countDistinct(C("user_id") % 25).alias("states"), F.countDistinct(C("user_id") % 5).alias("regions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("agg_dup_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def agg_dup_keys(t: Tables):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("agg_conflicts", "SELECT l_orderkey, l_linenumber, count(DISTINCT l_returnflag) AS statuses, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS found FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1")
def agg_conflicts(t: Tables):
    s = F.array_sort(F.collect_set("l_returnflag"))  # one of three values each
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(s.alias("s")).filter(F.size("s") > 1).select("l_orderkey", "l_linenumber", F.size("s").cast("long").alias("statuses"), F.array_join("s", ",").alias("found"))


@query("agg_crosstab", "SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o FROM lineitem GROUP BY 1")
def agg_crosstab(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(C("l_linestatus") == "F").alias("f"), F.count_if(C("l_linestatus") == "O").alias("o"))


@query("agg_key_skew", "SELECT k, n, round(100.0 * n / total, 6) AS pct, n > 0.3 * total AS skewed FROM (SELECT l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1), (SELECT count(*) AS total FROM lineitem)")
def agg_key_skew(t: Tables):
    by = t.lineitem.groupBy(C("l_returnflag").alias("k")).agg(F.count("*").alias("n"))
    total = t.lineitem.agg(F.count("*").alias("total"))
    return by.orderBy(C("n").desc(), "k").limit(1).crossJoin(F.broadcast(total)).select("k", "n", F.round(100.0 * C("n") / C("total"), 6).alias("pct"), (C("n") > 0.3 * C("total")).alias("skewed"))


@query("agg_partition_skew")
def agg_partition_skew(t: Tables):
    """Rows per partition of a shuffle by key, and the largest against the mean."""
    rows = t.lineitem.select("l_suppkey").repartition(16, "l_suppkey").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    return rows.agg(F.count("*").alias("partitions"), F.sum("n").alias("n"), F.max("n").alias("most"), (F.max("n") / F.avg("n")).alias("skew"))


@query("agg_counts_recon", "SELECT s, m, round(100.0 * m / s, 4) AS pct FROM (SELECT count(*) AS s FROM orders), (SELECT count(*) AS m FROM orders WHERE o_orderkey % 50 <> 0)")
def agg_counts_recon(t: Tables):
    # one pass: the target is marked, not read again
    return t.orders.agg(F.count("*").alias("s"), F.count_if(C("o_orderkey") % 50 != 0).alias("m")).withColumn("pct", F.round(100.0 * C("m") / C("s"), 4))


@query("agg_health_recent", "SELECT round(avg(n), 4) AS throughput, CAST(sum(err) AS BIGINT) AS errors, sum(err) > 100 AS alert FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS err FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 5)")
def agg_health_recent(t: Tables):
    day = t.events.groupBy(C("ts").cast("date").alias("d")).agg(F.count("*").alias("n"), F.count_if(C("event_type") == "error").alias("err"))
    return day.orderBy(C("d").desc()).limit(5).agg(F.round(F.avg("n"), 4).alias("throughput"), F.sum("err").alias("errors"), (F.sum("err") > 100).alias("alert"))


@query("agg_latest_kpi", "WITH m AS (SELECT max(CAST(ts AS DATE)) AS last FROM events) SELECT count(*) FILTER (CAST(ts AS DATE) = last) AS today, count(*) FILTER (CAST(ts AS DATE) = last - 7) AS week_ago, count(*) FILTER (CAST(ts AS DATE) = last) - count(*) FILTER (CAST(ts AS DATE) = last - 7) AS change FROM events, m")
def agg_latest_kpi(t: Tables):
    last = t.events.agg(F.max(C("ts").cast("date")).alias("last"))
    d = t.events.select(C("ts").cast("date").alias("d")).crossJoin(F.broadcast(last))
    return d.agg(F.count_if(C("d") == C("last")).alias("today"), F.count_if(C("d") == F.date_sub("last", 7)).alias("week_ago")).withColumn("change", C("today") - C("week_ago"))


@query("agg_capacity", f"SELECT count(*) AS facilities, round(sum(v), 2) AS used, median(n) AS med, max(n) AS most, CAST(sum(CASE WHEN v > 50 * n THEN 1 ELSE 0 END) AS BIGINT) AS high FROM {DAILY_SQL}")
def agg_capacity(t: Tables):
    return daily(t).agg(F.count("*").alias("facilities"), F.round(F.sum("v"), 2).alias("used"), F.max("n").alias("most"), F.count_if(C("v") > 50 * C("n")).alias("high")).crossJoin(Q.quantiles(daily(t), [], "n", {"med": 0.5}))


@query("agg_by_type", "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, round(stddev(c_acctbal), 4) AS sd FROM customer GROUP BY 1")
def agg_by_type(t: Tables):
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.sum("c_acctbal"), 2).alias("total"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.stddev("c_acctbal"), 4).alias("sd"))


@query("agg_outbreak", f"SELECT user_id, n > greatest(m + 2 * s, 3) AS outbreak FROM (SELECT user_id, d, n, row_number() OVER (PARTITION BY user_id ORDER BY d DESC) AS r, avg(n) OVER (PARTITION BY user_id) AS m, stddev(n) OVER (PARTITION BY user_id) AS s FROM {DAILY_SQL}) WHERE r = 1 AND s IS NOT NULL")
def agg_outbreak(t: Tables):
    g = daily(t).groupBy("user_id").agg(F.avg("n").alias("m"), F.stddev("n").alias("s"), F.max_by("n", "d").alias("n")).filter("s is not null")
    return g.select("user_id", (C("n") > F.greatest(C("m") + 2 * C("s"), F.lit(3.0))).alias("outbreak"))


@query("agg_outreach_geo", "SELECT c_nationkey, count(*) AS members, round(avg(c_acctbal), 4) AS score FROM customer WHERE c_acctbal > 2000 GROUP BY 1 HAVING count(*) >= 10")
def agg_outreach_geo(t: Tables):
    return t.customer.filter("c_acctbal > 2000").groupBy("c_nationkey").agg(F.count("*").alias("members"), F.round(F.avg("c_acctbal"), 4).alias("score")).filter("members >= 10")


@query("agg_factor_union", "SELECT 'segment' AS factor, c_mktsegment AS level, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), count(*), round(avg(c_acctbal), 4) FROM customer GROUP BY c_nationkey")
def agg_factor_union(t: Tables):
    # each row is counted under both factors in one aggregate
    f = F.explode(F.array(F.struct(F.lit("segment").alias("factor"), C("c_mktsegment").alias("level")), F.struct(F.lit("nation").alias("factor"), C("c_nationkey").cast("string").alias("level"))))
    return t.customer.select("c_acctbal", f.alias("f")).groupBy("f.factor", "f.level").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("agg_roi", "SELECT c_mktsegment AS tier, count(*) AS members, round(sum(c_acctbal), 2) AS cost, round(sum(c_acctbal) * 0.15, 2) AS prevented, round(sum(c_acctbal) * 0.15 - count(*) * 50, 2) AS savings, round(sum(c_acctbal) * 0.15 / (count(*) * 50), 6) AS ratio FROM customer GROUP BY 1")
def agg_roi(t: Tables):
    s, n = F.sum("c_acctbal"), F.count("*")
    return t.customer.groupBy(C("c_mktsegment").alias("tier")).agg(n.alias("members"), F.round(s, 2).alias("cost"), F.round(s * 0.15, 2).alias("prevented"), F.round(s * 0.15 - n * 50, 2).alias("savings"), F.round(s * 0.15 / (n * 50), 6).alias("ratio"))


@query("agg_drift_pct", "SELECT event_type, round(a, 5) AS reference, round(b, 5) AS recent, round(100 * (b - a) / a, 5) AS pct, abs(100 * (b - a) / a) > 10 AS retrain FROM (SELECT event_type, avg(CASE WHEN ts < TIMESTAMP '2024-01-15' THEN value END) AS a, avg(CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN value END) AS b FROM events GROUP BY 1)")
def agg_drift_pct(t: Tables):
    old = C("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    g = t.events.groupBy("event_type").agg(F.avg(F.when(old, C("value"))).alias("a"), F.avg(F.when(~old, C("value"))).alias("b"))
    pct = 100 * (C("b") - C("a")) / C("a")
    return g.select("event_type", F.round("a", 5).alias("reference"), F.round("b", 5).alias("recent"), F.round(pct, 5).alias("pct"), (F.abs(pct) > 10).alias("retrain"))


@query("agg_layer_quality", "SELECT 'orders' AS layer, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'P' THEN 0.5 ELSE 1.0 END), 6) AS quality FROM orders UNION ALL SELECT 'lineitem', count(*), round(avg(CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE 1.0 END), 6) FROM lineitem")
def agg_layer_quality(t: Tables):
    one = lambda df, name, bad: df.agg(F.lit(name).alias("layer"), F.count("*").alias("n"), F.round(F.avg(F.when(bad, 0.5).otherwise(1.0)), 6).alias("quality"))
    return one(t.orders, "orders", C("o_orderstatus") == "P").unionByName(one(t.lineitem, "lineitem", C("l_returnflag") == "R"))


@query("agg_claims_summary", f"SELECT count(*) AS claims, count(DISTINCT member) AS members, CAST(sum(CASE WHEN er THEN 1 ELSE 0 END) AS BIGINT) AS er, CAST(sum(CASE WHEN inpatient THEN 1 ELSE 0 END) AS BIGINT) AS inpatient, round(sum(paid), 0) AS paid, round(avg(l_quantity), 5) AS los FROM {LINES_SQL}")
def agg_claims_summary(t: Tables):
    return lines(t).agg(F.count("*").alias("claims"), F.countDistinct("member").alias("members"), F.count_if("er").alias("er"), F.count_if("inpatient").alias("inpatient"), F.round(F.sum("paid"), 0).alias("paid"), F.round(F.avg("l_quantity"), 5).alias("los"))


@query("agg_patient_summary", "SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS active, arg_max(value, event_id) AS last_value FROM events GROUP BY 1")
def agg_patient_summary(t: Tables):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(C("event_type") == "purchase").alias("active"), F.max_by("value", "event_id").alias("last_value"))


@query("agg_cohort_latest", "SELECT user_id FROM (SELECT user_id, arg_max(value, event_id) AS v FROM events GROUP BY 1) WHERE v >= 40")
def agg_cohort_latest(t: Tables):
    return t.events.groupBy("user_id").agg(F.max_by("value", "event_id").alias("v")).filter("v >= 40").select("user_id")


@query("agg_quality_report", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS patients, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS p FROM orders")
def agg_quality_report(t: Tables):
    return t.orders.agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("patients"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"), *(F.count_if(C("o_orderstatus") == k).alias(k.lower()) for k in "FOP"))


@query("agg_state_summary", "SELECT n_name, count(DISTINCT s_suppkey) AS facilities, round(avg(s_acctbal), 4) AS mean, CAST(sum(CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def agg_state_summary(t: Tables):
    return t.supplier.join(F.broadcast(t.nation), C("s_nationkey") == C("n_nationkey")).groupBy("n_name").agg(F.countDistinct("s_suppkey").alias("facilities"), F.round(F.avg("s_acctbal"), 4).alias("mean"), F.count_if(C("s_acctbal") < 0).alias("negative"))


@query("agg_review_metrics", "SELECT d.source, count(*) AS n, round(avg(CASE WHEN (l.quality = 1) = (d.n_chars > 300) THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(avg(l.quality), 6) AS rating FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1")
def agg_review_metrics(t: Tables):
    j = t.labels.join(t.documents.select("doc_id", "source", "n_chars"), "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.when((C("quality") == 1) == (C("n_chars") > 300), 1.0).otherwise(0.0)), 6).alias("agreement"), F.round(F.avg("quality"), 6).alias("rating"))


@query("agg_trial_arms", "SELECT user_id % 2 AS arm, count(*) AS n, round(avg(value), 6) AS mean, round(stddev(value), 6) AS sd, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events GROUP BY 1")
def agg_trial_arms(t: Tables):
    return t.events.groupBy((C("user_id") % 2).alias("arm")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev("value"), 6).alias("sd"), F.count_if(C("event_type") == "error").alias("errors"))


@query("agg_kpi_summary", "SELECT round(avg(value), 6) AS mean, median(value) AS med, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS rate, round(0.5 * avg(value) / 100 + 0.5 * avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS composite FROM events")
def agg_kpi_summary(t: Tables):
    rate = F.avg(F.when(C("event_type") == "purchase", 1.0).otherwise(0.0))
    return t.events.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(rate, 6).alias("rate"), F.round(0.5 * F.avg("value") / 100 + 0.5 * rate, 6).alias("composite")).crossJoin(Q.quantiles(t.events, [], "value", {"med": 0.5}))


@query("agg_adherence", f"SELECT user_id, count(*) AS active_days, CAST(sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS full_days, round(count(*) / 30.0, 6) AS rate, CASE WHEN count(*) / 30.0 >= 0.8 THEN 'high' WHEN count(*) / 30.0 >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM {DAILY_SQL} GROUP BY 1")
def agg_adherence(t: Tables):
    g = daily(t).groupBy("user_id").agg(F.count("*").alias("active_days"), F.count_if(C("n") >= 3).alias("full_days"))
    rate = C("active_days") / 30.0
    return g.select("*", F.round(rate, 6).alias("rate"), X.ladder(rate, [(0.8, "high"), (0.5, "medium")], "low", ">=").alias("band"))


@query("agg_funnel", "SELECT CAST(ts AS DATE) AS d, count(DISTINCT user_id) AS enrolled, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS engaged FROM events GROUP BY 1")
def agg_funnel(t: Tables):
    return t.events.groupBy(C("ts").cast("date").alias("d")).agg(F.countDistinct("user_id").alias("enrolled"), F.countDistinct(F.when(C("event_type") == "purchase", C("user_id"))).alias("engaged"))


@query("agg_trajectory", "SELECT user_id % 2 AS arm, CAST(ts AS DATE) AS d, count(*) AS n, round(avg(value), 6) AS mean, round(1.96 * stddev(value) / sqrt(count(*)), 6) AS half_ci FROM events GROUP BY 1, 2")
def agg_trajectory(t: Tables):
    return t.events.groupBy((C("user_id") % 2).alias("arm"), C("ts").cast("date").alias("d")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(1.96 * F.stddev("value") / F.sqrt(F.count("*")), 6).alias("half_ci"))


@query("agg_risk_summary", "SELECT level, count(*) AS n, round(avg(p), 6) AS mean FROM (SELECT CASE WHEN value >= 80 THEN 'CRITICAL' WHEN value >= 60 THEN 'HIGH' WHEN value >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS level, value AS p FROM events) GROUP BY 1")
def agg_risk_summary(t: Tables):
    return t.events.groupBy(X.ladder(C("value"), [(80, "CRITICAL"), (60, "HIGH"), (30, "MEDIUM")], "LOW", ">=").alias("level")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("agg_patient_report", "SELECT user_id, arg_max(value, event_id) AS last_value, round(arg_max(value, event_id) - arg_min(value, event_id), 4) AS change, abs(arg_max(value, event_id) - arg_min(value, event_id)) >= 2 AS clinically_important FROM events GROUP BY 1")
def agg_patient_report(t: Tables):
    a, b = F.max_by("value", "event_id"), F.min_by("value", "event_id")
    return t.events.groupBy("user_id").agg(a.alias("last_value"), X.rounded(a - b, 4).alias("change"), (F.abs(a - b) >= 2).alias("clinically_important"))


@query("agg_lift", "SELECT c_mktsegment, round(r, 6) AS rate, round(r / total, 6) AS lift FROM (SELECT c_mktsegment, avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END) AS r FROM customer GROUP BY 1), (SELECT avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END) AS total FROM customer)")
def agg_lift(t: Tables):
    churn = F.when(C("c_acctbal") < 0, 1.0).otherwise(0.0)
    g = t.customer.groupBy("c_mktsegment").agg(F.avg(churn).alias("r"), F.sum(churn).alias("s"), F.count("*").alias("n"))
    everyone = W.partitionBy(F.lit(0))  # a few segments
    return g.select("c_mktsegment", F.round("r", 6).alias("rate"), F.round(C("r") / (F.sum("s").over(everyone) / F.sum("n").over(everyone)), 6).alias("lift"))


@query("agg_revenue_loss", "SELECT count(*) AS churned, round(avg(c_acctbal), 4) AS mean, round(sum(c_acctbal) * 12, 2) AS annual, round(sum(c_acctbal) * 12 * 0.2, 2) AS saved FROM customer WHERE c_acctbal < 0")
def agg_revenue_loss(t: Tables):
    s = F.sum("c_acctbal") * 12
    return t.customer.filter("c_acctbal < 0").agg(F.count("*").alias("churned"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(s, 2).alias("annual"), F.round(s * 0.2, 2).alias("saved"))


@query("agg_retry_health", "SELECT count(*) AS backlog, round(avg(user_id % 6), 6) AS mean_retries, max(user_id % 6) AS most_retries, min(ts) AS next_ready FROM events WHERE event_type = 'error'")
def agg_retry_health(t: Tables):
    r = C("user_id") % 6
    return t.events.filter("event_type = 'error'").agg(F.count("*").alias("backlog"), F.round(F.avg(r), 6).alias("mean_retries"), F.max(r).alias("most_retries"), F.min("ts").alias("next_ready"))


@query("agg_retry_errors", "SELECT CASE WHEN value < 30 THEN 'timeout' WHEN value < 60 THEN 'bad payload' ELSE 'no route' END AS message, count(*) AS n, round(avg(user_id % 6), 6) AS mean_retries, max(ts) AS last_seen FROM events WHERE event_type = 'error' GROUP BY 1")
def agg_retry_errors(t: Tables):
    """The queue's errors by their message."""
    message = F.when(C("value") < 30, "timeout").when(C("value") < 60, "bad payload").otherwise("no route")
    return t.events.filter("event_type = 'error'").groupBy(message.alias("message")).agg(F.count("*").alias("n"), F.round(F.avg(C("user_id") % 6), 6).alias("mean_retries"), F.max("ts").alias("last_seen"))


@query("agg_retry_daily", "SELECT CAST(ts AS DATE) AS d, count(*) AS tried, count_if(user_id % 6 < 4) AS succeeded, round(100.0 * count_if(user_id % 6 < 4) / count(*), 5) AS pct FROM events WHERE event_type = 'error' GROUP BY 1")
def agg_retry_daily(t: Tables):
    """Tries and successes by day."""
    ok = F.count_if(C("user_id") % 6 < 4)
    return t.events.filter("event_type = 'error'").groupBy(C("ts").cast("date").alias("d")).agg(F.count("*").alias("tried"), ok.alias("succeeded"), F.round(100.0 * ok / F.count("*"), 5).alias("pct"))


@query("agg_stream_quality", "SELECT event_type, round(avg((CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END + 1.0) / 2), 6) AS completeness FROM events GROUP BY 1")
def agg_stream_quality(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.avg(X.completeness(F.when(C("value") > 5, C("value")), C("ts"))), 6).alias("completeness"))


@query("agg_null_matrix", "SELECT count(*) - count(o_orderkey) AS o_orderkey, count(*) - count(nullif(o_orderstatus, 'P')) AS o_orderstatus, count(*) - count(o_totalprice) AS o_totalprice FROM orders")
def agg_null_matrix(t: Tables):
    d = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_totalprice")
    return d.agg(*(F.count_if(C(c).isNull()).alias(c) for c in d.columns))


@query("agg_global_cluster", "SELECT s_nationkey AS cluster, round(avg(30.0 + s_suppkey % 15), 6) AS lat, round(avg(-100.0 + s_suppkey % 30), 6) AS lon, count(*) AS observed, round((SELECT count(*) FROM supplier) / 25.0, 6) AS expected, round(count(*) / ((SELECT count(*) FROM supplier) / 25.0), 6) AS relative_risk, round(CASE WHEN count(*) > (SELECT count(*) FROM supplier) / 25.0 THEN count(*) * ln(count(*) / ((SELECT count(*) FROM supplier) / 25.0)) ELSE 0 END, 6) AS llr FROM supplier GROUP BY 1")
def agg_global_cluster(t: Tables):
    e = t.supplier.agg((F.count("*") / 25.0).alias("e"))
    g = t.supplier.groupBy(C("s_nationkey").alias("cluster")).agg(F.round(F.avg(30.0 + C("s_suppkey") % 15), 6).alias("lat"), F.round(F.avg(-100.0 + C("s_suppkey") % 30), 6).alias("lon"), F.count("*").alias("observed"))
    return g.crossJoin(F.broadcast(e)).select("cluster", "lat", "lon", "observed", F.round("e", 6).alias("expected"), F.round(C("observed") / C("e"), 6).alias("relative_risk"), F.round(F.when(C("observed") > C("e"), C("observed") * F.log(C("observed") / C("e"))).otherwise(0.0), 6).alias("llr"))


_WEIGHT = "CASE event_type WHEN 'click' THEN 0.3 WHEN 'view' THEN 0.3 WHEN 'purchase' THEN 0.2 ELSE 0.2 END"


@query("agg_agreement", f"""SELECT region, signals, agreement, CASE WHEN s >= 9 THEN 'critical' WHEN s >= 6 THEN 'high' WHEN s >= 3 THEN 'moderate' ELSE 'low' END AS severity FROM (SELECT *, CASE WHEN signals >= 4 THEN 3 WHEN signals >= 3 THEN 2 WHEN signals >= 2 THEN 1 ELSE 0 END + CASE WHEN agreement >= 0.8 THEN 3 WHEN agreement >= 0.6 THEN 2 WHEN agreement >= 0.4 THEN 1 ELSE 0 END + CASE WHEN z >= 5 THEN 3 WHEN z >= 4 THEN 2 WHEN z >= 3.5 THEN 1 ELSE 0 END AS s
 FROM (SELECT user_id AS region, count(DISTINCT event_type) AS signals, round(sum(w * c), 6) AS agreement, round(max(z), 6) AS z FROM (SELECT user_id, event_type, {_WEIGHT} AS w, least(max(value) / 100, 1.0) AS c, max(value) / 25 AS z FROM events GROUP BY 1, 2) GROUP BY 1))""")
def agg_agreement(t: Tables):
    w = F.when(C("event_type").isin("click", "view"), 0.3).otherwise(0.2)
    one = t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    g = one.groupBy(C("user_id").alias("region")).agg(F.countDistinct("event_type").alias("signals"), F.round(F.sum(w * F.least(C("v") / 100, F.lit(1.0))), 6).alias("agreement"), F.round(F.max(C("v") / 25), 6).alias("z"))
    return g.select("region", "signals", "agreement", X.severity(C("signals"), C("agreement"), C("z"), F.lit(None).cast("double")).alias("severity"))


@query("agg_narrative_stats", "SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, CAST(sum(CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS long_texts FROM documents GROUP BY 1")
def agg_narrative_stats(t: Tables):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count_if(C("n_chars") > 5000).alias("long_texts"))


@query("agg_latest_vitals_newest", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def agg_latest_vitals_newest(t: Tables):
    return J.newest(t.events, ["event_type"], C("ts").desc(), C("event_id")).select("event_type", "event_id", "value")
