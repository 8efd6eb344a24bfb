"""Whole reports: the weekly share report, and the member medallion."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clinical as X
from .registry import Tables, query

C = F.col


@query("weekly_share", """WITH c AS (SELECT CASE WHEN GROUPING(n_name) = 0 THEN 'county' WHEN GROUPING(r_name) = 0 THEN 'state' ELSE 'national' END AS level, coalesce(n_name, r_name, 'ALL') AS area, CAST(CAST(ts AS DATE) + CAST(6 - dayofweek(ts) AS INTEGER) AS DATE) AS week_ending, event_type, count(*) AS n
 FROM events JOIN nation ON n_nationkey = user_id % 25 JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name, week_ending, event_type), (r_name, week_ending, event_type), (week_ending, event_type)))
 SELECT level, area, week_ending, event_type, n, round(100.0 * n / total, 6) AS pct, CAST(r AS INTEGER) AS rank, r = 1 AS dominant FROM (SELECT *, sum(n) OVER (PARTITION BY level, area, week_ending) AS total, row_number() OVER (PARTITION BY level, area, week_ending ORDER BY n DESC, event_type) AS r FROM c) WHERE n >= 5""")
def weekly_share(t: Tables):
    """Weekly counts of each kind by nation, region and overall; shares of the count before the small ones are left out, and ranks."""
    e = t.events.select((C("user_id") % 25).cast("int").alias("n_nationkey"), X.epi_week(C("ts").cast("date")).alias("week_ending"), "event_type")
    e = e.groupBy("n_nationkey", "week_ending", "event_type").agg(F.count("*").alias("n"))  # the events are shuffled once, summed
    j = e.join(F.broadcast(t.nation), "n_nationkey").join(F.broadcast(t.region), C("n_regionkey") == C("r_regionkey"))
    sets = [["r_name", "n_name", "week_ending", "event_type"], ["r_name", "week_ending", "event_type"], ["week_ending", "event_type"]]
    cube = j.groupingSets([[C(c) for c in s] for s in sets], "r_name", "n_name", "week_ending", "event_type").agg(F.sum("n").alias("n"), F.grouping("n_name").alias("gn"), F.grouping("r_name").alias("gr"))
    d = cube.select(F.when(C("gn") == 0, "county").when(C("gr") == 0, "state").otherwise("national").alias("level"), F.coalesce("n_name", "r_name", F.lit("ALL")).alias("area"), "week_ending", "event_type", "n")
    w = W.partitionBy("level", "area", "week_ending")
    d = d.withColumn("pct", F.round(100.0 * C("n") / F.sum("n").over(w), 6)).withColumn("rank", F.row_number().over(w.orderBy(C("n").desc(), "event_type")))
    return d.filter("n >= 5").withColumn("dominant", C("rank") == 1)


@query("member_medallion", """WITH c AS (SELECT o_custkey AS member, l_extendedprice * (1 - l_discount) AS paid, CASE WHEN o_orderpriority LIKE '1-%' THEN 1 ELSE 0 END AS er, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS ip, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice > 0),
 f AS (SELECT member, sum(paid) AS paid, sum(er) AS er, sum(ip) AS ip, count(DISTINCT l_partkey % 4) AS chronic FROM c GROUP BY 1),
 s AS (SELECT c_custkey AS member, n_name, 18 + c_custkey % 70 AS age, coalesce(paid, 0) AS paid, coalesce(er, 0) AS er, coalesce(ip, 0) AS ip, coalesce(chronic, 0) AS chronic FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN f ON f.member = c_custkey),
 r AS (SELECT *, CASE WHEN age >= 75 THEN 3 WHEN age >= 65 THEN 2 ELSE 1 END + CASE WHEN chronic >= 3 THEN 3 WHEN chronic >= 2 THEN 2 WHEN chronic >= 1 THEN 1 ELSE 0 END + CASE WHEN er >= 4 OR ip >= 2 THEN 3 WHEN er >= 2 OR ip >= 1 THEN 2 WHEN er >= 1 THEN 1 ELSE 0 END + CASE WHEN paid >= 50000 THEN 3 WHEN paid >= 25000 THEN 2 WHEN paid >= 10000 THEN 1 ELSE 0 END AS score FROM s)
 SELECT n_name, CASE WHEN score >= 9 THEN 'High' WHEN score >= 6 THEN 'Medium' WHEN score >= 3 THEN 'Low' ELSE 'Very Low' END AS tier, count(*) AS members, round(sum(paid), 2) AS paid FROM r GROUP BY 1, 2""")
def member_medallion(t: Tables):
    """Claims to member features to risk tiers by nation: one shuffle of the claims by order, one by member."""
    claims = t.lineitem.filter("l_extendedprice > 0").join(t.orders, C("l_orderkey") == C("o_orderkey"))
    f = claims.groupBy(C("o_custkey").alias("member")).agg(F.sum(C("l_extendedprice") * (1 - C("l_discount"))).alias("paid"), F.count_if(C("o_orderpriority").like("1-%")).alias("er"), F.count_if(C("o_orderstatus") == "F").alias("ip"), F.countDistinct(C("l_partkey") % 4).alias("chronic"))
    s = t.customer.select(C("c_custkey").alias("member"), C("c_nationkey").alias("n_nationkey"), (18 + C("c_custkey") % 70).alias("age")).join(f, "member", "left").fillna(0)
    s = s.withColumns(X.risk_scores(C("age"), C("chronic"), C("er"), C("ip"), C("paid"))).withColumn("tier", X.risk_tier(C("composite_risk_score")))
    return s.join(F.broadcast(t.nation), "n_nationkey").groupBy("n_name", "tier").agg(F.count("*").alias("members"), F.round(F.sum("paid"), 2).alias("paid"))
