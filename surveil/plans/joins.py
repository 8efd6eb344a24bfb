"""Joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clinical as X
from ..operators import joins as J
from .registry import Tables, query

C = F.col


@query("join_inner", "SELECT c_custkey, o_orderkey, n_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey")
def join_inner(t: Tables):
    return t.orders.join(t.customer, C("o_custkey") == C("c_custkey")).join(t.nation, C("n_nationkey") == C("c_nationkey")).select("c_custkey", "o_orderkey", "n_name")


@query("join_left_chain", """SELECT c_custkey, coalesce(a.n, 0) AS n_orders, coalesce(b.f, 0) AS n_final, coalesce(round(a.s, 2), 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
 LEFT JOIN (SELECT o_custkey, count(*) AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def join_left_chain(t: Tables):
    # both feature blocks come from one aggregate, so the spine is joined once
    a = t.orders.groupBy(C("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.count_if(C("o_orderstatus") == "F").alias("n_final"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return t.customer.select("c_custkey").join(a, "c_custkey", "left").fillna(0)


@query("join_nullsafe", "SELECT e.event_id, p.n FROM (SELECT event_id, event_type, CASE WHEN user_id % 2 = 0 THEN user_id % 4 END AS lot FROM events) e JOIN (SELECT event_type, CASE WHEN user_id % 2 = 0 THEN user_id % 4 END AS lot, count(*) AS n FROM events GROUP BY 1, 2) p ON e.event_type = p.event_type AND e.lot IS NOT DISTINCT FROM p.lot")
def join_nullsafe(t: Tables):
    e = t.events.select("event_id", "event_type", F.when(C("user_id") % 2 == 0, C("user_id") % 4).alias("lot"))
    p = e.groupBy(C("event_type").alias("kind"), C("lot").alias("lot_")).agg(F.count("*").alias("n"))
    return e.join(p, (C("event_type") == C("kind")) & C("lot").eqNullSafe(C("lot_"))).select("event_id", "n")


@query("join_full", "SELECT coalesce(a.k, b.k) AS custkey, coalesce(a.n, 0) AS recent, coalesce(b.n, 0) AS prior FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1) b ON a.k = b.k")
def join_full(t: Tables):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    a = t.orders.filter(C("o_orderdate") >= at("1998-01-01")).groupBy(C("o_custkey").alias("custkey")).agg(F.count("*").alias("recent"))
    b = t.orders.filter(C("o_orderdate") < at("1996-01-01")).groupBy(C("o_custkey").alias("custkey")).agg(F.count("*").alias("prior"))
    return a.join(b, "custkey", "full").fillna(0)


_THREE = """(SELECT coalesce(a.f, b.f, c.f) AS f, coalesce(a.d, b.d, c.d) AS d, a.n AS clicks, b.n AS views, c.n AS buys FROM
 (SELECT user_id AS f, CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1, 2) a FULL JOIN (SELECT user_id AS f, CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.f = b.f AND a.d = b.d
 FULL JOIN (SELECT user_id AS f, CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) c ON coalesce(a.f, b.f) = c.f AND coalesce(a.d, b.d) = c.d)"""


def three_sources(t: Tables):
    def one(kind: str, name: str):
        return t.events.filter(C("event_type") == kind).groupBy(C("user_id").alias("f"), C("ts").cast("date").alias("d")).agg(F.count("*").alias(name))

    return one("click", "clicks").join(one("view", "views"), ["f", "d"], "full").join(one("purchase", "buys"), ["f", "d"], "full")


@query("join_full3", f"SELECT f, d, clicks, views, buys, concat_ws(',', CASE WHEN clicks IS NOT NULL THEN 'ehr' END, CASE WHEN views IS NOT NULL THEN 'roster' END, CASE WHEN buys IS NOT NULL THEN 'supply' END) AS sources FROM {_THREE}")
def join_full3(t: Tables):
    used = F.array_compact(F.array(*(F.when(C(c).isNotNull(), s) for c, s in (("clicks", "ehr"), ("views", "roster"), ("buys", "supply")))))
    return three_sources(t).select("f", "d", "clicks", "views", "buys", F.array_join(used, ",").alias("sources"))


@query("merge_confidence", f"SELECT f, d, round(0.5 * (CAST(clicks IS NOT NULL AS INTEGER) + CAST(views IS NOT NULL AS INTEGER) + CAST(buys IS NOT NULL AS INTEGER)) / 3.0 + 0.3 + 0.2 * CAST(coalesce(clicks = views, false) AS INTEGER), 6) AS confidence FROM {_THREE}")
def merge_confidence(t: Tables):
    n = sum((C(c).isNotNull().cast("int") for c in ("clicks", "views", "buys")), F.lit(0))
    return three_sources(t).select("f", "d", F.round(0.5 * n / 3.0 + 0.3 + 0.2 * F.coalesce(C("clicks") == C("views"), F.lit(False)).cast("int"), 6).alias("confidence"))


@query("join_unified_ts", "SELECT CAST(ts AS DATE) AS d, sum(CASE WHEN event_type = 'click' THEN 1 END)::BIGINT AS click, sum(CASE WHEN event_type = 'view' THEN 1 END)::BIGINT AS view, sum(CASE WHEN event_type = 'purchase' THEN 1 END)::BIGINT AS purchase, sum(CASE WHEN event_type = 'error' THEN 1 END)::BIGINT AS error FROM events GROUP BY 1")
def join_unified_ts(t: Tables):
    return t.events.groupBy(C("ts").cast("date").alias("d")).pivot("event_type", ["click", "view", "purchase", "error"]).count()


@query("join_anti", "SELECT o_orderstatus, count(*) AS missing FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) GROUP BY 1")
def join_anti(t: Tables):
    there = t.lineitem.filter("l_quantity > 45").select(C("l_orderkey").alias("o_orderkey"))
    return t.orders.join(there, "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("missing"))


@query("join_not_exists", "SELECT count(*) AS violations FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5)")
def join_not_exists(t: Tables):
    return t.lineitem.join(t.part.filter("p_size > 5").select(C("p_partkey").alias("l_partkey")), "l_partkey", "left_anti").agg(F.count("*").alias("violations"))


@query("join_orphan", "SELECT count(DISTINCT c_custkey) AS orphans FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey WHERE o_custkey IS NULL")
def join_orphan(t: Tables):
    some = t.orders.filter("o_orderstatus = 'P'").select(C("o_custkey").alias("c_custkey"))
    return t.customer.join(some, "c_custkey", "left_anti").agg(F.countDistinct("c_custkey").alias("orphans"))


_CONFLICT = "(SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1)"


@query("join_semi", f"SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE (l_orderkey, l_linenumber) IN {_CONFLICT}")
def join_semi(t: Tables):
    key = ["l_orderkey", "l_linenumber"]
    conflicts = t.lineitem.groupBy(*key).agg(F.countDistinct("l_returnflag").alias("n")).filter("n > 1").select(*key)
    return t.lineitem.join(conflicts, key, "left_semi").select(*key, "l_returnflag")


@query("join_cross_stats", "SELECT d, n, round((n - m) / s, 6) AS z FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1), (SELECT avg(n) AS m, stddev(n) AS s FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1))")
def join_cross_stats(t: Tables):
    day = t.events.groupBy(C("ts").cast("date").alias("d")).agg(F.count("*").alias("n"))
    stats = day.agg(F.avg("n").alias("m"), F.stddev("n").alias("s"))  # one row
    return day.crossJoin(F.broadcast(stats)).select("d", "n", X.rounded((C("n") - C("m")) / C("s"), 6).alias("z"))


@query("join_baseline", "SELECT e.event_id, round((e.value - b.m) / b.s, 6) AS z FROM events e JOIN (SELECT user_id, avg(value) AS m, stddev(value) AS s FROM events WHERE ts < TIMESTAMP '2024-01-22' GROUP BY 1 HAVING count(*) >= 4 AND stddev(value) > 0) b ON e.user_id = b.user_id WHERE e.ts >= TIMESTAMP '2024-01-22'")
def join_baseline(t: Tables):
    at = F.lit("2024-01-22").cast("timestamp_ntz")
    base = t.events.filter(C("ts") < at).groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev("value").alias("s"), F.count("*").alias("n")).filter("n >= 4 and s > 0")
    return t.events.filter(C("ts") >= at).join(base, "user_id").select("event_id", X.rounded((C("value") - C("m")) / C("s"), 6).alias("z"))


@query("join_baseline_map", "SELECT user_id, event_type, round((avg(value) - max(m)) / max(s), 6) AS z FROM events JOIN (VALUES ('click', 50.0, 20.0), ('view', 45.0, 25.0)) AS b(event_type, m, s) USING (event_type) GROUP BY 1, 2")
def join_baseline_map(t: Tables):
    b = F.broadcast(t.spark.createDataFrame([("click", 50.0, 20.0), ("view", 45.0, 25.0)], "event_type string, m double, s double"))
    return t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("v")).join(b, "event_type").select("user_id", "event_type", X.rounded((C("v") - C("m")) / C("s"), 6).alias("z"))


@query("join_peer", "SELECT user_id, w, n, round(n - avg(n) OVER (PARTITION BY user_id % 25, w), 6) AS above_peers FROM (SELECT user_id, CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS DATE) AS w, count(*) AS n FROM events GROUP BY 1, 2)")
def join_peer(t: Tables):
    d = C("ts").cast("date")
    week = t.events.groupBy("user_id", F.date_sub(d, F.dayofweek(d) - 1).alias("w")).agg(F.count("*").alias("n"))
    return week.select("user_id", "w", "n", X.rounded(C("n") - F.avg("n").over(W.partitionBy(C("user_id") % 25, "w")), 6).alias("above_peers"))


@query("join_selflead", "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2) SELECT a.user_id, a.d, coalesce(b.n, 0) > a.n AS label FROM d a LEFT JOIN d b ON a.user_id = b.user_id AND b.d = a.d + 7")
def join_selflead(t: Tables):
    day = t.events.groupBy("user_id", C("ts").cast("date").alias("d")).agg(F.count("*").alias("n"))
    later = day.select("user_id", F.date_sub("d", 7).alias("d"), C("n").alias("m"))
    return day.join(later, ["user_id", "d"], "left").select("user_id", "d", (F.coalesce("m", F.lit(0)) > C("n")).alias("label"))


@query("join_broadcast", "SELECT r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def join_broadcast(t: Tables):
    # nation and region have 25 and 5 rows at every scale
    return t.supplier.join(F.broadcast(t.nation), C("s_nationkey") == C("n_nationkey")).join(F.broadcast(t.region), C("n_regionkey") == C("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))


_SKEW = "SELECT l_returnflag, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"


@query("join_skew_split", _SKEW)
def join_skew_split(t: Tables):
    line = t.lineitem.select("l_returnflag", C("l_partkey").alias("k"))
    return J.split_join(line, t.part.select(C("p_partkey").alias("k"), "p_brand"), "k").groupBy("l_returnflag", "p_brand").agg(F.count("*").alias("n"))


@query("join_salted", _SKEW)
def join_salted(t: Tables):
    line = t.lineitem.select("l_returnflag", C("l_partkey").alias("k"), "l_orderkey", "l_linenumber")
    return J.salted_join(line, t.part.select(C("p_partkey").alias("k"), "p_brand"), "k", 8).groupBy("l_returnflag", "p_brand").agg(F.count("*").alias("n"))


@query("join_interval", """SELECT a, stream, b, gap FROM (SELECT a.event_id AS a, b.event_type AS stream, b.event_id AS b, CAST(date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE)) AS INTEGER) AS gap, row_number() OVER (PARTITION BY a.event_id, b.event_type ORDER BY b.value DESC, b.event_id) AS r
 FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND abs(date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE))) <= 7 WHERE a.event_type = 'error') WHERE r = 1""")
def join_interval(t: Tables):
    day = F.unix_date(C("ts").cast("date"))
    a = t.events.filter("event_type = 'error'").select(C("event_id").alias("a"), "user_id", day.alias("da"))
    b = t.events.filter("event_type <> 'error'").select(C("event_id").alias("b"), "user_id", C("event_type").alias("stream"), "value", day.alias("db"))
    return J.newest(J.within(a, b, ["user_id"], "da", "db", 7), ["a", "stream"], C("value").desc(), C("b")).select("a", "stream", "b", (C("db") - C("da")).alias("gap"))


_RATIO = "100.0 * (1 - levenshtein(lower(trim(x.c_name)), lower(trim(y.c_name))) / CAST(greatest(length(x.c_name), length(y.c_name), 1) AS DOUBLE))"


@query("join_interval_km", """WITH e AS (SELECT event_id, event_type, value, CAST(ts AS DATE) AS d, 30.0 + event_id % 97 / 10.0 AS la, -100.0 + event_id % 89 / 10.0 AS lo FROM events)
 SELECT a, stream, b FROM (SELECT a.event_id AS a, b.event_type AS stream, b.event_id AS b, row_number() OVER (PARTITION BY a.event_id, b.event_type ORDER BY b.value DESC, b.event_id) AS r FROM e a JOIN e b ON b.event_type <> 'error' AND abs(date_diff('day', a.d, b.d)) <= 7 AND b.la BETWEEN a.la - 0.5 AND a.la + 0.5
 AND 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) <= 50 WHERE a.event_type = 'error') WHERE r = 1""")
def join_interval_km(t: Tables):
    """For each error the strongest event of every other stream within seven days and 50 km.

    Nearness depends on places and days alone, so places meet once, and of a stream's events only the strongest of each place and day goes on.
    """
    from ..functions.clinical import haversine_km

    e = t.events.select("event_id", "event_type", "value", F.unix_date(C("ts").cast("date")).alias("d"), (30.0 + C("event_id") % 97 / 10.0).alias("la"), (-100.0 + C("event_id") % 89 / 10.0).alias("lo"))
    errors, others = e.filter("event_type = 'error'"), e.filter("event_type <> 'error'")
    # half a degree of latitude is more than 50 km, and so is one of longitude up to 60 degrees north
    places = J.near_places(errors, others, "la", "lo", "la2", "lo2", 0.5, 1.0, haversine_km(C("la"), C("lo"), C("la2"), C("lo2")) <= 50)
    strongest = F.max(F.struct("value", (-C("event_id")).alias("minus"))).alias("s")
    best = others.groupBy(C("event_type").alias("stream"), C("la").alias("la2"), C("lo").alias("lo2"), "d").agg(strongest)
    # the days within reach, then the places
    best = best.withColumn("d", F.explode(F.sequence(C("d") - 7, C("d") + 7))).groupBy("stream", "la2", "lo2", "d").agg(F.max("s").alias("s"))
    asked = errors.select("la", "lo", "d").distinct().join(places, ["la", "lo"])
    found = asked.join(best, ["la2", "lo2", "d"]).groupBy("la", "lo", "d", "stream").agg(F.max("s").alias("s"))
    found = errors.join(found, ["la", "lo", "d"]).groupBy(C("event_id").alias("a"), "stream").agg(F.max("s").alias("s"))
    return found.select("a", "stream", (-C("s.minus")).alias("b"))


@query("join_fuzzy", f"""WITH o AS (SELECT o_orderkey, c_name, c_nationkey, CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON c_custkey = o_custkey)
 SELECT x.o_orderkey AS a, y.o_orderkey AS b, round({_RATIO}, 6) AS score FROM o x JOIN o y ON x.c_nationkey = y.c_nationkey AND x.o_orderkey < y.o_orderkey AND abs(date_diff('day', x.d, y.d)) <= 1 WHERE {_RATIO} >= 85""")
def join_fuzzy(t: Tables):
    """Orders of one nation whose dates are a day apart at most and whose names agree by 85 of 100: cells of nation and day, and in these names by their letters."""
    # names of one word, so sorting words changes nothing in the SQL
    o = t.orders.join(t.customer, C("c_custkey") == C("o_custkey")).select("o_orderkey", "c_name", "c_nationkey", F.unix_date(C("o_orderdate").cast("date")).alias("d"))
    # each order meets those of its own day and of the day after
    a = o.select(C("o_orderkey").alias("a"), C("c_name").alias("na"), "c_nationkey", F.posexplode(F.array(C("d"), C("d") + 1)).alias("later", "d"))
    b = o.select(C("o_orderkey").alias("b"), C("c_name").alias("nb"), "c_nationkey", "d")
    found = J.similar_pairs(a, b, ["c_nationkey", "d"], "na", "nb", only="a < b or (later = 1 and a <> b)", digits=6)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


@query("join_asof", "SELECT e.event_id, p.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def join_asof(t: Tables):
    views = t.events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    buys = t.events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"))
    return J.asof_join(views, buys, ["user_id"], "ts", "ts", ["last_purchase"]).select("event_id", "last_purchase")


@query("join_dim_patient", "SELECT e.event_id, coalesce(c.c_mktsegment, 'unknown') AS segment FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id * 7")
def join_dim_patient(t: Tables):
    return t.events.join(t.customer, C("c_custkey") == C("user_id") * 7, "left").select("event_id", F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment"))


@query("join_layer_lineage", "SELECT count(DISTINCT c_custkey) AS bronze, count(DISTINCT o.k) AS silver, count(DISTINCT l.k) AS gold FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') l ON l.k = c_custkey")
def join_layer_lineage(t: Tables):
    silver = t.orders.select(C("o_custkey").alias("silver")).distinct()
    gold = t.orders.join(t.lineitem.filter("l_returnflag = 'R'"), C("l_orderkey") == C("o_orderkey"), "left_semi").select(C("o_custkey").alias("gold")).distinct()
    j = t.customer.join(silver, C("silver") == C("c_custkey"), "left").join(gold, C("gold") == C("c_custkey"), "left")
    return j.agg(*(F.countDistinct(c).alias(n) for c, n in (("c_custkey", "bronze"), ("silver", "silver"), ("gold", "gold"))))


@query("join_cluster", """SELECT event_id, s_suppkey AS cluster FROM (SELECT e.event_id, s.s_suppkey, row_number() OVER (PARTITION BY e.event_id ORDER BY s.s_suppkey) AS r FROM (SELECT event_id, 30.0 + user_id % 20 AS la, -100.0 + user_id % 30 AS lo FROM events WHERE event_type = 'error') e
 JOIN (SELECT s_suppkey, 30.0 + s_suppkey % 20 AS la, -100.0 + s_suppkey % 30 AS lo FROM supplier) s ON 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(s.la - e.la) / 2), 2) + cos(radians(e.la)) * cos(radians(s.la)) * pow(sin(radians(s.lo - e.lo) / 2), 2)))) <= 100) WHERE r = 1""")
def join_cluster(t: Tables):
    """For each error the lowest supplier within 100 km: places meet once, whatever the events and suppliers that share one."""
    from ..functions.clinical import haversine_km

    e = t.events.filter("event_type = 'error'").select("event_id", (30.0 + C("user_id") % 20).alias("la"), (-100.0 + C("user_id") % 30).alias("lo"))
    s = t.supplier.select("s_suppkey", (30.0 + C("s_suppkey") % 20).alias("la2"), (-100.0 + C("s_suppkey") % 30).alias("lo2"))
    # 100 km is less than one degree of latitude; longitude cells of two degrees hold it up to 56 degrees north
    lowest = s.groupBy("la2", "lo2").agg(F.min("s_suppkey").alias("cluster"))
    places = J.near_places(e, lowest.withColumnsRenamed({"la2": "la", "lo2": "lo"}), "la", "lo", "la2", "lo2", 1.0, 2.0, haversine_km(C("la"), C("lo"), C("la2"), C("lo2")) <= 100)
    cluster = places.join(lowest, ["la2", "lo2"]).groupBy("la", "lo").agg(F.min("cluster").alias("cluster"))
    return e.join(cluster, ["la", "lo"]).groupBy("event_id").agg(F.min("cluster").alias("cluster"))


@query("join_full_meta", "SELECT column_name, CASE WHEN a IS NULL THEN 'EXTRA' WHEN b IS NULL THEN 'MISSING' ELSE 'PASS' END AS status, (SELECT count(*) FROM orders) AS n_rows FROM (VALUES ('o_custkey', 1, 1), ('o_orderdate', 1, NULL), ('o_orderkey', 1, 1), ('o_orderpriority', 1, NULL), ('o_orderstatus', 1, 1), ('o_totalprice', 1, NULL), ('price', NULL, 1)) AS v(column_name, a, b)")
def join_full_meta(t: Tables):
    post = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", C("o_totalprice").alias("price"))
    a = t.spark.createDataFrame(t.orders.dtypes, "column_name string, a string")
    b = t.spark.createDataFrame(post.dtypes, "column_name string, b string")
    status = F.when(C("a").isNull(), "EXTRA").when(C("b").isNull(), "MISSING").when(C("a") != C("b"), "FAIL").otherwise("PASS")
    return a.join(b, "column_name", "full").select("column_name", status.alias("status")).crossJoin(t.orders.agg(F.count("*").alias("n_rows")))
