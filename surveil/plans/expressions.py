"""Projections, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clinical as X
from ..operators import quantiles as Q
from .registry import Tables, query

C = F.col

#: Members with a birth date, sex and risk counts that follow from their key.
MEMBER_SQL = """(SELECT c_custkey AS member_id, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment,
  CAST(DATE '1930-01-01' + CAST(c_custkey * 37 % 25000 AS INTEGER) AS DATE) AS birth,
  CASE c_custkey % 4 WHEN 0 THEN 'male' WHEN 1 THEN ' F ' WHEN 2 THEN 'M' ELSE 'other' END AS sex,
  CAST(c_custkey % 5 AS INTEGER) AS chronic, CAST(c_custkey % 6 AS INTEGER) AS er, CAST(c_custkey % 3 AS INTEGER) AS admits FROM customer)"""


def members(t: Tables):
    k = C("c_custkey")
    return t.customer.select(
        k.alias("member_id"), C("c_nationkey").alias("nation"), C("c_acctbal").alias("balance"), C("c_mktsegment").alias("segment"), F.date_add(F.lit("1930-01-01").cast("date"), (k * 37 % 25000).cast("int")).alias("birth"),
        F.when(k % 4 == 0, "male").when(k % 4 == 1, " F ").when(k % 4 == 2, "M").otherwise("other").alias("sex"), (k % 5).cast("int").alias("chronic"), (k % 6).cast("int").alias("er"), (k % 3).cast("int").alias("admits"),
    )


@query("norm_text", "SELECT c_custkey, upper(trim(c_mktsegment)) AS segment, lower(trim(c_name)) AS name FROM customer")
def norm_text(t: Tables):
    return t.customer.select("c_custkey", X.norm(C("c_mktsegment")).alias("segment"), F.lower(F.trim("c_name")).alias("name"))


@query("safe_cast", "SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, try_cast(event_type AS DOUBLE) AS kind_number, try_cast(substr(CAST(ts AS VARCHAR), 1, 10) AS DATE) AS day FROM events")
def safe_cast(t: Tables):
    return t.events.select("event_id", F.regexp_extract("props", r"([0-9]+)", 1).try_cast("int").alias("k"), C("event_type").try_cast("double").alias("kind_number"), F.substring(C("ts").cast("string"), 1, 10).try_cast("date").alias("day"))


@query("parse_numeric_text", r"SELECT p_partkey, CASE WHEN regexp_full_match(trim(split_part(p_brand, '#', 2)), '\d+\.?\d*') THEN try_cast(split_part(p_brand, '#', 2) AS DOUBLE) END AS brand_number, CASE WHEN regexp_full_match(trim(p_type), '\d+\.?\d*') THEN try_cast(p_type AS DOUBLE) END AS type_number FROM part")
def parse_numeric_text(t: Tables):
    return t.part.select("p_partkey", X.parse_number(F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("brand_number"), X.parse_number(C("p_type")).alias("type_number"))


@query("strip_non_numeric", "SELECT c_custkey, regexp_replace(c_name, '[^0-9.]', '', 'g') AS digits FROM customer")
def strip_non_numeric(t: Tables):
    return t.customer.select("c_custkey", X.strip_non_numeric(C("c_name")).alias("digits"))


@query("default_nulls", "SELECT event_id, coalesce(nullif(event_type, 'view'), 'UNKNOWN') AS kind FROM events WHERE coalesce(nullif(user_id, 0), -1) <> -1")
def default_nulls(t: Tables):
    return t.events.filter(F.coalesce(F.nullif("user_id", F.lit(0)), F.lit(-1)) != -1).select("event_id", F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("UNKNOWN")).alias("kind"))


@query("stage_valid_lims", "SELECT event_id, user_id, value FROM events WHERE user_id IS NOT NULL AND event_type IN ('click','purchase','view') AND value IS NOT NULL AND value >= 0 AND ts >= TIMESTAMP '2024-01-02'")
def stage_valid_lims(t: Tables):
    return t.events.filter(C("user_id").isNotNull() & C("event_type").isin("click", "purchase", "view") & (C("value") >= 0) & (C("ts") >= F.lit("2024-01-02").cast("timestamp_ntz"))).select("event_id", "user_id", "value")


@query("stage_valid_seq", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_discount * 100 <= 5 AND l_returnflag <> 'R'")
def stage_valid_seq(t: Tables):
    return t.lineitem.filter((C("l_quantity") >= 10) & (C("l_discount") * 100 <= 5) & (C("l_returnflag") != "R")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def filter_range(t: Tables):
    return t.orders.filter(C("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))).select("o_orderkey", "o_custkey")


@query("pct_of_total", "SELECT event_type, round(coalesce(100.0 * sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / nullif(count(*), 0), 0), 6) AS pct FROM events GROUP BY 1")
def pct_of_total(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.coalesce(F.try_divide(100.0 * F.count_if(C("value") > 50), F.count("*")), F.lit(0.0)), 6).alias("pct"))


@query("map_gender", f"SELECT member_id, CASE WHEN upper(trim(sex)) IN ('M','MALE','1') THEN 'M' WHEN upper(trim(sex)) IN ('F','FEMALE','2') THEN 'F' ELSE 'U' END AS gender FROM {MEMBER_SQL}")
def map_gender(t: Tables):
    return members(t).select("member_id", X.gender(C("sex")).alias("gender"))


_RACES = ["White", "black", "Asian", "Pacific Islander", "American Indian", "other"]
_ETHNICITIES = ["Hispanic or Latino", "Not Hispanic or Latino", "Non-Hispanic", "unknown"]


def _pick(values: list[str], key):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _pick_sql(values: list[str], key: str) -> str:
    return f"(['{"','".join(values)}'])[{key} % {len(values)} + 1]"


@query("map_race", f"""SELECT c_custkey, CASE WHEN u LIKE '%WHITE%' THEN 'White' WHEN u LIKE '%BLACK%' OR u LIKE '%AFRICAN%' THEN 'Black or African American' WHEN u LIKE '%ASIAN%' THEN 'Asian'
 WHEN u LIKE '%NATIVE HAWAIIAN%' OR u LIKE '%PACIFIC%' THEN 'Pacific Islander' WHEN u LIKE '%INDIAN%' OR u LIKE '%NATIVE%' THEN 'American Indian or Alaska Native' ELSE 'Unknown' END AS race
 FROM (SELECT c_custkey, upper({_pick_sql(_RACES, 'c_custkey')}) AS u FROM customer)""")
def map_race(t: Tables):
    return t.customer.select("c_custkey", X.race(_pick(_RACES, C("c_custkey"))).alias("race"))


@query("map_ethnicity", f"""SELECT c_custkey, CASE WHEN u LIKE '%NOT HISPANIC%' OR u LIKE '%NON-HISPANIC%' THEN 'Not Hispanic' WHEN u LIKE '%HISPANIC%' OR u LIKE '%LATINO%' THEN 'Hispanic' ELSE 'Unknown' END AS ethnicity
 FROM (SELECT c_custkey, upper({_pick_sql(_ETHNICITIES, 'c_custkey')}) AS u FROM customer)""")
def map_ethnicity(t: Tables):
    return t.customer.select("c_custkey", X.ethnicity(_pick(_ETHNICITIES, C("c_custkey"))).alias("ethnicity"))


@query("clean_zip", r"SELECT c_custkey, CASE WHEN regexp_full_match(z, '\d{5}(-?\d{4})?') THEN substr(z, 1, 5) END AS zip5, substr(CASE WHEN regexp_full_match(z, '\d{5}(-?\d{4})?') THEN substr(z, 1, 5) END, 1, 3) AS zip3 FROM (SELECT c_custkey, CAST(c_custkey * 7919 % 1000000 AS VARCHAR) AS z FROM customer)")
def clean_zip(t: Tables):
    z = X.zip5((C("c_custkey") * 7919 % 1000000).cast("string"))
    return t.customer.select("c_custkey", z.alias("zip5"), F.left(z, F.lit(3)).alias("zip3"))


@query("check_npi", r"SELECT s_suppkey, CASE WHEN regexp_full_match(z, '\d{10}') THEN z END AS npi FROM (SELECT s_suppkey, CAST(CAST(900000000 AS BIGINT) + s_suppkey * 7000003 AS VARCHAR) AS z FROM supplier)")
def check_npi(t: Tables):
    return t.supplier.select("s_suppkey", X.npi((F.lit(900000000).cast("long") + C("s_suppkey") * 7000003).cast("string")).alias("npi"))


@query("ages", f"""SELECT member_id, CAST(floor(date_diff('day', birth, DATE '2001-08-01') / 365.25) AS INTEGER) AS age_365, CAST(date_sub('year', birth, DATE '2001-08-01') AS INTEGER) AS age_exact,
 CAST(2001 - year(birth) AS INTEGER) AS age_boundary FROM {MEMBER_SQL}""")
def ages(t: Tables):
    at = F.lit("2001-08-01").cast("date")
    return members(t).select("member_id", X.age_365(C("birth"), at).alias("age_365"), X.age_exact(C("birth"), at).alias("age_exact"), X.age_boundary(C("birth"), at).alias("age_boundary"))


@query("age_group", f"""SELECT member_id, CASE WHEN a < 18 THEN '0-17' WHEN a < 45 THEN '18-44' WHEN a < 65 THEN '45-64' ELSE '65+' END AS group4,
 CASE WHEN a < 18 THEN '0-17' WHEN a < 30 THEN '18-29' WHEN a < 40 THEN '30-39' WHEN a < 50 THEN '40-49' WHEN a < 65 THEN '50-64' ELSE '65+' END AS group6 FROM (SELECT member_id, 2001 - year(birth) AS a FROM {MEMBER_SQL})""")
def age_group(t: Tables):
    age = X.age_boundary(C("birth"), F.lit("2001-08-01").cast("date"))
    return members(t).select("member_id", X.age_group4(age).alias("group4"), X.age_group6(age).alias("group6"))


@query("date_range_valid", """SELECT l_orderkey, l_linenumber, e IS NULL OR s <= e AS valid, CASE WHEN e IS NULL THEN s ELSE least(s, e) END AS from_date, CASE WHEN e IS NOT NULL THEN greatest(s, e) END AS to_date
 FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS s, CASE WHEN l_partkey % 7 <> 0 THEN CAST(CAST(l_shipdate AS DATE) + CAST(l_partkey % 11 - 3 AS INTEGER) AS DATE) END AS e FROM lineitem)""")
def date_range_valid(t: Tables):
    s = C("l_shipdate").cast("date")
    d = t.lineitem.select("l_orderkey", "l_linenumber", s.alias("s"), F.when(C("l_partkey") % 7 != 0, F.date_add(s, (C("l_partkey") % 11 - 3).cast("int"))).alias("e"))
    lo, hi = X.swap_dates(C("s"), C("e"))
    return d.select("l_orderkey", "l_linenumber", (C("e").isNull() | (C("s") <= C("e"))).alias("valid"), lo.alias("from_date"), hi.alias("to_date"))


@query("null_out_of_range", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 400 BETWEEN 1 AND 365 THEN CAST(c_custkey % 400 AS INTEGER) END AS days_supply FROM customer")
def null_out_of_range(t: Tables):
    return t.customer.select("c_custkey", X.null_outside(C("c_acctbal"), 0).alias("balance"), X.null_outside((C("c_custkey") % 400).cast("int"), 1, 365).alias("days_supply"))


@query("date_parts", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(quarter(ts) AS INTEGER) AS q, CAST(hour(ts) AS INTEGER) AS h FROM events")
def date_parts(t: Tables):
    return t.events.select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.quarter("ts").alias("q"), F.hour("ts").alias("h"))


@query("claim_flags", "SELECT o_orderkey, o_totalprice > 200000 AS high_cost, o_orderpriority LIKE '1-%' OR CAST(o_custkey AS VARCHAR) LIKE '45%' AS emergency, o_orderstatus = 'F' AS inpatient FROM orders")
def claim_flags(t: Tables):
    return t.orders.select("o_orderkey", (C("o_totalprice") > 200000).alias("high_cost"), (C("o_orderpriority").like("1-%") | C("o_custkey").cast("string").like("45%")).alias("emergency"), (C("o_orderstatus") == "F").alias("inpatient"))


@query("length_of_stay", "SELECT l.l_orderkey, l.l_linenumber, CASE WHEN o.o_orderstatus = 'F' THEN CAST(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) + 1 AS INTEGER) END AS los FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
def length_of_stay(t: Tables):
    j = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", F.when(C("o_orderstatus") == "F", F.datediff(C("l_shipdate").cast("date"), C("o_orderdate").cast("date")) + 1).alias("los"))


@query("row_quality", "SELECT o_orderkey, round((CASE WHEN o_custkey % 10 <> 0 THEN 1 ELSE 0 END + CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END + 1 + 1) / 4.0, 4) AS quality FROM orders")
def row_quality(t: Tables):
    cols = F.when(C("o_custkey") % 10 != 0, C("o_custkey")), F.nullif("o_orderstatus", F.lit("P")), C("o_totalprice"), C("o_orderdate")
    return t.orders.select("o_orderkey", F.round(X.completeness(*cols), 4).alias("quality"))


@query("supply_end", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS DATE) AS supply_end FROM lineitem")
def supply_end(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.date_add(C("l_shipdate").cast("date"), C("l_quantity").cast("int")).alias("supply_end"))


@query("elig_span", """SELECT o_orderkey, e >= s AS valid_span, CAST(date_diff('day', s, e) AS INTEGER) AS days, s <= DATE '1998-06-01' AND e >= DATE '1998-06-01' AS currently_eligible FROM
 (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(CAST(o_orderdate AS DATE) + CAST(o_custkey % 700 AS INTEGER) AS DATE) AS e FROM orders)""")
def elig_span(t: Tables):
    s = C("o_orderdate").cast("date")
    at = F.lit("1998-06-01").cast("date")
    d = t.orders.select("o_orderkey", s.alias("s"), F.date_add(s, (C("o_custkey") % 700).cast("int")).alias("e"))
    return d.select("o_orderkey", (C("e") >= C("s")).alias("valid_span"), F.datediff("e", "s").alias("days"), ((C("s") <= at) & (C("e") >= at)).alias("currently_eligible"))


@query("hash_pii", "SELECT c_custkey, sha256(c_name || '_salt') AS name_hash, md5(coalesce(CAST(c_nationkey AS VARCHAR), '_null_') || '-' || coalesce(c_mktsegment, '_null_')) AS surrogate FROM customer")
def hash_pii(t: Tables):
    return t.customer.select("c_custkey", X.salted_hash(C("c_name")).alias("name_hash"), X.surrogate_key(C("c_nationkey"), C("c_mktsegment")).alias("surrogate"))


_UNITS = "(VALUES ('click', CAST(0.5 AS DOUBLE)), ('view', 2.0), ('purchase', 0.0555)) AS m(event_type, factor)"


@query("unit_convert", f"SELECT e.event_id, round(e.value * coalesce(m.factor, 1.0), 7) AS standard FROM events e LEFT JOIN {_UNITS} ON e.event_type = m.event_type")
def unit_convert(t: Tables):
    factors = t.spark.createDataFrame([("click", 0.5), ("view", 2.0), ("purchase", 0.0555)], "event_type string, factor double")
    return t.events.join(F.broadcast(factors), "event_type", "left").select("event_id", F.round(C("value") * F.coalesce("factor", F.lit(1.0)), 7).alias("standard"))


@query("tat_hours", """SELECT l_orderkey, l_linenumber, CAST(h AS DOUBLE) AS hours, CASE WHEN h <= 24 THEN 'Same Day (<24h)' WHEN h <= 48 THEN '1-2 Days' WHEN h <= 72 THEN '2-3 Days' WHEN h <= 120 THEN '3-5 Days' ELSE '>5 Days' END AS band
 FROM (SELECT l.l_orderkey, l.l_linenumber, date_diff('second', o.o_orderdate, l.l_shipdate) / 3600.0 AS h FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)""")
def tat_hours(t: Tables):
    seconds = F.unix_timestamp(C("l_shipdate").cast("timestamp")) - F.unix_timestamp(C("o_orderdate").cast("timestamp"))
    j = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).select("l_orderkey", "l_linenumber", (seconds / 3600.0).alias("hours"))
    return j.withColumn("band", X.turnaround_band(C("hours")))


@query("critical_value", "SELECT event_id, (event_type = 'click' AND (value * 5 < 60 OR value * 5 > 300)) OR (event_type = 'view' AND (value / 10 < 2.5 OR value / 10 > 6.0)) AS critical FROM events")
def critical_value(t: Tables):
    code = F.when(C("event_type") == "click", "2345-7").when(C("event_type") == "view", "2823-3").otherwise("none")
    value = F.when(C("event_type") == "click", C("value") * 5).otherwise(C("value") / 10)
    return t.events.select("event_id", X.critical_value(code, value).alias("critical"))


@query("row_valid_flag", "SELECT event_id, user_id IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL AND event_type <> 'error' AS is_valid FROM events")
def row_valid_flag(t: Tables):
    return t.events.select("event_id", (C("user_id").isNotNull() & C("value").isNotNull() & C("event_type").isNotNull() & (C("event_type") != "error")).alias("is_valid"))


_EPI = "CAST(CAST(o_orderdate AS DATE) + CAST(6 - dayofweek(o_orderdate) AS INTEGER) AS DATE)"


@query("epi_week", f"SELECT o_orderkey, {_EPI} AS week_ending FROM orders")
def epi_week(t: Tables):
    return t.orders.select("o_orderkey", X.epi_week(C("o_orderdate").cast("date")).alias("week_ending"))


@query("mmwr_week", f"SELECT o_orderkey, CAST(year(w) AS INTEGER) AS mmwr_year, CAST((dayofyear(w) - 1) // 7 + 1 AS INTEGER) AS mmwr_week FROM (SELECT o_orderkey, CAST({_EPI} - 3 AS DATE) AS w FROM orders)")
def mmwr_week(t: Tables):
    d = C("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", X.mmwr_year(d).alias("mmwr_year"), X.mmwr_week(d).alias("mmwr_week"))


_CT = "(SELECT event_id, value / 2 AS n, CASE WHEN user_id % 3 <> 0 THEN value / 1.7 END AS orf, CASE WHEN user_id % 4 <> 0 THEN value / 1.9 END AS s FROM events)"


def _ct(t: Tables):
    return t.events.select("event_id", (C("value") / 2).alias("n"), F.when(C("user_id") % 3 != 0, C("value") / 1.7).alias("orf"), F.when(C("user_id") % 4 != 0, C("value") / 1.9).alias("s"))


@query("pcr_interpret", f"""SELECT event_id, CASE WHEN hits >= 2 THEN 'Detected' WHEN hits = 1 AND lo > 35 THEN 'Inconclusive' ELSE 'Not Detected' END AS result FROM
 (SELECT event_id, CASE WHEN n <= 40 THEN 1 ELSE 0 END + CASE WHEN orf <= 40 THEN 1 ELSE 0 END + CASE WHEN s <= 40 THEN 1 ELSE 0 END AS hits, least(coalesce(n, 999), coalesce(orf, 999), coalesce(s, 999)) AS lo FROM {_CT})""")
def pcr_interpret(t: Tables):
    return _ct(t).select("event_id", X.pcr_result([C("n"), C("orf"), C("s")], [40, 40, 40]).alias("result"))


@query("sgtf", f"SELECT event_id, coalesce((s IS NULL OR s > 30) AND n < 30 AND orf < 30, false) AS sgtf FROM {_CT}")
def sgtf(t: Tables):
    return _ct(t).select("event_id", X.s_gene_failure(C("n"), C("orf"), C("s")).alias("sgtf"))


@query("final_result", f"""SELECT event_id, CASE WHEN kind = 'error' THEN 'Invalid' WHEN kind = 'signup' THEN CASE WHEN n <= 20 THEN 'Detected' ELSE 'Not Detected' END WHEN hits >= need THEN 'Detected' WHEN hits = 1 AND lo > 35 THEN 'Inconclusive' ELSE 'Not Detected' END AS result,
 hits = 1 AND lo > 35 AND kind NOT IN ('error', 'signup') AND hits < need AS repeat_test FROM
 (SELECT c.event_id, e.event_type AS kind, n, CASE WHEN e.user_id % 2 = 0 THEN 2 ELSE 1 END AS need, CASE WHEN n <= 40 THEN 1 ELSE 0 END + CASE WHEN orf <= 38 THEN 1 ELSE 0 END AS hits, least(coalesce(n, 999), coalesce(orf, 999)) AS lo FROM {_CT} c JOIN events e ON c.event_id = e.event_id)""")
def final_result(t: Tables):
    d = _ct(t).join(t.events.select("event_id", C("event_type").alias("kind"), F.when(C("user_id") % 2 == 0, 2).otherwise(1).alias("need")), "event_id")
    hits = F.when(C("n") <= 40, 1).otherwise(0) + F.when(C("orf") <= 38, 1).otherwise(0)
    weak = (hits == 1) & (F.least(F.coalesce("n", F.lit(999.0)), F.coalesce("orf", F.lit(999.0))) > 35)
    result = F.when(C("kind") == "error", "Invalid").when(C("kind") == "signup", F.when(C("n") <= 20, "Detected").otherwise("Not Detected")).when(hits >= C("need"), "Detected").when(weak, "Inconclusive").otherwise("Not Detected")
    return d.select("event_id", result.alias("result"), (weak & ~C("kind").isin("error", "signup") & (hits < C("need"))).alias("repeat_test"))


_LINEAGES = ["B.1.1.7", "Q.4", "B.1.351.2", "P.1.1", "AY.4", "BA.5.2", "XBB.1.5", "JN.1", "A.2"]


@query("who_variant", f"""SELECT event_id, CASE WHEN l LIKE 'B.1.1.7%' OR l LIKE 'Q.%' THEN 'Alpha' WHEN l LIKE 'B.1.351%' THEN 'Beta' WHEN l LIKE 'P.1%' THEN 'Gamma' WHEN l LIKE 'B.1.617.2%' OR l LIKE 'AY.%' THEN 'Delta'
 WHEN l LIKE 'B.1.1.529%' OR l LIKE 'BA.%' OR l LIKE 'BE.%' OR l LIKE 'BF.%' OR l LIKE 'BQ.%' OR l LIKE 'XBB%' OR l LIKE 'JN.%' THEN 'Omicron' ELSE 'Other' END AS variant FROM (SELECT event_id, {_pick_sql(_LINEAGES, 'user_id')} AS l FROM events)""")
def who_variant(t: Tables):
    return t.events.select("event_id", X.variant(_pick(_LINEAGES, C("user_id"))).alias("variant"))


@query("json_explode", """SELECT event_id, trim(x) AS item FROM (SELECT event_id, unnest(string_split(event_type || ' , ' || CAST(user_id % 3 AS VARCHAR), ',')) AS x FROM events)""")
def json_explode(t: Tables):
    text = F.concat(F.lit('["'), C("event_type"), F.lit(' "," '), (C("user_id") % 3).cast("string"), F.lit('"]'))
    return t.events.select("event_id", F.explode(F.from_json(text, "array<string>")).alias("x")).select("event_id", F.trim("x").alias("item"))


@query("fhir_project", """SELECT event_id, CAST(user_id AS VARCHAR) AS patient_id, event_type AS code, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def fhir_project(t: Tables):
    nested = t.events.select("event_id", F.struct(F.array(F.struct(C("event_type").alias("code"))).alias("coding")).alias("code"), F.struct(F.concat(F.lit("Patient/"), C("user_id").cast("string")).alias("reference")).alias("subject"), F.from_json("props", "k int").alias("p"))
    return nested.select("event_id", F.regexp_extract("subject.reference", r"Patient/(.+)", 1).alias("patient_id"), C("code.coding").getItem(0)["code"].alias("code"), C("p.k").alias("k"))


@query("fhir_flags", "SELECT event_id, value IS NULL AS missing_value, value < 0 AS negative, user_id IS NULL AS missing_subject FROM events WHERE event_id IS NOT NULL AND event_type IS NOT NULL")
def fhir_flags(t: Tables):
    flags = F.struct(C("value").isNull().alias("missing_value"), (C("value") < 0).alias("negative"), C("user_id").isNull().alias("missing_subject"))
    return t.events.filter("event_id is not null and event_type is not null").select("event_id", flags.alias("f")).select("event_id", "f.*")


_RANGES = "(VALUES ('click', 10.0, 60.0), ('view', 20.0, 80.0)) AS r(event_type, low, high)"


def _ranges(t: Tables):
    return F.broadcast(t.spark.createDataFrame([("click", 10.0, 60.0), ("view", 20.0, 80.0)], "event_type string, low double, high double"))


@query("fhir_vitals_range", f"SELECT e.event_id, e.value BETWEEN 0.5 * r.low AND 1.5 * r.high AS plausible, e.value < r.low OR e.value > r.high AS abnormal FROM events e JOIN {_RANGES} ON e.event_type = r.event_type")
def fhir_vitals_range(t: Tables):
    return t.events.join(_ranges(t), "event_type").select("event_id", C("value").between(C("low") * 0.5, C("high") * 1.5).alias("plausible"), ((C("value") < C("low")) | (C("value") > C("high"))).alias("abnormal"))


@query("vital_conditions", """SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) >= 140 / 1.5 AS hypertension, min(CASE WHEN event_type = 'view' THEN value END) < 9 AS hypotension, max(CASE WHEN event_type = 'purchase' THEN value END) > 99 AS tachycardia FROM events GROUP BY 1""")
def vital_conditions(t: Tables):
    v = lambda k: F.when(C("event_type") == k, C("value"))
    return t.events.groupBy("user_id").agg((F.max(v("click")) >= 140 / 1.5).alias("hypertension"), (F.min(v("view")) < 9).alias("hypotension"), (F.max(v("purchase")) > 99).alias("tachycardia"))


@query("polypharmacy", "SELECT o_custkey, count(DISTINCT l_partkey) AS n, count(DISTINCT l_partkey) >= 5 AS polypharmacy FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def polypharmacy(t: Tables):
    j = t.orders.join(t.lineitem.filter(C("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")), C("o_orderkey") == C("l_orderkey"))
    return j.groupBy("o_custkey").agg(F.countDistinct("l_partkey").alias("n")).withColumn("polypharmacy", C("n") >= 5)


@query("weighted_risk", f"""SELECT member_id, round(s, 4) AS score, CASE WHEN s >= 75 THEN 'critical' WHEN s >= 50 THEN 'high' WHEN s >= 25 THEN 'moderate' ELSE 'low' END AS category
 FROM (SELECT member_id, chronic * 20 * 0.30 + er * 15 * 0.25 + admits * 40 * 0.25 + (member_id % 100) * 0.20 AS s FROM {MEMBER_SQL})""")
def weighted_risk(t: Tables):
    s = C("chronic") * 20 * 0.30 + C("er") * 15 * 0.25 + C("admits") * 40 * 0.25 + (C("member_id") % 100) * 0.20
    return members(t).select("member_id", F.round(s, 4).alias("score"), X.ladder(s, [(75, "critical"), (50, "high"), (25, "moderate")], "low", ">=").alias("category"))


@query("fhir_resource_check", "SELECT event_id, concat_ws(',', CASE WHEN value < 5 THEN 'value_low' END, CASE WHEN event_type NOT IN ('click','view','purchase') THEN 'unsupported_type' END, CASE WHEN ts > TIMESTAMP '2024-01-29' THEN 'future_date' END) AS violations FROM events")
def fhir_resource_check(t: Tables):
    found = F.array_compact(F.array(F.when(C("value") < 5, "value_low"), F.when(~C("event_type").isin("click", "view", "purchase"), "unsupported_type"), F.when(C("ts") > F.lit("2024-01-29").cast("timestamp_ntz"), "future_date")))
    return t.events.select("event_id", F.array_join(found, ",").alias("violations"))


@query("haversine", """SELECT s_suppkey, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(30.0 + s_suppkey % 15) - radians(35.0)) / 2), 2) + cos(radians(35.0)) * cos(radians(30.0 + s_suppkey % 15)) * pow(sin(radians((-100.0 + s_suppkey % 30) - (-90.0)) / 2), 2)))), 3) AS km FROM supplier""")
def haversine(t: Tables):
    return t.supplier.select("s_suppkey", F.round(X.haversine_km(F.lit(35.0), F.lit(-90.0), 30.0 + C("s_suppkey") % 15, -100.0 + C("s_suppkey") % 30), 3).alias("km"))


_SCORED = f"""(SELECT *, ar + cr + ur + pr AS score, CASE WHEN ar + cr + ur + pr >= 9 THEN 'High' WHEN ar + cr + ur + pr >= 6 THEN 'Medium' WHEN ar + cr + ur + pr >= 3 THEN 'Low' ELSE 'Very Low' END AS tier FROM (SELECT *, CASE WHEN age < 1 THEN 3 WHEN age < 5 THEN 2 WHEN age >= 75 THEN 3 WHEN age >= 65 THEN 2 ELSE 1 END AS ar,
 CASE WHEN chronic >= 3 THEN 3 WHEN chronic >= 2 THEN 2 WHEN chronic >= 1 THEN 1 ELSE 0 END AS cr, CASE WHEN er >= 4 OR admits >= 2 THEN 3 WHEN er >= 2 OR admits >= 1 THEN 2 WHEN er >= 1 THEN 1 ELSE 0 END AS ur,
 CASE WHEN balance * 6 >= 50000 THEN 3 WHEN balance * 6 >= 25000 THEN 2 WHEN balance * 6 >= 10000 THEN 1 ELSE 0 END AS pr FROM (SELECT *, 2001 - year(birth) AS age FROM {MEMBER_SQL})))"""


def scored(t: Tables):
    d = members(t).withColumn("age", X.age_boundary(C("birth"), F.lit("2001-08-01").cast("date")))
    d = d.withColumns(X.risk_scores(C("age"), C("chronic"), C("er"), C("admits"), C("balance") * 6))
    return d.withColumn("risk_tier", X.risk_tier(C("composite_risk_score")))


@query("risk_tier", f"SELECT member_id, ar AS age_risk_score, cr AS chronic_condition_risk_score, ur AS utilization_risk_score, pr AS cost_risk_score, score AS composite_risk_score, tier AS risk_tier FROM {_SCORED}")
def risk_tier(t: Tables):
    return scored(t).select("member_id", "age_risk_score", "chronic_condition_risk_score", "utilization_risk_score", "cost_risk_score", "composite_risk_score", "risk_tier")


@query("vaccine_elig", f"""SELECT member_id, age >= 65 OR chronic >= 1 AS flu_vaccine_eligible, age >= 65 OR chronic = 1 OR chronic = 2 OR chronic = 3 AS pneumococcal_vaccine_eligible, age >= 50 AS shingles_vaccine_eligible, age BETWEEN 19 AND 26 AS hpv_vaccine_eligible,
 CASE tier WHEN 'High' THEN 80 WHEN 'Medium' THEN 60 WHEN 'Low' THEN 40 ELSE 20 END + CASE WHEN age >= 65 THEN 15 ELSE 0 END + CASE WHEN chronic >= 3 THEN 5 ELSE 0 END AS priority FROM {_SCORED} WHERE tier IN ('High', 'Medium') OR age >= 65 OR chronic >= 1""")
def vaccine_elig(t: Tables):
    d = scored(t).filter(C("risk_tier").isin("High", "Medium") | (C("age") >= 65) | (C("chronic") >= 1))
    flags = X.vaccine_flags(C("age"), C("chronic"), C("chronic") == 1, C("chronic") == 2, C("chronic") == 3)
    return d.withColumns(flags).select("member_id", *flags, X.vaccine_priority(C("risk_tier"), C("age"), C("chronic")).alias("priority"))


@query("outreach_score", f"""SELECT member_id, round(s, 6) AS score, CASE WHEN s >= 80 THEN 'Tier 1 - Immediate' WHEN s >= 60 THEN 'Tier 2 - High Priority' WHEN s >= 40 THEN 'Tier 3 - Standard' ELSE 'Tier 4 - Routine' END AS tier,
 CASE WHEN s >= 80 THEN 'Phone Call + Letter' WHEN s >= 60 THEN 'Phone Call' WHEN s >= 40 THEN 'Letter' ELSE 'Email/Portal Message' END AS method,
 CASE WHEN (age >= 65 OR chronic >= 1) AND er >= 2 THEN 3500 WHEN age >= 65 AND chronic >= 2 THEN 5000 ELSE 1500 END AS preventable_cost FROM
 (SELECT *, round((CASE tier WHEN 'High' THEN 80 WHEN 'Medium' THEN 60 WHEN 'Low' THEN 40 ELSE 20 END) * 0.4 + (score / 12.0) * 100 * 0.3 + (er / 5.0) * 100 * 0.2 + (chronic / 4.0) * 100 * 0.1, 9) AS s FROM {_SCORED})""")
def outreach_score(t: Tables):
    base = F.when(C("risk_tier") == "High", 80).when(C("risk_tier") == "Medium", 60).when(C("risk_tier") == "Low", 40).otherwise(20)
    d = scored(t).withColumn("s", F.round(X.outreach_score(base, C("composite_risk_score") / 12.0, C("er") / 5.0, C("chronic") / 4.0), 9)).withColumn("tier", X.outreach_tier(C("s")))
    cost = F.when(((C("age") >= 65) | (C("chronic") >= 1)) & (C("er") >= 2), 3500).when((C("age") >= 65) & (C("chronic") >= 2), 5000).otherwise(1500)
    return d.select("member_id", F.round("s", 6).alias("score"), "tier", X.outreach_method(C("tier")).alias("method"), cost.alias("preventable_cost"))


_OUT = "(SELECT event_id, user_id % 15 / 100.0 AS r, user_id % 70 / 100.0 AS d, value / 40.0 AS z FROM events)"


@query("outbreak_score", f"""SELECT event_id, s AS score, CASE WHEN s >= 50 THEN 'HIGH' WHEN s >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT event_id, CASE WHEN r > 0.1 THEN 25 WHEN r > 0.05 THEN 15 WHEN r > 0.02 THEN 5 ELSE 0 END + CASE WHEN d > 0.5 THEN 25 WHEN d > 0.2 THEN 15 WHEN d > 0.1 THEN 5 ELSE 0 END + CASE WHEN z > 2.0 THEN 25 WHEN z > 1.0 THEN 15 WHEN z > 0.5 THEN 5 ELSE 0 END AS s FROM {_OUT})""")
def outbreak_score(t: Tables):
    s = X.outbreak_score(C("user_id") % 15 / 100.0, C("user_id") % 70 / 100.0, C("value") / 40.0)
    return t.events.select("event_id", s.alias("score")).withColumn("level", X.outbreak_level(C("score")))


@query("overdue_days", "SELECT o_orderkey, d > 30 AS overdue, CAST(greatest(d - 30, 0) AS INTEGER) AS overdue_days FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS d FROM orders)")
def overdue_days(t: Tables):
    d = F.datediff(F.lit("1998-08-02").cast("date"), C("o_orderdate").cast("date"))
    return t.orders.select("o_orderkey", (d > 30).alias("overdue"), F.greatest(d - 30, F.lit(0)).alias("overdue_days"))


@query("device_risk_band", """SELECT event_id, lv AS level, CASE lv WHEN 'CRITICAL' THEN 'IMMEDIATE ACTION REQUIRED: Emergency maintenance' WHEN 'HIGH' THEN 'Schedule urgent maintenance within 24 hours' WHEN 'MEDIUM' THEN 'Schedule maintenance within 7 days' ELSE 'Continue normal operations' END AS advice
 FROM (SELECT event_id, CASE WHEN p >= 80 THEN 'CRITICAL' WHEN p >= 60 THEN 'HIGH' WHEN p >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS lv FROM (SELECT event_id, user_id % 101 AS p FROM events))""")
def device_risk_band(t: Tables):
    p = (C("user_id") % 101 + 0.5) / 100
    return t.events.select("event_id", X.device_level(p).alias("level")).withColumn("advice", X.device_advice(C("level")))


_LABS = "(VALUES ('click', 35.0, 1.1), ('VIEW', 30.0, 1.3)) AS b(lab, cut, fnr)"


@query("lab_reclassify", f"SELECT e.event_id, CASE WHEN b.lab IS NULL THEN 'as reported' WHEN e.value / 2 <= b.cut THEN 'positive' ELSE 'negative' END AS called, coalesce(b.fnr, 1.0) AS fnr_multiplier FROM events e LEFT JOIN {_LABS} ON lower(e.event_type) = lower(b.lab)")
def lab_reclassify(t: Tables):
    labs = F.broadcast(t.spark.createDataFrame([("click", 35.0, 1.1), ("VIEW", 30.0, 1.3)], "lab string, cut double, fnr double"))
    j = t.events.join(labs, F.lower("event_type") == F.lower("lab"), "left")
    return j.select("event_id", F.when(C("lab").isNull(), "as reported").when(C("value") / 2 <= C("cut"), "positive").otherwise("negative").alias("called"), F.coalesce("fnr", F.lit(1.0)).alias("fnr_multiplier"))


@query("report_lag", "SELECT l_orderkey, l_linenumber, CAST(d AS INTEGER) AS lag_days, dayofweek(l_shipdate) IN (0, 6) AS weekend FROM (SELECT l_orderkey, l_linenumber, l_shipdate, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE d >= 0")
def report_lag(t: Tables):
    j = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).withColumn("lag_days", F.datediff(C("l_shipdate").cast("date"), C("o_orderdate").cast("date")))
    return j.filter("lag_days >= 0").select("l_orderkey", "l_linenumber", "lag_days", F.dayofweek("l_shipdate").isin(1, 7).alias("weekend"))


@query("canon_name", "SELECT c_custkey, trim(replace(replace(upper(c_name), 'CUSTOMER', 'CUST'), '#', ' ')) AS name FROM customer")
def canon_name(t: Tables):
    name = F.upper("c_name")
    for old, new in (("CUSTOMER", "CUST"), ("#", " ")):
        name = F.replace(name, F.lit(old), F.lit(new))
    return t.customer.select("c_custkey", F.trim(name).alias("name"))


_FAC = "(SELECT user_id AS f, sum(value) AS used, count(*) AS beds, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS absent, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM events GROUP BY 1)"


def facilities(t: Tables):
    return t.events.groupBy(C("user_id").alias("f")).agg(F.sum("value").alias("used"), F.count("*").alias("beds"), F.count_if(C("event_type") == "error").alias("absent"), F.count_if(C("event_type") == "purchase").alias("positive"))


@query("facility_metrics", f"SELECT f, round(used / (beds * 100.0), 6) AS occupancy, absent > 0.1 * beds AS shortage, round(positive * 1.0 / beds, 6) AS positivity, round(0.4 + CASE WHEN absent > 0 THEN 0.3 ELSE 0 END + CASE WHEN positive > 0 THEN 0.3 ELSE 0 END, 2) AS completeness FROM {_FAC}")
def facility_metrics(t: Tables):
    return facilities(t).select("f", F.round(C("used") / (C("beds") * 100.0), 6).alias("occupancy"), (C("absent") > 0.1 * C("beds")).alias("shortage"), F.round(C("positive") / C("beds"), 6).alias("positivity"), F.round(0.4 + F.when(C("absent") > 0, 0.3).otherwise(0) + F.when(C("positive") > 0, 0.3).otherwise(0), 2).alias("completeness"))


@query("facility_checks", f"SELECT f, positive <= beds AND absent <= beds AND used >= 0 AND used <= beds * 60.0 AS ok FROM {_FAC}")
def facility_checks(t: Tables):
    return facilities(t).select("f", ((C("positive") <= C("beds")) & (C("absent") <= C("beds")) & (C("used") >= 0) & (C("used") <= C("beds") * 60.0)).alias("ok"))


@query("cat_score", """SELECT user_id, CAST(s AS BIGINT) AS total, CASE WHEN s > 30 THEN 'very high' WHEN s > 20 THEN 'high' WHEN s >= 10 THEN 'medium' ELSE 'low' END AS impact FROM (SELECT user_id, sum(least(CAST(floor(value / 25) AS INTEGER), 5)) % 41 AS s FROM events GROUP BY 1)""")
def cat_score(t: Tables):
    d = t.events.groupBy("user_id").agg((F.sum(F.least(F.floor(C("value") / 25).cast("int"), F.lit(5))) % 41).alias("total"))
    return d.withColumn("impact", F.when(C("total") > 30, "very high").when(C("total") > 20, "high").when(C("total") >= 10, "medium").otherwise("low"))


@query("symptom_alerts", "SELECT event_id, unnest(list_filter([CASE WHEN value > 90 THEN 'high_risk' END, CASE WHEN event_type = 'error' THEN 'missed_medication' END, CASE WHEN user_id % 10 >= 4 AND event_type = 'purchase' THEN 'rescue_overuse' END], lambda x: x IS NOT NULL)) AS alert FROM events")
def symptom_alerts(t: Tables):
    alerts = F.array_compact(F.array(F.when(C("value") > 90, "high_risk"), F.when(C("event_type") == "error", "missed_medication"), F.when((C("user_id") % 10 >= 4) & (C("event_type") == "purchase"), "rescue_overuse")))
    return t.events.select("event_id", F.explode(alerts).alias("alert"))


@query("exacerbation_risk", "SELECT event_id, CASE WHEN major >= 2 THEN 'high' WHEN major = 1 AND minor >= 1 THEN 'moderate' WHEN minor >= 2 THEN 'low' ELSE 'none' END AS risk FROM (SELECT event_id, CAST(value > 50 AS INTEGER) + CAST(user_id % 2 = 0 AS INTEGER) AS major, CAST(user_id % 3 = 0 AS INTEGER) + CAST(user_id % 5 = 0 AS INTEGER) AS minor FROM events)")
def exacerbation_risk(t: Tables):
    major = (C("value") > 50).cast("int") + (C("user_id") % 2 == 0).cast("int")
    minor = (C("user_id") % 3 == 0).cast("int") + (C("user_id") % 5 == 0).cast("int")
    return t.events.select("event_id", F.when(major >= 2, "high").when((major == 1) & (minor >= 1), "moderate").when(minor >= 2, "low").otherwise("none").alias("risk"))


@query("eq5d", f"SELECT member_id, CAST(1 + chronic AS VARCHAR) || CAST(1 + er % 5 AS VARCHAR) || CAST(1 + admits AS VARCHAR) AS state, round(1 - 0.05 * chronic - 0.04 * (er % 5) - 0.06 * admits, 4) AS utility FROM {MEMBER_SQL}")
def eq5d(t: Tables):
    state = F.concat(*((1 + x).cast("string") for x in (C("chronic"), C("er") % 5, C("admits"))))
    return members(t).select("member_id", state.alias("state"), F.round(1 - 0.05 * C("chronic") - 0.04 * (C("er") % 5) - 0.06 * C("admits"), 4).alias("utility"))


@query("literacy_band", "SELECT c_custkey, score, CASE WHEN score < 24 THEN 'low' WHEN score <= 32 THEN 'moderate' ELSE 'high' END AS band FROM (SELECT c_custkey, CAST(list_sum(list_transform(range(1, 9), lambda i: 1 + (c_custkey * i + c_nationkey) % 5)) AS INTEGER) AS score FROM customer)")
def literacy_band(t: Tables):
    """Eight answers of 1 to 5 each, summed."""
    score = sum((1 + (C("c_custkey") * i + C("c_nationkey")) % 5 for i in range(1, 9)), F.lit(0)).cast("int")
    return t.customer.select("c_custkey", score.alias("score")).select("*", X.ladder(C("score"), [(33, "high"), (24, "moderate")], "low", ">=").alias("band"))


@query("surrogate_key", "SELECT l_orderkey, l_linenumber, md5(concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), coalesce(nullif(l_returnflag, 'A'), '_null_'))) AS key FROM lineitem")
def surrogate_key(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", X.surrogate_key(C("l_orderkey"), C("l_linenumber"), F.nullif(C("l_returnflag"), F.lit("A"))).alias("key"))


@query("barrier_score", f"SELECT member_id, b AS barriers, CASE WHEN b >= 3 THEN 'high' WHEN b >= 2 THEN 'moderate' ELSE 'low' END AS band FROM (SELECT member_id, CAST(chronic > 2 AS INTEGER) + CAST(er > 3 AS INTEGER) + CAST(admits > 1 AS INTEGER) + CAST(balance < 0 AS INTEGER) AS b FROM {MEMBER_SQL})")
def barrier_score(t: Tables):
    b = (C("chronic") > 2).cast("int") + (C("er") > 3).cast("int") + (C("admits") > 1).cast("int") + (C("balance") < 0).cast("int")
    return members(t).select("member_id", b.alias("barriers"), X.ladder(b, [(3, "high"), (2, "moderate")], "low", ">=").alias("band"))


@query("wedge_status", "SELECT event_id, CASE WHEN dayofmonth(ts) // 6 >= user_id % 5 THEN 'intervention' ELSE 'control' END AS status FROM events")
def wedge_status(t: Tables):
    return t.events.select("event_id", F.when(F.floor(F.dayofmonth("ts") / 6) >= C("user_id") % 5, "intervention").otherwise("control").alias("status"))


@query("its_columns", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AS INTEGER) AS intervention, CAST(greatest(date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)), 0) AS INTEGER) AS time_after, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(quarter(o_orderdate) AS INTEGER) AS q FROM orders")
def its_columns(t: Tables):
    d, at = C("o_orderdate").cast("date"), F.lit("1998-01-01").cast("date")
    return t.orders.select("o_orderkey", (d >= at).cast("int").alias("intervention"), F.greatest(F.datediff(d, at), F.lit(0)).alias("time_after"), F.month(d).alias("m"), F.quarter(d).alias("q"))


@query("churn_features", "SELECT c_custkey, CASE WHEN t < 12 THEN '0-1 yr' WHEN t < 24 THEN '1-2 yr' WHEN t < 48 THEN '2-4 yr' ELSE '4+ yr' END AS tenure_group, round(c_acctbal / greatest(t, 1), 8) AS avg_spend, t < 6 AS is_new, t >= 48 AS long_term, c_acctbal > m AS high_value FROM (SELECT c_custkey, c_acctbal, c_custkey % 72 AS t, (SELECT median(c_acctbal) FROM customer) AS m FROM customer)")
def churn_features(t: Tables):
    months = C("c_custkey") % 72
    m = Q.quantiles(t.customer, [], "c_acctbal", {"m": 0.5})
    band = X.ladder(months, [(12, "0-1 yr"), (24, "1-2 yr"), (48, "2-4 yr")], "4+ yr")
    return t.customer.crossJoin(F.broadcast(m)).select("c_custkey", band.alias("tenure_group"), F.round(C("c_acctbal") / F.greatest(months, F.lit(1)), 8).alias("avg_spend"), (months < 6).alias("is_new"), (months >= 48).alias("long_term"), (C("c_acctbal") > C("m")).alias("high_value"))


@query("bin_quantile", "SELECT c_custkey, CASE WHEN c_acctbal <= a THEN 'Low' WHEN c_acctbal <= b THEN 'Med' ELSE 'High' END AS bin FROM customer, (SELECT quantile_cont(c_acctbal, 1/3.0) AS a, quantile_cont(c_acctbal, 2/3.0) AS b FROM customer)")
def bin_quantile(t: Tables):
    cuts = Q.quantiles(t.customer, [], "c_acctbal", {"a": 1 / 3, "b": 2 / 3})
    return t.customer.crossJoin(F.broadcast(cuts)).select("c_custkey", F.when(C("c_acctbal") <= C("a"), "Low").when(C("c_acctbal") <= C("b"), "Med").otherwise("High").alias("bin"))


@query("tally_checks", "SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS parts, count(*) AS n, abs(sum(l_quantity) - sum(l_linenumber) * 7) > 0.05 * sum(l_quantity) AS mismatch, max(l_quantity) > 0.9 * sum(l_quantity) AS one_sided FROM lineitem GROUP BY 1")
def tally_checks(t: Tables):
    q = F.sum("l_quantity")
    return t.lineitem.groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("parts"), F.count("*").alias("n"), (F.abs(q - F.sum("l_linenumber") * 7) > 0.05 * q).alias("mismatch"), (F.max("l_quantity") > 0.9 * q).alias("one_sided"))


@query("backoff_time", "SELECT event_id, ts + to_minutes(CAST(pow(2, user_id % 6) AS INTEGER)) AS process_after FROM events")
def backoff_time(t: Tables):
    return t.events.select("event_id", X.backoff(C("ts"), C("user_id") % 6).alias("process_after"))


@query("census_rates", "SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS geo, round(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) * 1.0 / nullif(count(c_custkey), 0), 6) AS share FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def census_rates(t: Tables):
    j = t.nation.join(t.customer, C("c_nationkey") == C("n_nationkey"), "left").groupBy("n_nationkey").agg(F.round(F.try_divide(F.count_if(C("c_acctbal") > 0), F.nullif(F.count("c_custkey"), F.lit(0))), 6).alias("share"))
    return j.select("n_nationkey", F.lpad(C("n_nationkey").cast("string"), 5, "0").alias("geo"), "share")
