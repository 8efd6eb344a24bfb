"""Statistics, drift, imputation, nowcasting and models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clinical as X
from ..operators import quantiles as Q
from ..operators import statistics as S
from .expressions import members
from .registry import Tables, query

C = F.col
OLD = "CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 0 ELSE 1 END"


def half():
    return F.when(C("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), 0).otherwise(1)


@query("stat_corr", "SELECT round(corr(l_quantity, l_extendedprice), 7) AS q_price, round(corr(l_quantity, l_discount), 7) AS q_discount, round(corr(l_extendedprice, l_discount), 7) AS price_discount, count(*) AS n FROM lineitem")
def stat_corr(t: Tables):
    return t.lineitem.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 7).alias("q_price"), F.round(F.corr("l_quantity", "l_discount"), 7).alias("q_discount"), F.round(F.corr("l_extendedprice", "l_discount"), 7).alias("price_discount"), F.count("*").alias("n"))


@query("stat_missing_assoc", "SELECT round(100.0 * avg(miss), 5) AS pct_missing, round(corr(miss, value), 7) AS association FROM (SELECT CASE WHEN event_type = 'signup' THEN 1.0 ELSE 0.0 END AS miss, value FROM events)")
def stat_missing_assoc(t: Tables):
    d = t.events.select(F.nullif("event_type", F.lit("signup")).isNull().cast("double").alias("miss"), "value")
    return d.agg(F.round(100.0 * F.avg("miss"), 5).alias("pct_missing"), F.round(F.corr("miss", "value"), 7).alias("association"))


def _skew_sql(c: str, t: str) -> str:
    return f"SELECT '{c}' AS column_name, round(avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5), 5) AS skew, abs(avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5)) > 1 AS skewed FROM {t}, (SELECT avg({c}) AS m FROM {t})"


@query("stat_skew", _skew_sql("value", "events") + " UNION ALL " + _skew_sql("user_id", "events"))
def stat_skew(t: Tables):
    one = t.events.agg(*(F.skewness(c).alias(c) for c in ("value", "user_id")))
    items = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), C(c).alias("skew")) for c in one.columns)))
    return one.select(items.alias("x")).select("x.column_name", F.round("x.skew", 5).alias("skew"), (F.abs("x.skew") > 1).alias("skewed"))


@query("stat_vif")
def stat_vif(t: Tables):
    """Diagonal of the inverse correlation matrix; the correlations are one distributed pass."""
    import numpy as np

    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    v = VectorAssembler(inputCols=cols, outputCol="v").transform(t.lineitem)
    inverse = np.linalg.inv(Correlation.corr(v, "v").first()[0].toArray())
    return t.spark.createDataFrame([(c, float(inverse[i, i])) for i, c in enumerate(cols)], "column_name string, vif double")


@query("stat_anova", """WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) AS nm, sum(n * m * m) AS nmm, sum(v * (n - 1)) AS w FROM g)
 SELECT round((nmm - nm * nm / n) / (k - 1) / (w / (n - k)), 6) AS f, CAST(k - 1 AS BIGINT) AS df1, CAST(n - k AS BIGINT) AS df2 FROM s""")
def stat_anova(t: Tables):
    return S.anova(t.events, C("event_type"), C("value")).withColumn("f", F.round("f", 6))


_TWO = "(SELECT count(value) FILTER (user_id % 2 = 0) AS n0, avg(value) FILTER (user_id % 2 = 0) AS m0, var_samp(value) FILTER (user_id % 2 = 0) AS v0, count(value) FILTER (user_id % 2 = 1) AS n1, avg(value) FILTER (user_id % 2 = 1) AS m1, var_samp(value) FILTER (user_id % 2 = 1) AS v1 FROM events)"


@query("stat_ttest", f"SELECT round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)), 7) AS t, n0 + n1 - 2 AS df FROM {_TWO}")
def stat_ttest(t: Tables):
    p = S.pooled()
    return S.two_groups(t.events, C("user_id") % 2, C("value")).select(F.round(p["t"], 7).alias("t"), p["df"].alias("df"))


@query("stat_welch", f"SELECT round((m1 - m0) / sqrt(v0 / n0 + v1 / n1), 7) AS t, round(pow(v0 / n0 + v1 / n1, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1)), 4) AS df FROM {_TWO}")
def stat_welch(t: Tables):
    w = S.welch()
    return S.two_groups(t.events, C("user_id") % 2, C("value")).select(F.round(w["welch_t"], 7).alias("t"), F.round(w["welch_df"], 4).alias("df"))


@query("stat_chi2", """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c)
 SELECT round(sum(pow(coalesce(n, 0) - na * nb / t, 2) / (na * nb / t)), 6) AS chi2, CAST((count(DISTINCT r.a) - 1) * (count(DISTINCT k.b) - 1) AS BIGINT) AS df FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b""")
def stat_chi2(t: Tables):
    return S.chi_square(t.lineitem, C("l_returnflag"), C("l_linestatus")).withColumn("chi2", F.round("chi2", 6))


@query("stat_cohens_d", f"SELECT round(d, 7) AS d, CASE WHEN abs(d) >= 0.8 THEN 'large' WHEN abs(d) >= 0.5 THEN 'medium' WHEN abs(d) >= 0.2 THEN 'small' ELSE 'negligible' END AS band FROM (SELECT (m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) AS d FROM {_TWO})")
def stat_cohens_d(t: Tables):
    d = S.two_groups(t.events, C("user_id") % 2, C("value")).select(S.pooled()["cohens_d"].alias("d"))
    a = F.abs("d")
    return d.select(F.round("d", 7).alias("d"), F.when(a >= 0.8, "large").when(a >= 0.5, "medium").when(a >= 0.2, "small").otherwise("negligible").alias("band"))


@query("stat_stratified", "SELECT event_type, round(a - b, 6) AS effect, round((a - b) / max(CASE WHEN event_type = 'click' THEN a - b END) OVER (), 5) AS disparity FROM (SELECT event_type, avg(value) FILTER (user_id % 2 = 1) AS a, avg(value) FILTER (user_id % 2 = 0) AS b FROM events GROUP BY 1)")
def stat_stratified(t: Tables):
    g = t.events.groupBy("event_type").agg((F.avg(F.when(C("user_id") % 2 == 1, C("value"))) - F.avg(F.when(C("user_id") % 2 == 0, C("value")))).alias("e"))
    ref = F.max(F.when(C("event_type") == "click", C("e"))).over(W.partitionBy(F.lit(0)))  # a few strata
    return g.select("event_type", F.round("e", 6).alias("effect"), F.round(C("e") / ref, 5).alias("disparity"))


@query("stat_interaction")
def stat_interaction(t: Tables):
    """Likelihood ratio of a model with an effect x stratum term against one without."""
    d = t.events.select(C("value").alias("y"), (C("user_id") % 2).cast("double").alias("arm"), (C("event_type") == "click").cast("double").alias("s"), F.lit(1).alias("one")).withColumn("both", C("arm") * C("s"))

    def rss(cols):
        m = LinearRegression(featuresCol="x", labelCol="y", solver="normal").fit(VectorAssembler(inputCols=cols, outputCol="x").transform(d))
        return m.summary.meanSquaredError * m.summary.numInstances, m.summary.numInstances

    (small, n), (big, _) = rss(["arm", "s"]), rss(["arm", "s", "both"])
    import math

    lr = n * math.log(small / big)
    return t.spark.createDataFrame([(float(lr), math.erfc(math.sqrt(max(lr, 0) / 2)), int(n))], "lr double, p double, n long")


@query("stat_trend", "SELECT user_id, round(regr_slope(n, x), 7) AS slope, round(regr_r2(n, x), 7) AS r2, CASE WHEN regr_slope(n, x) > 0.05 THEN 'increasing' WHEN regr_slope(n, x) < -0.05 THEN 'decreasing' ELSE 'stable' END AS direction FROM (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS x, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def stat_trend(t: Tables):
    d = t.events.groupBy("user_id", F.datediff(C("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("x")).agg(F.count("*").alias("n"))
    s = F.regr_slope("n", "x")
    return d.groupBy("user_id").agg(F.round(s, 7).alias("slope"), F.round(F.regr_r2("n", "x"), 7).alias("r2"), F.when(s > 0.05, "increasing").when(s < -0.05, "decreasing").otherwise("stable").alias("direction"))


_DAYS = "(SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY 1)"
_LINES = f"""l AS (SELECT regr_slope(y, t) FILTER (t < 14) AS b0, regr_intercept(y, t) FILTER (t < 14) AS a0, count(*) FILTER (t < 14) AS n0, avg(t) FILTER (t < 14) AS m0, regr_sxx(y, t) FILTER (t < 14) AS s0,
 regr_slope(y, t) FILTER (t >= 14) AS b1, regr_intercept(y, t) FILTER (t >= 14) AS a1, count(*) FILTER (t >= 14) AS n1, avg(t) FILTER (t >= 14) AS m1, regr_sxx(y, t) FILTER (t >= 14) AS s1 FROM {_DAYS})"""
_PULLS = {
    "intercept": "CASE WHEN t < 14 THEN 1 / n0 - m0 * (t - m0) / s0 ELSE 0 END",
    "slope": "CASE WHEN t < 14 THEN (t - m0) / s0 ELSE 0 END",
    "level_change": "CASE WHEN t < 14 THEN -(1 / n0 + (14 - m0) * (t - m0) / s0) ELSE 1 / n1 + (14 - m1) * (t - m1) / s1 END",
    "slope_change": "CASE WHEN t < 14 THEN -(t - m0) / s0 ELSE (t - m1) / s1 END",
}
_HAC = ", ".join(f"round(sqrt(greatest(sum(g_{c} * g_{c}) + 2 * sum({' + '.join(f'{1 - k / 4} * g_{c} * coalesce(g_{c}_{k}, 0)' for k in (1, 2, 3))}), 0)), 6) AS {c}_se" for c in _PULLS)


@query("stat_its", f"""WITH {_LINES}, e AS (SELECT t, y - CASE WHEN t < 14 THEN a0 + b0 * t ELSE a1 + b1 * t END AS e, {', '.join(f'{p} AS h_{c}' for c, p in _PULLS.items())} FROM {_DAYS}, l),
 g AS (SELECT e, e - lag(e) OVER (ORDER BY t) AS gap, {', '.join(f'h_{c} * e AS g_{c}' for c in _PULLS)}, {', '.join(f'lag(h_{c} * e, {k}) OVER (ORDER BY t) AS g_{c}_{k}' for c in _PULLS for k in (1, 2, 3))} FROM e)
 SELECT count(*) AS days, round(any_value(a0), 6) AS intercept, round(any_value(b0), 6) AS slope, round(any_value(a1 + 14 * b1 - a0 - 14 * b0), 6) AS level_change, round(any_value(b1 - b0), 6) AS slope_change, {_HAC}, round(sum(gap * gap) / sum(e * e), 6) AS durbin_watson FROM g, l""")
def stat_its(t: Tables):
    """Segmented regression of daily counts: level and slope change on 15 January with errors that allow for three days of autocorrelation, and Durbin-Watson."""
    r = S.interrupted(_daily_counts(t), "time", "y", 14, 3)
    return r.select("days", *(F.round(c, 6).alias(c) for c in r.columns if c != "days"))


def _daily_counts(t: Tables):
    x = F.datediff(C("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return t.events.groupBy(x.alias("time")).agg(F.count("*").cast("double").alias("y"))


@query("stat_its_counterfactual", f"WITH {_LINES} SELECT t AS time, y, round(CASE WHEN t < 14 THEN a0 + b0 * t ELSE a1 + b1 * t END, 6) AS fitted, round(a0 + b0 * t, 6) AS counterfactual, round(CASE WHEN t < 14 THEN 0 ELSE a1 + b1 * t - a0 - b0 * t END, 6) AS effect FROM {_DAYS}, l")
def stat_its_counterfactual(t: Tables):
    """Each day's count, what the two lines say, what the first one says for the days after, and the difference."""
    r = S.counterfactual(_daily_counts(t), "time", "y", 14)
    return r.select("time", "y", *(F.round(c, 6).alias(c) for c in ("fitted", "counterfactual", "effect")))


@query("stat_logit_cluster")
def stat_logit_cluster(t: Tables):
    """Odds ratio of being a purchase, with an error robust to clusters by user: per-cluster scores are summed on executors."""
    d = t.events.select((C("event_type") == "purchase").cast("double").alias("y"), (C("value") > 50).cast("double").alias("x1"), "user_id")
    v = VectorAssembler(inputCols=["x1"], outputCol="x").transform(d)
    m = GeneralizedLinearRegression(family="binomial", featuresCol="x", labelCol="y", tol=1e-10).fit(v)
    p = m.transform(v).withColumn("r", C("y") - C("prediction")).withColumn("w", C("prediction") * (1 - C("prediction")))
    bread = p.agg(F.sum("w").alias("a"), F.sum(C("w") * C("x1")).alias("b"), F.sum(C("w") * C("x1") * C("x1")).alias("c"))
    meat = p.groupBy("user_id").agg(F.sum("r").alias("u0"), F.sum(C("r") * C("x1")).alias("u1")).agg(F.sum(C("u0") * C("u0")).alias("m00"), F.sum(C("u0") * C("u1")).alias("m01"), F.sum(C("u1") * C("u1")).alias("m11"), F.count("*").alias("clusters"))
    det = C("a") * C("c") - C("b") * C("b")
    i01, i11 = -C("b") / det, C("a") / det
    var = i01 * i01 * C("m00") + 2 * i01 * i11 * C("m01") + i11 * i11 * C("m11")
    return bread.crossJoin(meat).select(F.lit(float(m.coefficients[0])).alias("log_odds"), F.exp(F.lit(float(m.coefficients[0]))).alias("odds_ratio"), F.sqrt(var).alias("robust_se"), "clusters")


@query("stat_logit_cluster_terms")
def stat_logit_cluster_terms(t: Tables):
    """The same for several covariates at once, a row for each."""
    d = t.events.select((C("event_type") == "purchase").cast("int").alias("buys"), (C("value") > 50).cast("int").alias("high"), F.dayofweek("ts").alias("weekday"), (C("user_id") % 2).alias("arm"), "user_id")
    return S.logit_by_cluster(d, "buys", ["high", "weekday", "arm"], "user_id")


@query("stat_icc", """WITH g AS (SELECT user_id, count(*) AS n, avg(value) AS m, coalesce(var_samp(value), 0) AS v FROM events GROUP BY 1), s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * n) AS nn, sum(n * m) AS nm, sum(n * m * m) AS nmm, sum(v * (n - 1)) AS w FROM g)
 SELECT round(greatest((b - w1) / (b + (n0 - 1) * w1), 0), 8) AS icc FROM (SELECT (nmm - nm * nm / n) / (k - 1) AS b, w / (n - k) AS w1, (n - nn / n) / (k - 1) AS n0 FROM s)""")
def stat_icc(t: Tables):
    g = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"))
    s = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(C("n") * C("n")).alias("nn"), F.sum(C("n") * C("m")).alias("nm"), F.sum(C("n") * C("m") * C("m")).alias("nmm"), F.sum(C("v") * (C("n") - 1)).alias("w"))
    b, w = (C("nmm") - C("nm") * C("nm") / C("n")) / (C("k") - 1), C("w") / (C("n") - C("k"))
    n0 = (C("n") - C("nn") / C("n")) / (C("k") - 1)
    return s.select(F.round(F.greatest((b - w) / (b + (n0 - 1) * w), F.lit(0.0)), 8).alias("icc"))


@query("stat_sample_size", "SELECT event_type, CAST(ceil(2 * pow(1.96 + 0.84, 2) * v / pow(5, 2) * (1 + 19 * 0.05)) AS BIGINT) AS per_arm, CAST(ceil(2 * pow(1.96 + 0.84, 2) * v / pow(5, 2) * (1 + 19 * 0.05) / 20) AS BIGINT) AS clusters FROM (SELECT event_type, var_samp(value) AS v FROM events GROUP BY 1)")
def stat_sample_size(t: Tables):
    n = 2 * F.pow(F.lit(1.96 + 0.84), F.lit(2)) * C("v") / 25.0 * (1 + 19 * 0.05)
    return t.events.groupBy("event_type").agg(F.var_samp("value").alias("v")).select("event_type", F.ceil(n).alias("per_arm"), F.ceil(n / 20).alias("clusters"))


@query("stat_drift_ks", f"""WITH c AS (SELECT event_type, value, count(*) FILTER ({OLD} = 0) AS a, count(*) FILTER ({OLD} = 1) AS b FROM events GROUP BY 1, 2), g AS (SELECT event_type, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY event_type) - sum(b) OVER w / sum(b) OVER (PARTITION BY event_type)) AS gap, a, b FROM c WINDOW w AS (PARTITION BY event_type ORDER BY value))
 SELECT event_type, round(max(gap), 8) AS ks, CAST(sum(a) AS BIGINT) AS n0, CAST(sum(b) AS BIGINT) AS n1 FROM g GROUP BY 1""")
def stat_drift_ks(t: Tables):
    return S.ks(t.events, "event_type", half(), "value").withColumn("ks", F.round("ks", 8))


@query("stat_drift_ks_level", f"""WITH c AS (SELECT event_type, value, count(*) FILTER ({OLD} = 0) AS a, count(*) FILTER ({OLD} = 1) AS b FROM events GROUP BY 1, 2), g AS (SELECT event_type, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY event_type) - sum(b) OVER w / sum(b) OVER (PARTITION BY event_type)) AS gap, value, a, b FROM c WINDOW w AS (PARTITION BY event_type ORDER BY value)),
 d AS (SELECT event_type, max(gap) AS ks, sum(a) * 1.0 * sum(b) / (sum(a) + sum(b)) AS ne, 100.0 * (sum(value * b) / sum(b) / (sum(value * a) / sum(a)) - 1) AS shift FROM g GROUP BY 1),
 p AS (SELECT *, (sqrt(ne) + 0.12 + 0.11 / sqrt(ne)) * ks AS x FROM d), q AS (SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * x * x))), 0.0), 1.0) END AS p FROM p)
 SELECT event_type, round(ks, 8) AS ks, round(p, 7) AS p, round(shift, 5) AS mean_shift_pct, p < 0.05 AS drift, CASE WHEN count(*) FILTER (p < 0.05) OVER () > 3 THEN 'HIGH' WHEN count(*) FILTER (p < 0.05) OVER () > 0 THEN 'MEDIUM' ELSE 'LOW' END AS alert_level FROM q""")
def stat_drift_ks_level(t: Tables):
    """Per event type the distance of two periods with its p-value and shift of the mean, and one level for all."""
    mean = t.events.groupBy("event_type").agg(*(F.avg(F.when(half() == k, C("value"))).alias(f"m{k}") for k in (0, 1)))
    d = S.ks(t.events, "event_type", half(), "value").join(mean, "event_type").withColumn("p", S.ks_p_value(C("ks"), C("n0"), C("n1")))
    drifting = F.count_if(C("p") < 0.05).over(W.partitionBy(F.lit(0)))  # one row per event type
    level = F.when(drifting > 3, "HIGH").when(drifting > 0, "MEDIUM").otherwise("LOW")
    return d.select("event_type", F.round("ks", 8).alias("ks"), F.round("p", 7).alias("p"), F.round(100.0 * (C("m1") / C("m0") - 1), 5).alias("mean_shift_pct"), (C("p") < 0.05).alias("drift"), level.alias("alert_level"))


@query("stat_chi2_p", """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c)
 SELECT round(exp(-sum(pow(coalesce(n, 0) - na * nb / t, 2) / (na * nb / t)) / 2), 8) AS p FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b""")
def stat_chi2_p(t: Tables):
    """Three flags by two states: two degrees of freedom, for which SQL has the closed form."""
    p = F.udf(lambda x, df: None if x is None else float(S.chi2_p_value(x, df)), "double")  # one row
    return S.chi_square(t.lineitem, C("l_returnflag"), C("l_linestatus")).select(F.round(p("chi2", "df"), 8).alias("p"))


@query("stat_p_values")
def stat_p_values(t: Tables):
    """p-values of one-row results, and the interval of a difference of means: pooled and Welch t, one-way F, Pearson and point-biserial correlation."""
    two = S.two_groups(t.events, C("user_id") % 2, C("value"))
    pooled, welch = S.pooled(), S.welch()
    n, r = F.count("value"), F.corr("value", (C("user_id") % 2).cast("double"))
    rq = F.corr("l_quantity", "l_extendedprice")
    student = lambda r, n: r * F.sqrt((n - 2) / (1 - r * r))
    gap = C("m1") - C("m0")
    rows = [
        two.select(F.lit("pooled t").alias("test"), pooled["t"].alias("statistic"), pooled["df"].cast("double").alias("df"), F.lit(None).cast("double").alias("df2"), gap.alias("estimate")),
        two.select(F.lit("welch t"), welch["welch_t"], welch["welch_df"], F.lit(None), gap),
        S.anova(t.events, C("event_type"), C("value")).select(F.lit("one-way F"), "f", C("df1").cast("double"), C("df2").cast("double"), F.lit(None)),
        t.events.agg(n.alias("n"), r.alias("r")).select(F.lit("point-biserial"), student(C("r"), C("n")), (C("n") - 2).cast("double"), F.lit(None), C("r")),
        t.lineitem.agg(F.count("*").alias("n"), rq.alias("r")).select(F.lit("pearson"), student(C("r"), C("n")), (C("n") - 2).cast("double"), F.lit(None), C("r")),
    ]
    d = rows[0]
    for x in rows[1:]:
        d = d.union(x)
    p = F.udf(lambda x, a, b: None if x is None else float(S.t_p_value(x, a) if b is None else S.f_p_value(x, a, b)), "double")  # five rows
    reach = F.udf(lambda test, x, a, e: abs(e / x) * S.t_interval(a) if test.endswith(" t") and x else None, "double")
    half_width = reach("test", "statistic", "df", "estimate")
    return d.withColumn("p", p("statistic", "df", "df2")).withColumn("low", C("estimate") - half_width).withColumn("high", C("estimate") + half_width)


@query("stat_psi", f"""WITH r AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events WHERE {OLD} = 0 GROUP BY 1), c AS (SELECT e.event_type, least(greatest(floor((value - lo) / (hi - lo) * 10), 0), 9) AS bin, count(*) FILTER ({OLD} = 0) AS a, count(*) FILTER ({OLD} = 1) AS b FROM events e JOIN r ON r.event_type = e.event_type GROUP BY 1, 2),
 s AS (SELECT event_type, greatest(a / sum(a) OVER (PARTITION BY event_type), 1e-4) AS p, greatest(b / sum(b) OVER (PARTITION BY event_type), 1e-4) AS q FROM c) SELECT event_type, round(sum((q - p) * ln(q / p)), 7) AS psi FROM s GROUP BY 1""")
def stat_psi(t: Tables):
    return S.psi(t.events, "event_type", half(), C("value")).withColumn("psi", F.round("psi", 7))


@query("stat_drift_z", "SELECT user_id, round((m - b) / s, 6) AS z, CASE WHEN abs((m - b) / s) > 3 THEN 'critical' WHEN abs((m - b) / s) > 2 THEN 'warning' ELSE 'ok' END AS severity FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY 1), (SELECT avg(value) AS b, stddev(value) / 8 AS s FROM events)")
def stat_drift_z(t: Tables):
    base = t.events.agg(F.avg("value").alias("b"), (F.stddev("value") / 8).alias("s"))
    z = (C("m") - C("b")) / C("s")
    return t.events.groupBy("user_id").agg(F.avg("value").alias("m")).crossJoin(F.broadcast(base)).select("user_id", X.rounded(z, 6).alias("z"), F.when(F.abs(z) > 3, "critical").when(F.abs(z) > 2, "warning").otherwise("ok").alias("severity"))


@query("stat_kl", f"WITH c AS (SELECT event_type, count(*) FILTER ({OLD} = 0) AS a, count(*) FILTER ({OLD} = 1) AS b FROM events GROUP BY 1) SELECT round(sum((b / tb) * ln((b / tb) / (a / ta))), 9) AS kl FROM c, (SELECT sum(a) AS ta, sum(b) AS tb FROM c)")
def stat_kl(t: Tables):
    return S.kl(t.events, half(), C("event_type")).select(F.round("kl", 9).alias("kl"))


_IMP = "SELECT user_id % 5 AS i, avg(value) AS estimate, var_samp(value) / count(*) AS variance FROM events GROUP BY 1"


@query("stat_rubin", f"SELECT count(*) AS m, round(avg(estimate), 7) AS pooled, round(avg(variance), 7) AS within, round(var_samp(estimate), 7) AS between_, round(avg(variance) + 1.2 * var_samp(estimate), 7) AS total, round(1.2 * var_samp(estimate) / (avg(variance) + 1.2 * var_samp(estimate)), 7) AS fmi FROM ({_IMP})")
def stat_rubin(t: Tables):
    e = t.events.groupBy((C("user_id") % 5).alias("i")).agg(F.avg("value").alias("estimate"), (F.var_samp("value") / F.count("*")).alias("variance"))
    return S.rubin(e).select("m", *(F.round(c, 7).alias("between_" if c == "between" else c) for c in ("pooled", "within", "between", "total", "fmi")))


@query("impute_hotdeck")
def impute_hotdeck(t: Tables):
    """Five copies of a missing segment, each drawn from the segments of the same nation by a hash of row and copy."""
    d = t.customer.select("c_custkey", "c_nationkey", F.when(C("c_custkey") % 7 != 0, C("c_mktsegment")).alias("segment"))
    share = d.filter("segment is not null").groupBy("c_nationkey", "segment").agg(F.count("*").alias("n"))
    w = W.partitionBy("c_nationkey").orderBy("segment")
    upto = share.select("c_nationkey", C("segment").alias("drawn"), (F.sum("n").over(w) - C("n")).alias("lo"), F.sum("n").over(w).alias("hi"), F.sum("n").over(W.partitionBy("c_nationkey")).alias("total"))
    copies = d.filter("segment is null").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5))))
    draw = F.pmod(F.xxhash64("c_custkey", "copy"), C("total"))
    return copies.join(upto, "c_nationkey").filter((draw >= C("lo")) & (draw < C("hi"))).select("c_custkey", "copy", "drawn")


@query("impute_median", "SELECT event_id, coalesce(v, m) AS value FROM (SELECT event_id, event_type, CASE WHEN user_id % 9 <> 0 THEN value END AS v FROM events) e JOIN (SELECT event_type, median(value) AS m FROM events WHERE user_id % 9 <> 0 GROUP BY 1) k USING (event_type)")
def impute_median(t: Tables):
    d = t.events.select("event_id", "event_type", F.when(C("user_id") % 9 != 0, C("value")).alias("v"))
    return d.join(Q.quantiles(d, ["event_type"], "v", {"m": 0.5}), "event_type").select("event_id", F.coalesce("v", "m").alias("value"))


_LAG = "(SELECT CAST(o_orderdate AS DATE) AS d, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS lag FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate)"


@query("nowcast_triangle", f"""WITH l AS (SELECT lag, count(*) AS n FROM {_LAG} GROUP BY 1), k AS (SELECT lag, sum(n) OVER (ORDER BY lag) / sum(n) OVER () AS share FROM l), r AS (SELECT d, count(*) AS seen FROM {_LAG} GROUP BY 1)
 SELECT d, seen, round(seen / greatest(max(share), 0.01), 5) AS corrected FROM r JOIN k ON k.lag <= date_diff('day', d, DATE '2001-08-02') GROUP BY 1, 2""")
def nowcast_triangle(t: Tables):
    return S.nowcast(_lag_cells(t), "2001-08-02").select("d", "seen", F.round("corrected", 5).alias("corrected"))


def _lag_cells(t: Tables):
    d = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).select(C("o_orderdate").cast("date").alias("d"), F.datediff(C("l_shipdate").cast("date"), C("o_orderdate").cast("date")).alias("lag")).filter("lag >= 0")
    return d.groupBy("d", "lag").agg(F.count("*").alias("n"))


@query("nowcast_interval")
def nowcast_interval(t: Tables):
    """The corrected counts of the days that were not all reported by 1 July 2000, with 95 % bounds; no SQL has the incomplete beta function."""
    as_of = "2000-07-01"
    cells = _lag_cells(t).filter(F.date_add("d", C("lag").cast("int")) <= F.lit(as_of).cast("date"))
    return S.nowcast(cells, as_of).filter("share < 1").select("d", "seen", F.round("share", 6).alias("share"), F.round("corrected", 5).alias("corrected"), F.round("phi", 6).alias("phi"), "low", "high")


_RG = "least(greatest((p * 1.0 / n + 0.98 - 1) / (0.9 + 0.98 - 1), 0.0), 1.0)"


@query("prev_correct", f"SELECT lab, round({_RG}, 7) AS prevalence, round(sum({_RG} * n) OVER () / sum(n) OVER (), 7) AS pooled FROM (SELECT event_type AS lab, count(*) AS n, count(*) FILTER (value < 20) AS p FROM events GROUP BY 1)")
def prev_correct(t: Tables):
    g = t.events.groupBy(C("event_type").alias("lab")).agg(F.count("*").alias("n"), F.count_if(C("value") < 20).alias("p")).withColumn("r", S.rogan_gladen(C("p"), C("n"), 0.9, 0.98))
    w = W.partitionBy(F.lit(0))  # one row per laboratory
    return g.select("lab", F.round("r", 7).alias("prevalence"), F.round(F.sum(C("r") * C("n")).over(w) / F.sum("n").over(w), 7).alias("pooled"))


@query("lab_rates", "SELECT event_type AS lab, round(avg(CASE WHEN value < 35 THEN 1.0 ELSE 0.0 END), 7) AS observed, round(avg(CASE WHEN value < 30 THEN 1.0 ELSE 0.0 END), 7) AS standardised, round(avg(CASE WHEN value < 30 THEN 1.0 ELSE 0.0 END) / avg(CASE WHEN value < 35 THEN 1.0 ELSE 0.0 END), 7) AS factor FROM events GROUP BY 1")
def lab_rates(t: Tables):
    a, b = (F.avg(F.when(C("value") < k, 1.0).otherwise(0.0)) for k in (35, 30))
    return t.events.groupBy(C("event_type").alias("lab")).agg(F.round(a, 7).alias("observed"), F.round(b, 7).alias("standardised"), F.round(b / a, 7).alias("factor"))


@query("cluster_density")
def cluster_density(t: Tables):
    """Iterative; tested against brute force on a small grid."""
    p = t.supplier.select("s_suppkey", (30.0 + C("s_suppkey") * 7 % 50 / 5.0).alias("la"), (-100.0 + C("s_suppkey") * 13 % 60 / 5.0).alias("lo"))
    return S.density_clusters(p, "s_suppkey", "la", "lo", 60.0, 3)


@query("anomaly_global_z", "SELECT event_id, 'value' AS metric, round((value - m) / s, 6) AS z FROM events, (SELECT avg(value) AS m, stddev(value) AS s FROM events) WHERE abs((value - m) / s) > 3 UNION ALL SELECT event_id, 'user_id', round((user_id - m) / s, 6) FROM events, (SELECT avg(user_id) AS m, stddev(user_id) AS s FROM events) WHERE abs((user_id - m) / s) > 3")
def anomaly_global_z(t: Tables):
    cols = ("value", "user_id")
    st = t.events.agg(*(f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev))))
    z = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), ((C(c) - C(f"m_{c}")) / C(f"s_{c}")).alias("z")) for c in cols)))
    return t.events.crossJoin(F.broadcast(st)).select("event_id", z.alias("x")).filter(F.abs("x.z") > 3).select("event_id", "x.metric", F.round("x.z", 6).alias("z"))


# ---------------------------------------------------------------- models


def labelled(t: Tables):
    d = members(t)
    return d.select("member_id", "chronic", "er", "admits", "balance", (C("er") + C("chronic") + C("balance") / 3000 + C("member_id") % 3 >= 6).cast("int").alias("label"), F.pmod(F.crc32(C("member_id").cast("string").cast("binary")), F.lit(10)).alias("fold"))


@query("ml_features", "SELECT c_custkey AS member_id, CAST(c_custkey % 6 >= 3 AS INTEGER) AS high_er, CAST(c_acctbal * 6 >= 25000 AS INTEGER) AS high_cost FROM customer")
def ml_features(t: Tables):
    v = VectorAssembler(inputCols=["chronic", "er", "admits", "balance"], outputCol="features").transform(members(t))
    return v.select("member_id", (C("er") >= 3).cast("int").alias("high_er"), (C("balance") * 6 >= 25000).cast("int").alias("high_cost"))


def _model(t: Tables):
    d = labelled(t)
    steps = [VectorAssembler(inputCols=["chronic", "er", "admits", "balance"], outputCol="x"), StandardScaler(inputCol="x", outputCol="z", withMean=True), LogisticRegression(featuresCol="z", labelCol="label", maxIter=30)]
    return Pipeline(stages=steps).fit(d.filter("fold < 7")), d


@query("ml_score")
def ml_score(t: Tables):
    """Train on seven tenths of the members, score all of them where they are."""
    m, d = _model(t)
    return m.transform(d).select("member_id", vector_to_array("probability")[1].alias("probability"), "prediction")


@query("ml_eval")
def ml_eval(t: Tables):
    m, d = _model(t)
    s = m.transform(d.filter("fold >= 7")).withColumn("p", vector_to_array("probability")[1])
    return S.auc(s, C("label"), C("p")).crossJoin(s.agg(F.avg((C("label") == C("prediction")).cast("double")).alias("accuracy")))


@query("ml_class_report", """WITH d AS (SELECT quality AS y, CAST(n_chars >= 400 AS INTEGER) AS z FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL), c AS (SELECT c, count(*) FILTER (y = c) AS is_, count(*) FILTER (z = c) AS said, count(*) FILTER (y = c AND z = c) AS hit FROM d, (VALUES (0), (1)) v(c) GROUP BY 1),
 m AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(is_, 0), 0) AS r FROM c)
 SELECT round(sum(hit) / sum(is_), 8) AS accuracy, round(sum(p * is_) / sum(is_), 8) AS precision_, round(sum(r * is_) / sum(is_), 8) AS recall, round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * is_) / sum(is_), 8) AS f1 FROM m""")
def ml_class_report(t: Tables):
    """A rule on length against the labels."""
    j = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    r = S.class_report(j, C("quality"), (C("n_chars") >= 400).cast("int"))
    return r.select(*(F.round(c, 8).alias("precision_" if c == "precision" else c) for c in r.columns))


@query("ml_average_precision", "SELECT round(sum(p * hits / (hits + misses)) / sum(p), 8) AS average_precision FROM (SELECT p, sum(p) OVER (ORDER BY s DESC) AS hits, sum(q) OVER (ORDER BY s DESC) AS misses FROM (SELECT n_chars AS s, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS q FROM labels JOIN documents USING (doc_id) GROUP BY 1))")
def ml_average_precision(t: Tables):
    j = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return S.average_precision(j, C("quality"), C("n_chars")).select(F.round("average_precision", 8).alias("average_precision"))


@query("ml_regression_report", "SELECT round(sqrt(avg(e * e)), 3) AS rmse, round(avg(abs(e)), 3) AS mae, round(1 - sum(e * e) / sum((y - m) * (y - m)), 7) AS r2 FROM (SELECT l_extendedprice AS y, m, l_extendedprice - (b * l_quantity + a) AS e FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_extendedprice) AS m FROM lineitem))")
def ml_regression_report(t: Tables):
    """RMSE, MAE and R2 of a line fitted in one pass."""
    fit = t.lineitem.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"), F.regr_intercept("l_extendedprice", "l_quantity").alias("a"), F.avg("l_extendedprice").alias("m"))
    e, y = C("l_extendedprice") - (C("b") * C("l_quantity") + C("a")), C("l_extendedprice")
    return t.lineitem.crossJoin(F.broadcast(fit)).agg(F.round(F.sqrt(F.avg(e * e)), 3).alias("rmse"), F.round(F.avg(F.abs(e)), 3).alias("mae"), F.round(1 - F.sum(e * e) / F.sum((y - C("m")) * (y - C("m"))), 7).alias("r2"))


@query("ml_train")
def ml_train(t: Tables):
    """A forest and boosted trees on seven tenths of the members, judged on the others; boosted regression by its RMSE."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.regression import GBTRegressor

    d = VectorAssembler(inputCols=["chronic", "er", "admits", "balance"], outputCol="x").transform(labelled(t)).withColumn("cost", 1000.0 * C("er") + 500.0 * C("chronic"))
    train, held = d.filter("fold < 7"), d.filter("fold >= 7")
    out = None
    for name, m in (("forest", RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=20, maxDepth=5, seed=1)), ("boosted", GBTClassifier(featuresCol="x", labelCol="label", maxIter=8, maxDepth=4, seed=1))):
        s = m.fit(train).transform(held).withColumn("p", vector_to_array("probability")[1])
        row = S.auc(s, C("label"), C("p")).crossJoin(S.class_report(s, C("label"), C("prediction").cast("int")))
        row = row.select(F.lit(name).alias("model"), "auc", "accuracy", "f1", F.lit(None).cast("double").alias("rmse"))
        out = row if out is None else out.unionByName(row)
    r = GBTRegressor(featuresCol="x", labelCol="cost", maxIter=8, maxDepth=4, seed=1).fit(train).transform(held)
    rmse = F.sqrt(F.avg((C("prediction") - C("cost")) * (C("prediction") - C("cost"))))
    return out.unionByName(r.agg(rmse.alias("rmse")).withColumn("model", F.lit("boosted regression")), allowMissingColumns=True)


_AUC = "SELECT {k}sum(p * (below + q / 2.0)) / (sum(p) * sum(q)) AS auc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY {g} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {g0} n_chars AS s, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS q FROM labels JOIN documents USING (doc_id) GROUP BY ALL))"


@query("ml_subgroup_auc", "SELECT lang, CAST(sum(p) AS BIGINT) AS n1, CAST(sum(q) AS BIGINT) AS n0, round(sum(p * (below + q / 2.0)) / (sum(p) * sum(q)), 8) AS auc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY lang ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT lang, n_chars AS s, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS q FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)) GROUP BY 1 HAVING sum(p) + sum(q) >= 10")
def ml_subgroup_auc(t: Tables):
    j = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    return S.auc(j, C("quality"), C("n_chars"), ["lang"]).filter("n0 + n1 >= 10").withColumn("auc", F.round("auc", 8))


@query("ml_monitor", "SELECT CAST(ts AS DATE) AS d, round(avg(value), 6) AS score, coalesce(avg(value) < 0.9 * lag(avg(value)) OVER (ORDER BY CAST(ts AS DATE)), false) AS alert FROM events GROUP BY 1")
def ml_monitor(t: Tables):
    d = t.events.groupBy(C("ts").cast("date").alias("d")).agg(F.avg("value").alias("s"))
    before = F.lag("s").over(W.partitionBy(F.lit(0)).orderBy("d"))  # one row per day
    return d.select("d", F.round("s", 6).alias("score"), F.coalesce(C("s") < 0.9 * before, F.lit(False)).alias("alert"))


@query("ml_split")
def ml_split(t: Tables):
    """A stratified 70/15/15 split by a hash of the key: the same rows always land in the same part."""
    u = F.pmod(F.xxhash64("doc_id", F.lit("split")), F.lit(100))
    return t.labels.select("doc_id", "quality", F.when(u < 70, "train").when(u < 85, "validation").otherwise("test").alias("part"))
