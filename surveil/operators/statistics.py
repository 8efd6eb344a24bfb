"""Statistics from sums that Spark aggregates; what remains for Python are formulas on a handful of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._helpers import cut
from .windows import totals_below


def moments(df: DataFrame, group: Column, value: Column) -> DataFrame:
    return df.groupBy(group.alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))


def two_groups(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """One row: n, mean and variance of groups 0 and 1."""
    of = lambda f, k: f(F.when(group == k, value))
    return df.agg(*(of(f, k).alias(f"{n}{k}") for k in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))


def welch() -> dict[str, Column]:
    a, b = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    t = (F.col("m1") - F.col("m0")) / F.sqrt(a + b)
    return {"welch_t": t, "welch_df": F.pow(a + b, 2) / (F.pow(a, 2) / (F.col("n0") - 1) + F.pow(b, 2) / (F.col("n1") - 1))}


def pooled() -> dict[str, Column]:
    df = F.col("n0") + F.col("n1") - 2
    s2 = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / df
    return {"t": (F.col("m1") - F.col("m0")) / F.sqrt(s2 * (1 / F.col("n0") + 1 / F.col("n1"))), "df": df, "cohens_d": (F.col("m1") - F.col("m0")) / F.sqrt(s2)}


def anova(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """One row: F and its degrees of freedom."""
    g = moments(df, group, value).filter("n > 0")
    s = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum(F.col("v") * (F.col("n") - 1)).alias("within"))
    between = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n")
    return s.select((between / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))


def chi_square(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: Pearson's statistic of the two-way table and its degrees of freedom. Counts are multiplied as doubles and decimals, since their products pass 64 bits."""
    cell = df.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))
    ra, rb = cell.groupBy("a").agg(F.sum("n").alias("na")), cell.groupBy("b").agg(F.sum("n").alias("nb"))
    total = cell.agg(F.sum("n").alias("t"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    expected = F.col("na").cast("double") * F.col("nb") / F.col("t")
    full = cell.join(ra, "a").join(rb, "b").crossJoin(F.broadcast(total)).withColumn("e", expected)
    # cells without rows add what is expected of them: the total less what is expected of the others, in whole numbers, without listing them
    listed = F.sum((whole("na") * whole("nb")).cast("decimal(38,0)"))
    s = full.agg(F.sum(F.pow(F.col("n") - F.col("e"), 2) / F.col("e")).alias("s"), F.first("t").alias("t"), listed.alias("listed"))
    sides = ra.agg((F.countDistinct("a") - 1).alias("da")).crossJoin(rb.agg((F.countDistinct("b") - 1).alias("db")))  # one row each
    empty = ((whole("t") * whole("t")).cast("decimal(38,0)") - F.col("listed")).cast("double") / F.col("t")
    return s.crossJoin(sides).select((F.col("s") + empty).alias("chi2"), (F.col("da") * F.col("db")).alias("df"))


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction; p-values of one-row results."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def average_precision(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """One row: the mean precision at each positive, from the highest score down; tied scores are taken together."""
    at = df.groupBy((-score).alias("_s")).agg(F.count_if(label == 1).alias("p"), F.count_if(label == 0).alias("q"))
    hits = F.col("below_p") + F.col("p")
    return totals_below(at, [], "_s", ["p", "q"]).agg((F.sum(F.col("p") * hits / (hits + F.col("below_q") + F.col("q"))) / F.sum("p")).alias("average_precision"))


def class_report(df: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """One row: accuracy, and precision, recall and F1 weighted by how often each class occurs."""
    cell = df.filter(label.isNotNull() & predicted.isNotNull()).groupBy(label.alias("y"), predicted.alias("z")).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("real")), F.struct(F.col("z").alias("c"), F.lit(0).alias("real"))))
    of = cell.select("y", "z", "n", sides.alias("x")).groupBy("x.c").agg(F.sum(F.when(F.col("x.real") == 1, F.col("n")).otherwise(0)).alias("is"), F.sum(F.when(F.col("x.real") == 0, F.col("n")).otherwise(0)).alias("said"), F.sum(F.when((F.col("x.real") == 1) & (F.col("y") == F.col("z")), F.col("n")).otherwise(0)).alias("hit"))
    p, r = (F.coalesce(F.try_divide(F.col("hit"), F.col(c)), F.lit(0.0)) for c in ("said", "is"))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    mean = lambda x: F.sum(x * F.col("is")) / F.sum("is")
    return of.agg((F.sum("hit") / F.sum("is")).alias("accuracy"), mean(p).alias("precision"), mean(r).alias("recall"), mean(f1).alias("f1"))


def chi2_p_value(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution: the finite sums for even and odd degrees of freedom."""
    h = x / 2
    if df % 2 == 0:
        return math.exp(-h) * sum(math.exp(k * math.log(h) - math.lgamma(k + 1)) if h else float(k == 0) for k in range(df // 2))
    return math.erfc(math.sqrt(h)) + (math.exp(-h) * sum(math.exp((k - 0.5) * math.log(h) - math.lgamma(k + 0.5)) for k in range(1, df // 2 + 1)) if h else 0.0)


def t_interval(df: float, level: float = 0.95) -> float:
    """The t value that the given share lies within, by halving."""
    low, high = 0.0, 1.0
    while t_p_value(high, df) > 1 - level:
        high *= 2
    for _ in range(100):
        low, high = ((low + high) / 2, high) if t_p_value((low + high) / 2, df) > 1 - level else (low, (low + high) / 2)
    return high


def t_p_value(t: float, df: float) -> float:
    return beta_tail(df / (df + t * t), df / 2, 0.5)


def f_p_value(f: float, df1: float, df2: float) -> float:
    return beta_tail(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


def ks(df: DataFrame, by: str, sample: Column, value: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of samples 0 and 1 for each `by`; ties are stepped together."""
    at = totals_below(df.groupBy(by, value).agg(F.count_if(sample == 0).alias("a"), F.count_if(sample == 1).alias("b")), [by], value, ["a", "b"])
    n = at.groupBy(by).agg(F.sum("a").alias("n0"), F.sum("b").alias("n1"))
    gap = F.abs((F.col("below_a") + F.col("a")) / F.col("n0") - (F.col("below_b") + F.col("b")) / F.col("n1"))
    return at.join(n, by).groupBy(by).agg(F.max(gap).alias("ks"), F.first("n0").alias("n0"), F.first("n1").alias("n1"))


def ks_p_value(distance: Column, n0: Column, n1: Column, terms: int = 100) -> Column:
    """The asymptotic p-value of a two-sample distance, by the alternating series of Kolmogorov's distribution."""
    root = F.sqrt(n0 * n1 / (n0 + n1))
    x = (root + 0.12 + 0.11 / root) * distance
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def psi(df: DataFrame, by: str, sample: Column, value: Column, bins: int = 10) -> DataFrame:
    """Population stability index of sample 1 against sample 0 over equal bins of sample 0's range."""
    rng = df.filter(sample == 0).groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.least(F.greatest(F.floor((value - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(0)), F.lit(bins - 1))
    cell = df.join(rng, by).groupBy(by, b.alias("bin")).agg(F.count_if(sample == 0).alias("a"), F.count_if(sample == 1).alias("b"))
    total = Window.partitionBy(by)
    p, q = (F.greatest(F.col(c) / F.sum(c).over(total), F.lit(1e-4)) for c in "ab")
    return cell.select(by, ((q - p) * F.log(q / p)).alias("x")).groupBy(by).agg(F.sum("x").alias("psi"))


def auc(df: DataFrame, label: Column, score: Column, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums over distinct scores, ties counting half; scores are dealt by ranges."""
    keys = by or []
    at = totals_below(df.groupBy(*keys, score.alias("_s")).agg(F.count_if(label == 1).alias("p"), F.count_if(label == 0).alias("q")), keys, "_s", ["q"])
    return at.select(*keys, "p", "q", (F.col("p") * (F.col("below_q") + F.col("q") / 2.0)).alias("u")).groupBy(*keys).agg(F.sum("p").alias("n1"), F.sum("q").alias("n0"), (F.sum("u") / (F.sum("p") * F.sum("q"))).alias("auc"))


def kl(df: DataFrame, sample: Column, category: Column) -> DataFrame:
    """Kullback-Leibler divergence of the category shares of sample 1 from those of sample 0."""
    cell = df.groupBy(category.alias("c")).agg(F.count_if(sample == 0).alias("a"), F.count_if(sample == 1).alias("b"))
    t = cell.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.col("b") / F.col("tb"), F.greatest(F.col("a") / F.col("ta"), F.lit(1e-10))
    return cell.crossJoin(F.broadcast(t)).agg(F.sum(F.when(p > 0, p * F.log(p / q)).otherwise(0.0)).alias("kl"))


def rubin(estimates: DataFrame) -> DataFrame:
    """Pool (estimate, variance) of m imputations: estimate, within, between, total variance, fraction of missing information."""
    s = estimates.agg(F.count("*").alias("m"), F.avg("estimate").alias("pooled"), F.avg("variance").alias("within"), F.var_samp("estimate").alias("between"))
    total = F.col("within") + (1 + 1 / F.col("m")) * F.col("between")
    return s.withColumn("total", total).withColumn("fmi", (1 + 1 / F.col("m")) * F.col("between") / F.col("total"))


def rogan_gladen(positive: Column, n: Column, sensitivity: float, specificity: float) -> Column:
    """True prevalence from an imperfect test, within 0 and 1."""
    return F.least(F.greatest((positive / n + specificity - 1) / (sensitivity + specificity - 1), F.lit(0.0)), F.lit(1.0))


def logit_by_cluster(d: DataFrame, y: str, terms: list[str], cluster: str) -> DataFrame:
    """Logistic regression of y (0 or 1) on any number of terms: one row for each, and the intercept, with an error robust to clusters, z and p.

    Scores are summed for each cluster where its rows are; of them and of the information only sums of products, (terms + 1)^2 numbers, reach the
    driver. Errors carry the usual factor clusters / (clusters - 1).
    """
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=terms, outputCol="_v").transform(d.filter(F.col(y).isNotNull()).withColumn("_y", F.col(y).cast("double")).select("_y", cluster, *(F.col(t).cast("double").alias(t) for t in terms)).dropna())
    m = LogisticRegression(featuresCol="_v", labelCol="_y", maxIter=200, tol=1e-12, standardization=False).fit(v)
    beta = [float(m.intercept), *(float(b) for b in m.coefficients)]
    names = ["intercept", *terms]
    x = [F.lit(1.0), *(F.col(t) for t in terms)]
    k = range(len(x))
    p = 1 / (1 + F.exp(-sum((F.lit(b) * c for b, c in zip(beta, x)), F.lit(0.0))))
    one = v.withColumn("_p", p).agg(*(F.sum(F.col("_p") * (1 - F.col("_p")) * x[i] * x[j]).alias(f"b{i}_{j}") for i in k for j in k)).first()
    u = v.withColumn("_p", p).groupBy(cluster).agg(*(F.sum((F.col("_y") - F.col("_p")) * x[i]).alias(f"u{i}") for i in k))
    two = u.agg(*(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in k for j in k), F.count("*").alias("n")).first()
    bread, meat = (np.array([[r[f"{c}{i}_{j}"] for j in k] for i in k]) for r, c in ((one, "b"), (two, "m")))
    inverse = np.linalg.inv(bread)
    se = np.sqrt(np.diag(inverse @ meat @ inverse) * two.n / max(two.n - 1, 1))
    rows = [(t, b, math.exp(b), float(e), b / float(e), math.erfc(abs(b / float(e)) / math.sqrt(2)), two.n) for t, b, e in zip(names, beta, se)]
    return d.sparkSession.createDataFrame(rows, "term string, log_odds double, odds_ratio double, robust_se double, z double, p double, clusters long")


# ---------------------------------------------------------------- interrupted series


def _segments(d: DataFrame, time: str, y: str, at: float) -> DataFrame:
    """d with its two lines (before `at`, and from then on), what each says of the row, and the error."""
    t = F.col(time)
    half = [F.when(t < at, F.col(y)), F.when(t >= at, F.col(y))]
    of = {"b": F.regr_slope, "a": F.regr_intercept, "n": F.regr_count, "m": F.regr_avgx, "s": F.regr_sxx}
    lines = d.agg(*(f(half[k], t).alias(f"_{c}{k}") for k in (0, 1) for c, f in of.items()))
    line = [F.col(f"_a{k}") + F.col(f"_b{k}") * t for k in (0, 1)]
    fitted = F.when(t < at, line[0]).otherwise(line[1])
    return d.crossJoin(F.broadcast(lines)).withColumn("_without", line[0]).withColumn("_fitted", fitted).withColumn("_e", F.col(y) - fitted)


def counterfactual(d: DataFrame, time: str, y: str, at: float) -> DataFrame:
    """Each row with what the two lines say, and what the first one says as if nothing had happened, with the difference of both (0 before)."""
    effect = F.when(F.col(time) >= at, F.col("_fitted") - F.col("_without")).otherwise(0.0)
    return _segments(d, time, y, at).select(*d.columns, F.col("_fitted").alias("fitted"), F.col("_without").alias("counterfactual"), effect.alias("effect"))


def interrupted(d: DataFrame, time: str, y: str, at: float, lags: int) -> DataFrame:
    """One row: level and slope before, their changes at `at`, each with an error that allows for autocorrelation up to `lags` rows, and Durbin-Watson.

    y = intercept + slope * time + level_change * (time >= at) + slope_change * (time - at if time >= at). Errors are Newey-West's: products of
    each row's pull on a coefficient with those of the rows before, weighted by 1 - lag / (lags + 1). d has one row for each time, such as a day.
    """
    t = F.col(time)
    before = t < at
    pull = lambda k: (t - F.col(f"_m{k}")) / F.col(f"_s{k}")
    stand = lambda k: 1 / F.col(f"_n{k}") + (at - F.col(f"_m{k}")) * pull(k)  # noqa: E731  of line k at `at`
    pulls = {
        "intercept": F.when(before, 1 / F.col("_n0") - F.col("_m0") * pull(0)).otherwise(0.0),
        "slope": F.when(before, pull(0)).otherwise(0.0),
        "level_change": F.when(before, -stand(0)).otherwise(stand(1)),
        "slope_change": F.when(before, -pull(0)).otherwise(pull(1)),
    }
    order = Window.partitionBy(F.lit(0)).orderBy(time)  # one row for each time
    d = _segments(d, time, y, at).withColumns({f"_g_{c}": p * F.col("_e") for c, p in pulls.items()})
    d = d.withColumns({f"_p_{c}": F.col(f"_g_{c}") * F.col(f"_g_{c}") + sum((2 * (1 - k / (lags + 1)) * F.col(f"_g_{c}") * F.coalesce(F.lag(f"_g_{c}", k).over(order), F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0)) for c in pulls})
    d = d.withColumn("_gap", F.col("_e") - F.lag("_e").over(order))
    first = lambda c: F.first(c)
    value = {"intercept": first("_a0"), "slope": first("_b0"), "level_change": first(F.col("_a1") + F.col("_b1") * at - F.col("_a0") - F.col("_b0") * at), "slope_change": first(F.col("_b1") - F.col("_b0"))}
    errors = [F.sqrt(F.greatest(F.sum(f"_p_{c}"), F.lit(0.0))).alias(f"{c}_se") for c in pulls]
    return d.agg(F.count("*").alias("days"), *(v.alias(c) for c, v in value.items()), *errors, (F.sum(F.col("_gap") * F.col("_gap")) / F.sum(F.col("_e") * F.col("_e"))).alias("durbin_watson"))


# ---------------------------------------------------------------- counts that are not all reported yet


def negative_binomial_quantile(q: float, mean: float, variance: float) -> int:
    """The least count up to which a negative binomial of that mean and variance has the share q. No more than the mean varies: as Poisson."""
    if mean <= 0:
        return 0
    size = mean * mean / max(variance - mean, 1e-7 * mean)
    share = size / (size + mean)
    upto = lambda x: beta_tail(share, size, x + 1.0)
    high = 1
    while upto(high) < q:
        high *= 2
    low = -1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if upto(mid) >= q else (mid, high)
    return high


def nowcast(cells: DataFrame, as_of: str, level: float = 0.95, least: float = 0.01) -> DataFrame:
    """cells: d, lag (days), n (reports of day d that came after so many days). For each day: seen, share (of its reports that are in by as_of),
    corrected, phi, low and high.

    The shares are those of all reports by lag. What is missing of a day is negative binomial with mean seen * (1 - share) / share and variance
    phi * mean / share, where phi (1 at least) is how much more the cells vary than the shares say: Pearson's sum over all cells, empty ones too.
    """
    from .joins import asof_join

    one = Window.partitionBy(F.lit(0)).orderBy("lag")  # one row for each lag in days
    by_lag = cells.groupBy("lag").agg(F.sum("n").alias("_n"))
    curve = cut(by_lag.select("lag", F.sum("_n").over(one).alias("_upto"), "_n", F.row_number().over(one).alias("_rank"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all")).select("lag", (F.col("_upto") / F.col("_all")).alias("share"), (F.col("_n") / F.col("_all")).alias("_part"), "_rank", F.lit(0).alias("_one")))
    seen = cells.groupBy("d").agg(F.sum("n").alias("seen")).withColumn("_age", F.datediff(F.lit(as_of).cast("date"), F.col("d"))).withColumn("_one", F.lit(0))
    at = cut(asof_join(seen, curve, ["_one"], "_age", "lag", ["share", "_rank"]).filter("share is not null").withColumn("corrected", F.col("seen") / F.greatest("share", F.lit(least))))
    expected = F.col("corrected") * F.col("_part")
    fit = cells.join(at.select("d", "corrected", "_age"), "d").filter("lag <= _age").join(F.broadcast(curve.select("lag", "_part")), "lag")
    sums = fit.agg(F.sum(F.col("n") * F.col("n") / expected).alias("_s"), F.sum("n").alias("_t")).crossJoin(at.agg(F.sum("_rank").alias("_cells"), F.count("*").alias("_days"))).crossJoin(curve.agg(F.count("*").alias("_lags")))
    free = F.greatest(F.col("_cells") - F.col("_days") - F.col("_lags") + 1, F.lit(1))
    phi = sums.select(F.greatest((F.col("_s") - F.col("_t")) / free, F.lit(1.0)).alias("phi"))
    d = at.crossJoin(F.broadcast(phi))
    share = F.greatest("share", F.lit(least))
    mean = F.col("seen") * (1 - share) / share
    reach = F.udf(lambda m, v: None if m is None else (negative_binomial_quantile((1 - level) / 2, m, v), negative_binomial_quantile((1 + level) / 2, m, v)), "struct<low:long,high:long>")  # one row for each day
    d = d.withColumn("_r", reach(mean, F.col("phi") * mean / share))
    return d.select("d", "seen", "share", "corrected", "phi", (F.col("seen") + F.col("_r.low")).alias("low"), (F.col("seen") + F.col("_r.high")).alias("high"))


# ---------------------------------------------------------------- clusters by density

_KM = math.pi * 6371.0 / 180  # of a degree of latitude


def density_clusters(points: DataFrame, key: str, lat: str, lon: str, radius_km: float, min_points: int) -> DataFrame:
    """Clusters by density: (key, cluster) of core points and of their neighbours; the cluster is its least core key, a neighbour's the least around.

    Cells are so small that all points of a cell are neighbours: a cell of min_points is core without a comparison, and the core points of a cell are
    one cluster. Only points of other cells are compared, with the cells around. Two core cells are told to be near, or not, by the boxes around their
    points, cut into 8 by 8; only boxes that leave it open are looked into. Distances across the 180th meridian are not seen.
    """
    from ..functions.clinical import haversine_km

    h = radius_km / 2 / _KM
    edge = lambda i, far: F.radians(F.least(F.greatest(F.abs(i * h), F.abs((i + 1) * h)) if far else F.when((i >= 0) | (i + 1 <= -0), F.least(F.abs(i * h), F.abs((i + 1) * h))).otherwise(0.0), F.lit(90.0)))
    width = lambda i: F.least(h / F.greatest(F.cos(edge(i, False)), F.lit(1e-9)), F.lit(360.0))
    row = F.floor(F.col(lat) / h)
    p = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(key).alias("id"), F.col(lat).cast("double").alias("la"), F.col(lon).cast("double").alias("lo"), row.alias("i"))
    p = cut(p.withColumn("j", F.floor(F.col("lo") / width(F.col("i")))))
    cells = cut(p.groupBy("i", "j").agg(F.count("*").alias("n")))

    # cells within reach of each cell: three rows up and down, and so many columns as the radius spans there
    r = cells.select("i", "j", F.explode(F.array(*(F.col("i") + k for k in range(-3, 4)))).alias("i2"))
    cos = F.greatest(F.least(F.cos(edge(F.col("i"), True)), F.cos(edge(F.col("i2"), True))), F.lit(1e-9))
    span = F.degrees(2 * F.asin(F.least(F.lit(1.0), math.sin(radius_km / 2 / 6371.0) / cos))) + 1e-9
    west, east = F.col("j") * width(F.col("i")) - span, (F.col("j") + 1) * width(F.col("i")) + span
    reach = r.withColumn("j2", F.explode(F.sequence(F.floor(west / width(F.col("i2"))), F.floor(east / width(F.col("i2"))))))
    around = cut(reach.join(cells.select(F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("n").alias("n2")), ["i2", "j2"]))

    # points of cells that are not full, against the cells around
    few = p.join(cells.filter(F.col("n") < min_points), ["i", "j"])
    other = p.select(F.col("id").alias("id2"), F.col("la").alias("la2"), F.col("lo").alias("lo2"), F.col("i").alias("i2"), F.col("j").alias("j2"))
    near = haversine_km(F.col("la"), F.col("lo"), F.col("la2"), F.col("lo2")) <= radius_km
    lone = few.join(around.drop("n2"), ["i", "j"]).join(other, ["i2", "j2"]).filter(near).groupBy("id").agg(F.count("*").alias("m")).filter(F.col("m") >= min_points).select("id")
    full = p.join(cells.filter(F.col("n") >= min_points).select("i", "j"), ["i", "j"]).select("id", "la", "lo", "i", "j")
    core = cut(full.unionByName(p.join(lone, "id").select("id", "la", "lo", "i", "j")))

    # boxes of core points; which pairs of cells they show to be near
    sub = core.withColumn("s", (F.floor((F.col("la") / h - F.col("i")) * 8) * 8 + F.floor((F.col("lo") / width(F.col("i")) - F.col("j")) * 8)).cast("int"))
    box = sub.groupBy("i", "j", "s").agg(*(f(c).alias(f"{c}_{n}") for c in ("la", "lo") for n, f in (("lo", F.min), ("hi", F.max))))
    node = core.groupBy("i", "j").agg(F.min("id").alias("least"))
    sides = [box.select(*(F.col(c).alias(f"{c}{k}") for c in box.columns)) for k in ("", "_b")]
    pairs = around.select("i", "j", F.col("i2").alias("i_b"), F.col("j2").alias("j_b")).filter("i < i_b or (i = i_b and j < j_b)")
    both = pairs.join(sides[0], ["i", "j"]).join(sides[1], ["i_b", "j_b"])
    far = lambda c: F.greatest(F.col(f"{c}_hi") - F.col(f"{c}_lo_b"), F.col(f"{c}_hi_b") - F.col(f"{c}_lo"))
    gap = lambda c: F.greatest(F.col(f"{c}_lo") - F.col(f"{c}_hi_b"), F.col(f"{c}_lo_b") - F.col(f"{c}_hi"), F.lit(0.0))
    flat = [F.when(F.col(f"la_lo{k}") * F.col(f"la_hi{k}") <= 0, 0.0).otherwise(F.least(F.abs(f"la_lo{k}"), F.abs(f"la_hi{k}"))) for k in ("", "_b")]
    steep = [F.greatest(F.abs(f"la_lo{k}"), F.abs(f"la_hi{k}")) for k in ("", "_b")]
    sin2 = lambda x: F.pow(F.sin(F.radians(x) / 2), 2)
    span2 = lambda la, lo, at: 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), sin2(la) + F.cos(F.radians(at[0])) * F.cos(F.radians(at[1])) * sin2(lo))))
    most, least = span2(far("la"), far("lo"), flat), span2(gap("la"), gap("lo"), steep)
    told = cut(both.select("i", "j", "i_b", "j_b", "s", "s_b", (most <= radius_km).alias("near"), (least > radius_km + 1e-9).alias("apart")))
    joined = told.filter("near").select("i", "j", "i_b", "j_b").distinct()
    open_ = told.filter("not near and not apart").join(joined, ["i", "j", "i_b", "j_b"], "left_anti")
    # places instead of points: repeated ones are looked at once
    place = sub.select("i", "j", "s", "la", "lo").distinct()
    inside = open_.join(place, ["i", "j", "s"]).join(place.select(*(F.col(c).alias(f"{c}2" if c in ("la", "lo") else f"{c}_b") for c in place.columns)), ["i_b", "j_b", "s_b"])
    edges = cut(joined.unionByName(inside.filter(near).select("i", "j", "i_b", "j_b").distinct()))

    names = node.select("i", "j", F.col("least").alias("u"))
    e = edges.join(names, ["i", "j"]).join(names.select(F.col("i").alias("i_b"), F.col("j").alias("j_b"), F.col("u").alias("v")), ["i_b", "j_b"]).select("u", "v")
    inner = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).unionByName(names.select("u", F.col("u").alias("v"))))
    label = cut(names.select(F.col("u").alias("id"), F.col("u").alias("cluster")))
    while True:  # each round takes the least label around, and the label of that label
        low = inner.join(label, F.col("v") == F.col("id")).groupBy("u").agg(F.min("cluster").alias("low"))
        jump = label.withColumnRenamed("cluster", "up").withColumnRenamed("id", "low")
        new = cut(low.join(jump, "low").select(F.col("u").alias("id"), F.least("low", "up").alias("cluster")))
        moved = new.join(label.withColumnRenamed("cluster", "was"), "id").filter("cluster <> was").limit(1).count()
        label = new
        if not moved:
            break
    cell_label = names.join(label, F.col("u") == F.col("id")).select("i", "j", "cluster")
    mine = core.join(cell_label, ["i", "j"]).select("id", "cluster")
    fringe = few.join(core.select("id"), "id", "left_anti").join(around.drop("n2"), ["i", "j"])
    held = core.join(cell_label, ["i", "j"]).select(F.col("la").alias("la2"), F.col("lo").alias("lo2"), F.col("i").alias("i2"), F.col("j").alias("j2"), "cluster")
    border = fringe.join(held, ["i2", "j2"]).filter(near).groupBy("id").agg(F.min("cluster").alias("cluster"))
    return mine.unionByName(border).select(F.col("id").alias(key), "cluster")
