"""Column expressions for claims, laboratory and facility data. All take and return columns; no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- text to values


def norm(c: Column) -> Column:
    return F.upper(F.trim(c))


def parse_number(c: Column) -> Column:
    """A number if the text is one, else null."""
    return F.when(F.trim(c).rlike(r"^\d+\.?\d*$"), F.trim(c).try_cast("double"))


def strip_non_numeric(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9.]", "")


def zip5(c: Column) -> Column:
    """The first five digits of a five- or nine-digit code, else null."""
    return F.when(c.rlike(r"^\d{5}(-?\d{4})?$"), F.left(c, F.lit(5)))


def rounded(c: Column | str, digits: int) -> Column:
    """c to so many digits; as in SQL a negative number that comes to zero keeps its sign, which Spark's own rounding, by way of decimals, loses."""
    c = F.col(c) if isinstance(c, str) else c
    r = F.round(c, digits)
    return F.when((r == 0) & (c < 0), F.lit(-0.0)).otherwise(r)


def npi(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{10}$"), c)


def gender(c: Column) -> Column:
    u = norm(c)
    return F.when(u.isin("M", "MALE", "1"), "M").when(u.isin("F", "FEMALE", "2"), "F").otherwise("U")


def race(c: Column) -> Column:
    u = F.upper(c)
    return F.when(u.like("%WHITE%"), "White").when(u.like("%BLACK%") | u.like("%AFRICAN%"), "Black or African American").when(u.like("%ASIAN%"), "Asian").when(u.like("%NATIVE HAWAIIAN%") | u.like("%PACIFIC%"), "Pacific Islander").when(u.like("%INDIAN%") | u.like("%NATIVE%"), "American Indian or Alaska Native").otherwise("Unknown")


def ethnicity(c: Column) -> Column:
    """The negative form is tested first, so that it isn't taken for the positive one."""
    u = F.upper(c)
    return F.when(u.like("%NOT HISPANIC%") | u.like("%NON-HISPANIC%"), "Not Hispanic").when(u.like("%HISPANIC%") | u.like("%LATINO%"), "Hispanic").otherwise("Unknown")


# ---------------------------------------------------------------- ages and dates


def age_365(birth: Column, at: Column) -> Column:
    return F.floor(F.datediff(at, birth) / 365.25).cast("int")


def age_exact(birth: Column, at: Column) -> Column:
    return F.floor(F.months_between(at, birth) / 12).cast("int")


def age_boundary(birth: Column, at: Column) -> Column:
    return F.year(at) - F.year(birth)


def ladder(c: Column, steps: list[tuple[float, object]], default: object, op: str = "<") -> Column:
    """The label of the first step that holds: c < limit, or with op '>=' c >= limit and so on."""
    test = {"<": lambda x: c < x, "<=": lambda x: c <= x, ">=": lambda x: c >= x, ">": lambda x: c > x}[op]
    out = None
    for limit, label in steps:
        out = F.when(test(limit), F.lit(label)) if out is None else out.when(test(limit), F.lit(label))
    return out.otherwise(F.lit(default))


def age_group4(age: Column) -> Column:
    return ladder(age, [(18, "0-17"), (45, "18-44"), (65, "45-64")], "65+")


def age_group6(age: Column) -> Column:
    return F.when(age.isNull(), "Unknown").otherwise(ladder(age, [(18, "0-17"), (30, "18-29"), (40, "30-39"), (50, "40-49"), (65, "50-64")], "65+"))


def epi_week(d: Column) -> Column:
    """The Saturday that ends the Sunday-to-Saturday week."""
    return F.date_add(d, F.pmod(7 - F.dayofweek(d), F.lit(7)))


def mmwr_year(d: Column) -> Column:
    return F.year(F.date_sub(epi_week(d), 3))


def mmwr_week(d: Column) -> Column:
    wednesday = F.date_sub(epi_week(d), 3)
    return (F.floor((F.dayofyear(wednesday) - 1) / 7) + 1).cast("int")


def week_start(d: Column) -> Column:
    return F.date_sub(d, F.dayofweek(d) - 1)


def swap_dates(a: Column, b: Column) -> tuple[Column, Column]:
    """The pair in order; a missing end stays missing."""
    return F.when(b.isNull(), a).otherwise(F.least(a, b)), F.when(b.isNotNull(), F.greatest(a, b))


def turnaround_band(hours: Column) -> Column:
    return ladder(hours, [(24, "Same Day (<24h)"), (48, "1-2 Days"), (72, "2-3 Days"), (120, "3-5 Days")], ">5 Days", "<=")


# ---------------------------------------------------------------- rows


def null_outside(c: Column, low: float | None = None, high: float | None = None) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (c >= low)
    if high is not None:
        ok = ok & (c <= high)
    return F.when(ok, c)


def completeness(*cols: Column) -> Column:
    """Share of the columns that are not null."""
    return sum((c.isNotNull().cast("int") for c in cols), F.lit(0)) / len(cols)


def surrogate_key(*cols: Column) -> Column:
    return F.md5(F.concat_ws("-", *(F.coalesce(c.cast("string"), F.lit("_null_")) for c in cols)))


def salted_hash(c: Column, salt: str = "_salt") -> Column:
    return F.sha2(F.concat(c.cast("string"), F.lit(salt)), 256)


def salt_key(key: Column, row: Column, n: int) -> Column:
    """The key with one of n suffixes, by a hash of what tells the rows of a key apart."""
    return F.concat_ws("_", key.cast("string"), F.pmod(F.xxhash64(row), F.lit(n)).cast("string"))


# ---------------------------------------------------------------- laboratory


def pcr_result(cts: list[Column], cutoffs: list[float], min_targets: int = 2, inconclusive: float = 35) -> Column:
    """Detected if enough targets are below their cutoffs; one weak target is inconclusive."""
    hits = sum((F.when(c <= k, 1).otherwise(0) for c, k in zip(cts, cutoffs)), F.lit(0))
    least = F.least(*(F.coalesce(c, F.lit(999.0)) for c in cts))
    return F.when(hits >= min_targets, "Detected").when((hits == 1) & (least > inconclusive), "Inconclusive").otherwise("Not Detected")


def s_gene_failure(n: Column, orf: Column, s: Column, threshold: float = 30) -> Column:
    return F.coalesce((s.isNull() | (s > threshold)) & (n < threshold) & (orf < threshold), F.lit(False))


#: Lineage prefixes of the named variants.
VARIANTS = {
    "Alpha": ["B.1.1.7", "Q."],
    "Beta": ["B.1.351"],
    "Gamma": ["P.1"],
    "Delta": ["B.1.617.2", "AY."],
    "Omicron": ["B.1.1.529", "BA.", "BE.", "BF.", "BQ.", "XBB", "JN."],
}


def variant(lineage: Column, given: Column | None = None) -> Column:
    out = None
    for name, prefixes in VARIANTS.items():
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | lineage.startswith(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    out = out.otherwise("Other")
    return out if given is None else F.coalesce(given, out)


#: The thresholds, weights and labels of critical value.
def critical_value(code: Column, value: Column) -> Column:
    """Panic ranges: glucose (2345-7) below 60 or above 300, potassium (2823-3) below 2.5 or above 6."""
    glucose = (code == "2345-7") & ((value < 60) | (value > 300))
    potassium = (code == "2823-3") & ((value < 2.5) | (value > 6.0))
    return F.coalesce(glucose | potassium, F.lit(False))


# ---------------------------------------------------------------- scores


#: The thresholds, weights and labels of risk scores.
def risk_scores(age: Column, chronic: Column, er: Column, admits: Column, paid: Column) -> dict[str, Column]:
    a = F.when(age < 1, 3).when(age < 5, 2).when(age >= 75, 3).when(age >= 65, 2).otherwise(1)
    c = ladder(chronic, [(3, 3), (2, 2), (1, 1)], 0, ">=")
    u = F.when((er >= 4) | (admits >= 2), 3).when((er >= 2) | (admits >= 1), 2).when(er >= 1, 1).otherwise(0)
    p = ladder(paid, [(50000, 3), (25000, 2), (10000, 1)], 0, ">=")
    return {"age_risk_score": a, "chronic_condition_risk_score": c, "utilization_risk_score": u, "cost_risk_score": p, "composite_risk_score": a + c + u + p}


def risk_tier(score: Column) -> Column:
    return ladder(score, [(9, "High"), (6, "Medium"), (3, "Low")], "Very Low", ">=")


#: The thresholds, weights and labels of vaccine flags.
def vaccine_flags(age: Column, chronic: Column, diabetes: Column, lung: Column, heart: Column) -> dict[str, Column]:
    return {"flu_vaccine_eligible": (age >= 65) | (chronic >= 1), "pneumococcal_vaccine_eligible": (age >= 65) | diabetes | lung | heart, "shingles_vaccine_eligible": age >= 50, "hpv_vaccine_eligible": age.between(19, 26)}


#: The thresholds, weights and labels of vaccine priority.
def vaccine_priority(tier: Column, age: Column, chronic: Column) -> Column:
    return F.when(tier == "High", 80).when(tier == "Medium", 60).when(tier == "Low", 40).otherwise(20) + F.when(age >= 65, 15).otherwise(0) + F.when(chronic >= 3, 5).otherwise(0)


#: The thresholds, weights and labels of outreach score.
def outreach_score(priority: Column, risk: Column, er: Column, cost: Column) -> Column:
    return priority * 0.4 + risk * 100 * 0.3 + er * 100 * 0.2 + cost * 100 * 0.1


#: The thresholds, weights and labels of outreach tier.
def outreach_tier(score: Column) -> Column:
    return ladder(score, [(80, "Tier 1 - Immediate"), (60, "Tier 2 - High Priority"), (40, "Tier 3 - Standard")], "Tier 4 - Routine", ">=")


#: The thresholds, weights and labels of outreach method.
def outreach_method(tier: Column) -> Column:
    return F.when(tier.startswith("Tier 1"), "Phone Call + Letter").when(tier.startswith("Tier 2"), "Phone Call").when(tier.startswith("Tier 3"), "Letter").otherwise("Email/Portal Message")


#: The thresholds, weights and labels of outbreak score.
def outbreak_score(rate: Column, delta: Column, seasonal: Column) -> Column:
    return ladder(rate, [(0.1, 25), (0.05, 15), (0.02, 5)], 0, ">") + ladder(delta, [(0.5, 25), (0.2, 15), (0.1, 5)], 0, ">") + ladder(seasonal, [(2.0, 25), (1.0, 15), (0.5, 5)], 0, ">")


#: The thresholds, weights and labels of outbreak level.
def outbreak_level(score: Column) -> Column:
    return ladder(score, [(50, "HIGH"), (25, "MEDIUM")], "LOW", ">=")


#: The thresholds, weights and labels of device level.
def device_level(probability: Column) -> Column:
    return ladder((probability * 100).cast("int"), [(80, "CRITICAL"), (60, "HIGH"), (30, "MEDIUM")], "LOW", ">=")


#: The thresholds, weights and labels of device advice.
def device_advice(level: Column) -> Column:
    return F.when(level == "CRITICAL", "IMMEDIATE ACTION REQUIRED: Emergency maintenance").when(level == "HIGH", "Schedule urgent maintenance within 24 hours").when(level == "MEDIUM", "Schedule maintenance within 7 days").otherwise("Continue normal operations")


#: The thresholds, weights and labels of severity.
def severity(signals: Column, agreement: Column, z: Column, relative_risk: Column) -> Column:
    score = ladder(signals, [(4, 3), (3, 2), (2, 1)], 0, ">=") + ladder(agreement, [(0.8, 3), (0.6, 2), (0.4, 1)], 0, ">=") + ladder(z, [(5.0, 3), (4.0, 2), (3.5, 1)], 0, ">=") + ladder(F.coalesce(relative_risk, F.lit(0.0)), [(3.0, 3), (2.0, 2), (1.5, 1)], 0, ">=")
    return ladder(score, [(9, "critical"), (6, "high"), (3, "moderate")], "low", ">=")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def backoff(at: Column, retries: Column, base: int = 2) -> Column:
    """The next attempt: base to the power of retries minutes later; no count is none yet."""
    return at + F.make_interval(mins=F.pow(F.lit(base), F.coalesce(retries, F.lit(0))).cast("int"))
