"""Exact quantiles, similar names, interrupted series, nowcasts, density clusters, versions, evolving sinks and stateful streams, each against brute force."""

import datetime as dt
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveil.operators import joins as J
from surveil.operators import profiles as P
from surveil.operators import quantiles as Q
from surveil.operators import statistics as S
from surveil.sources import files as I
from surveil.sources import tables as B
from surveil.streaming import retry as R
from surveil.streaming import streams as T

C = F.col
PROBS = {"lo": 0.0, "q1": 0.25, "med": 0.5, "x": 1 / 3, "q9": 0.9, "hi": 1.0}


# ---------------------------------------------------------------- quantiles


def _same(got, want):
    assert (got is None) == (want is None) and (got is None or got == pytest.approx(want, rel=1e-12))


@pytest.mark.parametrize("few", [3, 40, 10_000])
def test_quantiles_of_all_kinds_of_groups(spark, few):
    rng = random.Random(1)
    groups = {
        "spread": [rng.gauss(0, 1) for _ in range(500)], "heavy": [rng.random() ** -8 for _ in range(400)], "tied": [7.0] * 300 + [8.0], "same": [5.0] * 200, "one": [2.5], "two": [1.0, 4.0],
        "huge": [-1.7e308, 1.7e308, 0.0, 1.0, -1.0] * 30, "endless": [-math.inf, math.inf, 3.0, 4.0, 5.0] * 20, "tiny": [k * 5e-324 for k in range(100)], "none": [], None: [float(k % 17) for k in range(333)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("spread", None), ("spread", math.nan)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in Q.quantiles(df, ["g"], "v", PROBS, few=few, cells=8).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs)
        for name, p in PROBS.items():
            if not vs:
                assert got[g][name] is None
                continue
            x = (len(vs) - 1) * p
            a, b = vs[math.floor(x)], vs[math.ceil(x)]
            part = x - math.floor(x)
            _same(got[g][name], a if a == b else a * (1 - part) + b * part)


def test_quantiles_of_one_group_of_all_rows(spark):
    """300,000 rows in one group: no task gets them together, as `few` is far below."""
    d = spark.range(300_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("v"))
    vs = np.sort(np.array([r.v for r in d.collect()]))
    got = Q.quantiles(d, [], "v", PROBS, few=1000).first()
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(float(np.quantile(vs, p)), rel=1e-12)
    assert tuple(Q.quantiles(d.limit(0), [], "v", {"m": 0.5}).collect()) == ((None,),)
    assert Q.quantiles(d.limit(0).withColumn("g", F.lit(1)), ["g"], "v", {"m": 0.5}).count() == 0


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, "b", 1), (3.0, "a", 2), (None, "b", 1), (1.0, "a", 1), (1.0, "b", 1)], "v double, s string, k int")
    r = {x.column_name: x for x in P.numbers(df, ["v", "k"]).collect()}
    assert (r["v"].n, r["v"].nulls, r["v"].median, r["v"].q3, r["k"].q1) == (4, 1, 1.0, 1.5, 1.0)
    by = {(x.s, x.column_name): x.median for x in P.numbers(df, ["v"], ["s"]).collect()}
    assert by == {("a", "v"): 2.0, ("b", "v"): 1.0}
    m = {x.column_name: tuple(x)[1:] for x in P.modes(df, ["v", "s", "k"]).collect()}
    assert m == {"v": (2, "1.0", 3), "s": (2, "b", 3), "k": (2, "1", 4)}
    assert tuple(P.repeated_rows(df).first()) == (5, 1) and tuple(P.repeated_rows(df, ["s"]).first()) == (5, 3)
    assert tuple(P.repeated_rows(df.limit(0)).first()) == (0, 0)
    assert [tuple(x) for x in P.modes(df.limit(0), ["s"]).collect()] == [("s", 0, None, None)]


# ---------------------------------------------------------------- nearest vectors


def test_a_worker_holds_one_pair_of_packs(spark):
    """64 packs of one task: a worker that was given all at once held 64; results equal brute force, also with repeated ids."""
    from surveil.operators import ranking

    rng = np.random.default_rng(1)
    v = rng.normal(size=(512, 8))
    d = spark.createDataFrame([(k % 500, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>").coalesce(1)
    got = ranking.nearest(d, "id", "v", d.filter("id % 50 = 1 and id < 400"), "id", "v", 5, pack=8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    cos = np.round(v @ v.T / np.sqrt(np.outer((v * v).sum(1), (v * v).sum(1))), 6)
    want = [(q, k % 500, cos[i, k]) for i in range(512) if (q := i % 500) % 50 == 1 and q < 400 for k in range(512)]
    per = {q: sorted((x for x in want if x[0] == q), key=lambda x: (-x[2], x[1]))[:5] for q in {x[0] for x in want}}
    have = sorted(map(tuple, got.collect()), key=lambda x: (x[0], -x[2], x[1]))
    assert [(q, s) for q, _, s in have] == [(q, pytest.approx(s)) for q in sorted(per) for _, _, s in per[q]]


def test_bm25_moves_documents_once(spark):
    """Counts, sizes and sums are taken where a document's words are: no table is dealt by pairs of document and word or query."""
    from surveil.operators import ranking

    docs = spark.createDataFrame([(1, "flu flu fever"), (1, "cough"), (2, "fever"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "flu fever")], "item_id long, q string")
    s = ranking.bm25(docs, "doc_id", "text", q, "item_id", "q")
    plan = s._jdf.queryExecution().executedPlan().toString()
    dealt = [x.split(")")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert dealt and not any("doc_id#" in x and ("w#" in x or "item_id#" in x) for x in dealt)
    idf = {w: math.log(1 + (2 - n + 0.5) / (n + 0.5)) for w, n in (("flu", 1), ("fever", 2))}
    gain = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 2.5))
    assert {r.doc_id: r.score for r in s.collect()} == {1: pytest.approx(idf["flu"] * gain(2, 4) + idf["fever"] * gain(1, 4)), 2: pytest.approx(idf["fever"] * gain(1, 1))}


# ---------------------------------------------------------------- places


def test_near_places_are_all_pairs_that_are_near(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(150)] + [(0.0, 0.0), (0.0, 0.0), (None, 1.0)]
    a = spark.createDataFrame(rows, "la double, lo double")
    near = (F.abs(C("la") - C("la2")) <= 0.5) & (F.abs(C("lo") - C("lo2")) <= 0.25)
    got = sorted(map(tuple, J.near_places(a, a, "la", "lo", "la2", "lo2", 0.5, 0.25, near).collect()))
    fine = {x for x in rows if x[0] is not None}
    assert got == sorted((*x, *y) for x in fine for y in fine if abs(x[0] - y[0]) <= 0.5 and abs(x[1] - y[1]) <= 0.25)


@pytest.mark.parametrize("query", ["join_interval_km", "join_cluster"])
def test_many_rows_at_one_place(spark, tmp_path, query):
    """60,000 errors, 60,000 other events and as many suppliers of one place: pairs of rows would be billions."""
    from surveil.plans import registry

    ts = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").alias("ts")
    kind = F.when(C("id") % 2 == 0, "error").otherwise("view").alias("event_type")
    spark.range(120_000).select((C("id") * 97 * 89).alias("event_id"), ts, F.lit(60).cast("long").alias("user_id"), kind, (C("id") % 10).cast("double").alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(60_000).select((C("id") * 60).alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    d = registry.QUERIES[query](spark, str(tmp_path))
    last = "stream, b" if query == "join_interval_km" else "cluster"
    got = d.selectExpr(f"struct({last}) AS x").groupBy("x").count().collect()
    want = ("view", 9 * 97 * 89) if query == "join_interval_km" else (0,)
    assert [(tuple(r.x), r["count"]) for r in got] == [(want, 60_000)]


# ---------------------------------------------------------------- two-way tables


def test_chi_square_of_many_rows(spark):
    """Products of three counts pass 64 bits; a balanced table has a statistic of nought."""
    r = S.chi_square(spark.range(8_000_000), C("id") % 2, C("id") % 5).first()
    assert (r.chi2, r.df) == (0.0, 4)


def test_chi_square_with_empty_cells_and_nulls(spark):
    rows = [("x", "p")] * 3 + [("x", "q")] * 2 + [("y", "q")] * 4 + [(None, "p"), ("z", None)]
    r = S.chi_square(spark.createDataFrame(rows, "a string, b string"), C("a"), C("b")).first()
    a, b = [x for x, _ in rows], [x for _, x in rows]
    want = 0.0
    for i in set(a):
        for j in set(b):
            e = a.count(i) * b.count(j) / len(rows)
            want += ((rows.count((i, j)) if None not in (i, j) else 0) - e) ** 2 / e
    assert r.chi2 == pytest.approx(want, rel=1e-12) and r.df == 2
    r = S.chi_square(spark.createDataFrame([], "a string, b string"), C("a"), C("b")).first()
    assert r.chi2 is None


# ---------------------------------------------------------------- similar names


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _ratio(a, b):
    x, y = (" ".join(sorted(s.lower().strip(" ").split())) for s in (a, b))
    return 100.0 * (1 - _edits(x, y) / max(len(x), len(y), 1))


@pytest.mark.parametrize("least", [85.0, 70.0])
def test_similar_pairs_miss_none(spark, least):
    rng = random.Random(2)
    base = ["Saint Mary Hospital", "General Clinic North", "abc", "aaaaaaaaaaaaaaaa", "County Health Center 12", "x", "", "Ab", "Zentrum für Gesundheit"]
    names = []
    for _ in range(150):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.randrange(2)] = rng.choice(["", "a", "Q", " "])
        names.append("".join(s))
    rows = [(k, k % 2, n) for k, n in enumerate(names)] + [(998, 0, None), (999, None, "abc")]
    a = spark.createDataFrame(rows, "a int, g int, na string")
    b = a.select(C("a").alias("b"), "g", C("na").alias("nb"))
    got = {(r.a, r.b): r.score for r in J.similar_pairs(a, b, ["g"], "na", "nb", least, only="a < b").collect()}
    want = {}
    for i, g, x in rows:
        for j, h, y in rows:
            if i < j and g is not None and g == h and x is not None and y is not None and _ratio(x, y) >= least:
                want[i, j] = _ratio(x, y)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 100


def test_similar_pairs_by_runs_miss_none(spark, monkeypatch):
    monkeypatch.setattr(J, "PAIRS_A_ROW", 0)
    test_similar_pairs_miss_none(spark, 85.0)


@pytest.mark.parametrize("pairs", [0, 200])
def test_similar_pairs_by_cells_and_by_runs_agree(spark, monkeypatch, pairs):
    """Few pairs a row: the cells are compared, and no run is counted; many: names meet by runs."""
    monkeypatch.setattr(J, "PAIRS_A_ROW", pairs)
    by_runs, met = [], J.similar_candidates
    monkeypatch.setattr(J, "similar_candidates", lambda *a: by_runs.append(1) or met(*a))
    a = spark.range(300).select(C("id").alias("a"), (C("id") % 50).alias("g"), F.format_string("Customer#%09d", C("id")).alias("na"))
    b = a.select(C("a").alias("b"), "g", C("na").alias("nb"))
    got = {(r.a, r.b): r.score for r in J.similar_pairs(a, b, ["g"], "na", "nb", only="a < b").collect()}
    name = "Customer#{:09d}".format
    assert got == {(i, j): pytest.approx(_ratio(name(i), name(j))) for i in range(300) for j in range(i + 50, 300, 50) if _ratio(name(i), name(j)) >= 85}
    assert len(by_runs) == (pairs == 0) and got


def test_names_of_a_cell_are_compared_at_once(spark, monkeypatch):
    """Words of all lengths in lists that are cut to blocks and batches in every way; a word that comes often is compared once a list, and no pair of rows goes through levenshtein."""
    import pyarrow as pa

    rng = random.Random(5)
    words = ["", "x", "ab", "Gesundheit fü", "Gesundheit für", "customer#000012345", "customer#000012354", "customer#00001234", "customer#000912345", "customer#\U0001f600"]
    lists = [([rng.choice(words) for _ in range(rng.randrange(9))], [rng.choice(words) for _ in range(rng.randrange(9))]) for _ in range(60)] + [(["x"] * 700, ["x"] * 500)]
    xs, ys = (pa.array([p[k] for p in lists], pa.list_(pa.string())) for k in (0, 1))
    for off in (0.15, 0.4):
        want = [sorted((i, j, _edits(x, y)) for i, x in enumerate(p) for j, y in enumerate(q) if _edits(x, y) <= max(len(x), len(y)) * off + 1e-9) for p, q in lists]
        for once, batch in ((1 << 18, 4_000_000), (7, 50)):
            monkeypatch.setattr(J, "_AT_ONCE", once)
            monkeypatch.setattr(J, "_A_BATCH", batch)
            found = [r for part in J._alike(off).func([(xs, ys)]) for r in part.to_pylist()]
            assert [sorted((i, j, m["apart"]) for m in r for i in m["i"] for j in m["j"]) for r in found] == want
    assert [len(r) for r in found][-1] == 1
    a = spark.range(100).select(C("id").alias("a"), F.lit(1).alias("g"), F.format_string("Customer#%09d", C("id") % 10).alias("na"))
    d = J.similar_pairs(a, a.select(C("a").alias("b"), "g", C("na").alias("nb")), ["g"], "na", "nb", only="a < b")
    assert "levenshtein" not in d._jdf.queryExecution().optimizedPlan().toString() and d.count() == 4950


def test_few_candidates_in_one_cell(spark):
    """5,000 names of one cell, 12.5 million pairs. Of names that differ in five digits a third of the pairs is compared at most, of names of words a fiftieth."""
    pick = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))
    letters = F.array(*(F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"))
    word = lambda k: F.concat(*(F.element_at(letters, (pick(10 * k + i, 26) + 1).cast("int")) for i in range(7)))
    for name, share in ((F.format_string("Customer#%09d", pick(0, 150_000)), 0.33), (F.concat_ws(" ", word(1), word(2), F.lit("hospital")), 0.02)):
        a = spark.range(5000).select(C("id").alias("a"), F.lit(0).alias("g"), name.alias("na"))
        b = a.select(C("a").alias("b"), "g", C("na").alias("nb"))
        assert J.similar_candidates(a, b, ["g"], "na", "nb", only="a < b").count() < share * 5000 * 4999 / 2


def test_salted_join_spreads_equal_rows(spark):
    a = spark.createDataFrame([(1, "x")] * 200, "k int, v string").repartition(4)
    b = spark.createDataFrame([(1, "r")], "k int, w string")
    assert J.salted_join(a, b, "k", 8).count() == 200


def test_salted_join_sends_no_side_through_the_driver(spark, tmp_path):
    spark.range(200).write.parquet(f"{tmp_path}/k")
    k = spark.read.parquet(f"{tmp_path}/k").withColumnRenamed("id", "k")  # small enough to be broadcast
    plan = J.salted_join(k, k, "k", 8)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


# ---------------------------------------------------------------- series and counts


def test_interrupted_series_against_matrices(spark):
    rng = np.random.default_rng(3)
    n, at, lags = 40, 25, 4
    t = np.arange(n)
    y = 50 + 0.7 * t + np.where(t >= at, 9 - 0.4 * (t - at), 0) + np.convolve(rng.normal(size=n + 3), [1, 0.6, 0.3, 0.1], "valid")
    x = np.column_stack([np.ones(n), t, t >= at, np.where(t >= at, t - at, 0)]).astype(float)
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    g = x * e[:, None]
    meat = g.T @ g
    for k in range(1, lags + 1):
        cross = g[k:].T @ g[:-k]
        meat += (1 - k / (lags + 1)) * (cross + cross.T)
    se = np.sqrt(np.diag(inv @ meat @ inv))
    d = spark.createDataFrame([(int(a), float(b)) for a, b in zip(t, y)], "t int, y double").repartition(3)
    r = S.interrupted(d, "t", "y", at, lags).first()
    names = ["intercept", "slope", "level_change", "slope_change"]
    assert np.allclose([r[c] for c in names], beta) and np.allclose([r[f"{c}_se"] for c in names], se)
    assert r.durbin_watson == pytest.approx(float((np.diff(e) ** 2).sum() / (e**2).sum())) and r.days == n
    for row in S.counterfactual(d, "t", "y", at).collect():
        assert row.counterfactual == pytest.approx(beta[0] + beta[1] * row.t) and row.fitted == pytest.approx(float(x[row.t] @ beta))
        assert row.effect == pytest.approx(row.fitted - row.counterfactual if row.t >= at else 0.0, abs=1e-9)


def test_logit_by_cluster_against_matrices(spark):
    rng = np.random.default_rng(9)
    n = 400
    x = np.column_stack([np.ones(n), rng.normal(size=n), rng.integers(0, 2, n), rng.normal(size=n)])
    cluster = rng.integers(0, 25, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [0.2, 0.8, -0.5, 0.0] + rng.normal(size=25)[cluster])))).astype(float)
    beta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    inverse = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
    u = np.array([((y - p)[:, None] * x)[cluster == c].sum(0) for c in np.unique(cluster)])
    se = np.sqrt(np.diag(inverse @ u.T @ u @ inverse) * len(u) / (len(u) - 1))
    d = spark.createDataFrame([(int(a), float(b[1]), int(b[2]), float(b[3]), int(c)) for a, b, c in zip(y, x, cluster)] + [(None, 1.0, 1, 1.0, 1), (1, None, 1, 1.0, 1)], "y int, a double, b int, c double, g int")
    got = S.logit_by_cluster(d, "y", ["a", "b", "c"], "g").collect()
    assert [r.term for r in got] == ["intercept", "a", "b", "c"]
    assert np.allclose([r.log_odds for r in got], beta, atol=1e-5) and np.allclose([r.robust_se for r in got], se, rtol=1e-4)


def test_negative_binomial_quantiles():
    for mean, variance in ((3.0, 3.0), (3.0, 12.0), (40.0, 90.0), (0.2, 0.5), (500.0, 5000.0)):
        size = mean * mean / max(variance - mean, 1e-7 * mean)
        share, total, k = size / (size + mean), 0.0, 0
        want = {}
        while len(want) < 3:
            total += math.exp(math.lgamma(k + size) - math.lgamma(size) - math.lgamma(k + 1) + size * math.log(share) + k * math.log1p(-share))
            for q in (0.025, 0.5, 0.975):
                if q not in want and total >= q:
                    want[q] = k
            k += 1
        assert {q: S.negative_binomial_quantile(q, mean, variance) for q in want} == want
    assert S.negative_binomial_quantile(0.975, 0.0, 0.0) == 0


def test_nowcast_by_hand(spark):
    day = lambda k: dt.date(2024, 1, 1 + k)
    cells = [(d, lag, n) for d, ns in enumerate([(10, 20, 10), (12, 18, 10), (8, 22, 0), (16, 24), (15,)]) for lag, n in enumerate(ns) if n]
    rows = {r.d: r for r in S.nowcast(spark.createDataFrame([(day(d), lag, n) for d, lag, n in cells], "d date, lag int, n long"), "2024-01-05").collect()}
    all_ = sum(n for *_, n in cells)
    part = [sum(n for _, lag, n in cells if lag == k) / all_ for k in range(3)]
    share = [sum(part[: k + 1]) for k in range(3)]
    total, want = 0.0, {}
    for d in range(5):
        age = 4 - d
        seen, p = sum(n for x, _, n in cells if x == d), share[min(age, 2)]
        want[d] = (seen, p, seen / p)
        for lag in range(min(age, 2) + 1):
            n, expected = sum(n for x, k, n in cells if (x, k) == (d, lag)), seen / p * part[lag]
            total += (n - expected) ** 2 / expected
    phi = max(total / (14 - 1 - 5 - 3 + 1 + 0), 1.0) if False else max(total / max(sum(min(4 - d, 2) + 1 for d in range(5)) - 5 - 3 + 1, 1), 1.0)
    for d, (seen, p, corrected) in want.items():
        r = rows[day(d)]
        assert (r.seen, pytest.approx(r.share), pytest.approx(r.corrected), pytest.approx(r.phi)) == (seen, p, corrected, phi)
        mean = seen * (1 - p) / p
        assert (r.low, r.high) == tuple(seen + S.negative_binomial_quantile(q, mean, phi * mean / p) for q in (0.025, 0.975))
    assert rows[day(0)].low == rows[day(0)].high == rows[day(0)].seen and rows[day(4)].low <= rows[day(4)].corrected <= rows[day(4)].high


# ---------------------------------------------------------------- clusters by density


def _km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(h, 1.0)))


def _clusters(points, radius, least):
    near = {a[0]: [b[0] for b in points if _km(a, b) <= radius] for a in points}
    core = {k for k, v in near.items() if len(v) >= least}
    label = {k: k for k in core}
    moved = True
    while moved:
        moved = False
        for k in core:
            low = min(label[v] for v in near[k] if v in core)
            if low < label[k]:
                label[k], moved = low, True
    return {k: label[k] if k in core else min(label[v] for v in near[k] if v in core) for k in near if k in core or any(v in core for v in near[k])}


@pytest.mark.parametrize(("lat", "spread"), [(0.0, 1.0), (52.0, 1.5), (-75.0, 4.0)])
def test_density_clusters_against_all_pairs(spark, lat, spread):
    rng = random.Random(int(lat) + 200)
    points = [(k, lat + rng.gauss(0, 0.5), 10 + rng.gauss(0, spread)) for k in range(250)]
    points += [(1000 + k, lat + 0.3, 10.0) for k in range(12)] + [(2000 + k, lat + 3 + 0.02 * k, 14.0) for k in range(12)] + [(3000, lat + 20, 0.0)]
    df = spark.createDataFrame(points + [(9999, None, 1.0)], "id long, la double, lo double").repartition(3)
    for radius, least in ((12.0, 4), (25.0, 8)):
        got = {r.id: r.cluster for r in S.density_clusters(df, "id", "la", "lo", radius, least).collect()}
        assert got == _clusters(points, radius, least)
    assert S.density_clusters(df.limit(0), "id", "la", "lo", 5.0, 3).count() == 0


def test_ten_thousand_points_at_one_place(spark):
    """And as many at another within reach: 200 million pairs if they were compared."""
    d = spark.range(20_000).select("id", F.lit(40.0).alias("la"), F.when(C("id") < 10_000, 8.0).otherwise(8.01).alias("lo"))
    d = d.unionByName(spark.createDataFrame([(30_000, 40.0, 8.02), (40_000, 41.0, 8.0)], "id long, la double, lo double"))
    got = S.density_clusters(d, "id", "la", "lo", 1.0, 5).groupBy("cluster").agg(F.count("*").alias("n"), F.max("id").alias("hi")).collect()
    assert [tuple(r) for r in got] == [(0, 20_001, 30_000)]


# ---------------------------------------------------------------- tables


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/v"
    d = spark.range(10)
    with pytest.raises(ValueError, match="nothing was there"):
        B.as_of(spark, path)
    assert [B.commit(d, path, "2024-01-01"), B.commit(d.limit(4), path, "2024-01-03"), B.commit(d.limit(2), path, "2024-01-05")] == [1, 2, 3]
    count = lambda **k: B.as_of(spark, path, **k).count()
    assert (count(), count(version=1), count(time="2024-01-03"), count(time="2024-01-04 23:00:00")) == (2, 10, 4, 4)
    with pytest.raises(ValueError, match="nothing was there"):
        count(time="2023-12-31")
    B.roll_back(spark, path, 1, "2024-01-07")
    assert (count(), count(time="2024-01-06"), count(version=3)) == (10, 2, 2)
    with pytest.raises(ValueError, match="no version 9"):
        B.roll_back(spark, path, 9)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):  # two writers with one number
        B._entry(spark, path, 4, 1, None, "commit", None)
    spark.range(1).write.parquet(f"{path}/data/9-9")  # of a commit that failed
    assert B.vacuum(spark, path) == 2 and (count(), count(version=3)) == (10, 2)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        count(version=2)
    assert [r.action for r in B.manifest(spark, path).orderBy("entry").collect()] == ["commit"] * 3 + ["roll back"]


def test_evolving_sink(spark, tmp_path):
    path = f"{tmp_path}/e"
    I.append_evolving(spark.createDataFrame([(1, "a")], "k int, p string"), path, ["p"])
    I.append_evolving(spark.createDataFrame([(2, "x", "b")], "k int, more string, p string"), path, ["p"])
    assert sorted((r.k, r.more, r.p) for r in I.read_evolving(spark, path).collect()) == [(1, None, "a"), (2, "x", "b")]
    with pytest.raises(ValueError, match="k: int, not string"):
        I.append_evolving(spark.createDataFrame([("3", "b")], "k string, p string"), path, ["p"])
    assert I.read_evolving(spark, path).count() == 2


# ---------------------------------------------------------------- streams


def _land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_retries_over_a_restart(spark, tmp_path):
    """Item 1 fails twice, waits and succeeds; 2 exceeds its retries; 3 succeeds at once; 4 raises; ticks move the clock."""
    schema = "id long, payload string, ts timestamp"
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def attempt(payload, n):
        if payload == "raise":
            raise RuntimeError("no")
        return n >= int(payload)

    def run():
        with R.keyed_state(spark):
            items = T.files(spark, src, schema).withWatermark("ts", "0 seconds")
            T.run_once(R.retries(items, attempt, "id", "payload", "ts", most=3), f"{out}/data", f"{out}/checkpoint")
        return [(r.key, r.state, r.retry_count, int((r.at - at(0)).total_seconds() / 60)) for r in spark.read.parquet(f"{out}/data").orderBy("key", "at").collect()]

    _land(spark, src, [(1, "2", at(0)), (2, "99", at(0)), (3, "0", at(0)), (4, "raise", at(0)), (1, "2", at(0)), (None, "0", at(0)), (90, "0", at(1))], schema)
    first = run()
    assert first == [(1, "waiting", 1, 0), (2, "waiting", 1, 0), (3, "success", 0, 0), (4, "waiting", 1, 0), (90, "success", 0, 1)]
    assert run() == first  # a restart repeats nothing
    _land(spark, src, [(1, "0", at(2)), (91, "0", at(4))], schema)  # 1 waits, so its new row is left out
    second = run()
    assert second == [(1, "waiting", 1, 0), (1, "waiting", 2, 2), (2, "waiting", 1, 0), (2, "waiting", 2, 2), (3, "success", 0, 0), (4, "waiting", 1, 0), (4, "waiting", 2, 2), (90, "success", 0, 1), (91, "success", 0, 4)]
    _land(spark, src, [(92, "0", at(60))], schema)
    steps = [x for x in run() if x not in second]
    assert steps == [(1, "success", 2, 6), (2, "waiting", 3, 6), (2, "dead", 4, 14), (4, "waiting", 3, 6), (4, "dead", 4, 14), (92, "success", 0, 60)]
    last = {r.key: (r.state, r.retry_count) for r in R.last_steps(spark.read.parquet(f"{out}/data")).collect()}
    assert last == {1: ("success", 2), 2: ("dead", 4), 3: ("success", 0), 4: ("dead", 4), 90: ("success", 0), 91: ("success", 0), 92: ("success", 0)}


def test_retries_by_the_cluster_clock(spark, tmp_path):
    """base 0: a retry is due at once. Such a stream never runs out of batches, so it is stopped."""
    schema = "id long, payload string, ts timestamp"
    _land(spark, f"{tmp_path}/in", [(1, "2", at(0)), (2, "9", at(0))], schema)
    with R.keyed_state(spark):
        d = R.retries(T.files(spark, f"{tmp_path}/in", schema), lambda p, n: n >= int(p), "id", "payload", "ts", most=2, base=0, event_time=False)
        q = T.every(d, f"{tmp_path}/out", f"{tmp_path}/checkpoint", 1)
        for _ in range(120):
            time.sleep(0.5)
            if any(p.numInputRows for p in q.recentProgress):
                break
        q.stop()
    assert {r.key: (r.state, r.retry_count) for r in R.last_steps(spark.read.parquet(f"{tmp_path}/out")).collect()} == {1: ("success", 2), 2: ("dead", 3)}


def test_waiting_items_share_states(spark, tmp_path):
    """A thousand items wait in four states, and all are tried again when the watermark is just there; a batch costs no call an item."""
    schema = "id long, payload string, ts timestamp"
    _land(spark, f"{tmp_path}/in", [(k, "1", at(0)) for k in range(1000)], schema)

    def run():
        with R.keyed_state(spark):
            d = R.retries(T.files(spark, f"{tmp_path}/in", schema).withWatermark("ts", "0 seconds"), lambda p, n: n >= int(p), "id", "payload", "ts", shares=4)
            q = d.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            q.awaitTermination()
        steps = spark.read.parquet(f"{tmp_path}/out").groupBy("state", "at").count().collect()
        return [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.numInputRows], {(r.state, r.at): r["count"] for r in steps}

    assert run() == ([4], {("waiting", at(0)): 1000})
    _land(spark, f"{tmp_path}/in", [(5000, "0", at(2))], schema)
    assert run()[1] == {("waiting", at(0)): 1000, ("success", at(2)): 1001}


def _stream(spark, tmp_path, schema, build, *parts):
    for rows in parts:
        _land(spark, f"{tmp_path}/in", rows, schema)
        with R.keyed_state(spark):
            T.run_once(build(T.files(spark, f"{tmp_path}/in", schema)), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    return spark.read.parquet(f"{tmp_path}/out")


def test_late_rows_are_not_counted(spark, tmp_path):
    """Sliding windows of 60 minutes every 30; the watermark is 10 minutes behind."""
    parts = [(1, at(5)), (1, at(50))], [(1, at(200)), (1, at(45))], [(1, at(20)), (1, at(300))]
    got = _stream(spark, tmp_path, "k int, ts timestamp", lambda d: T.tumbling(d, "ts", ["k"], "60 minutes", "10 minutes", "30 minutes").select("start", "n"), *parts)
    # at(45) comes in time for the windows that end after 40; at(20) is later than the watermark of 190
    minute = lambda r: int((r.start - at(0)).total_seconds() / 60)
    assert sorted((minute(r), r.n) for r in got.collect()) == [(-30, 1), (0, 3), (30, 2), (150, 1), (180, 1)]


def test_sessions_close_when_the_watermark_passes(spark, tmp_path):
    parts = [(1, at(0)), (1, at(8)), (2, at(0))], [(1, at(15)), (3, at(100))], [(1, at(16)), (3, at(200))]
    got = _stream(spark, tmp_path, "k int, ts timestamp", lambda d: T.sessions(d, "ts", ["k"], "10 minutes", "5 minutes").select("k", "start", "end", "n"), *parts)
    assert sorted((r.k, int((r.end - r.start).total_seconds() / 60), r.n) for r in got.collect()) == [(1, 25, 3), (2, 10, 1), (3, 10, 1)]


def test_repeats_within_the_watermark(spark, tmp_path):
    parts = [(1, at(0)), (1, at(1)), (2, at(30))], [(2, at(31)), (3, at(32)), (1, at(0))]
    got = _stream(spark, tmp_path, "k int, ts timestamp", lambda d: T.once_each(d, ["k"], "ts", "10 minutes").select("k"), *parts)
    assert sorted(r.k for r in got.collect()) == [1, 2, 3]


def test_rules_on_a_stream(spark, tmp_path):
    schema = "id long, v double"
    known = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long")
    rules = [T.RowRule("positive", "v > 0"), T.RowRule("small", "v < 10", 0.5, "WARNING"), T.KnownKey("known", "id", known, "k")]
    for rows in ([(1, 1.0), (2, 50.0)], [(1, -1.0), (3, None), (None, 2.0)], [(1, 5.0)]):
        _land(spark, f"{tmp_path}/in", rows, schema)
        T.checked(T.files(spark, f"{tmp_path}/in", schema), rules, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {(r.batch, r.rule): (r.n_rows, r.n_broken, r.status) for r in spark.read.parquet(f"{tmp_path}/out/verdicts").collect()}
    assert got == {
        (0, "positive"): (2, 0, "PASS"), (0, "small"): (2, 1, "PASS"), (0, "known"): (2, 0, "PASS"),
        (1, "positive"): (3, 2, "FAIL"), (1, "small"): (3, 1, "PASS"), (1, "known"): (3, 2, "FAIL"),
        (2, "positive"): (1, 0, "PASS"), (2, "small"): (1, 0, "PASS"), (2, "known"): (1, 0, "PASS"),
    }
    assert spark.read.parquet(f"{tmp_path}/out/data").count() == 6


def test_every_thirty_seconds(spark, tmp_path):
    """The timed trigger: what is there is written by date in the first batch, then the stream is stopped."""
    _land(spark, f"{tmp_path}/in", [(1, at(0)), (2, at(2000))], "k int, ts timestamp")
    d = T.files(spark, f"{tmp_path}/in", "k int, ts timestamp").withColumn("day", F.to_date("ts"))
    q = T.every(d, f"{tmp_path}/out", f"{tmp_path}/checkpoint", 30, ["day"])
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, str(r.day)) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "2024-01-01"), (2, "2024-01-02")]
