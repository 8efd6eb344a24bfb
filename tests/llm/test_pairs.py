"""Near-duplicates, components and embeddings against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from surveil.llm._components import components
from surveil.llm.embeddings import embedding_links, hadamard, plan
from surveil.llm.near_duplicates import _pairs_of_blocks, links_of, near_duplicates


def union(n, links):
    root = {i: i for i in n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in n}


def test_components(spark):
    random.seed(3)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 560)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = union({x for e in links for x in e}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def _set(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _brute(rows):
    sets = {d: _set(t) for d, t, *_ in rows if d is not None}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, union(ids, links)


def _rows(seed, near=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(800)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = [(k, " ".join(make(rng.randrange(1, 120))), "x") for k in range(120)]
    base = make(120)
    for k in range(near):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((1000 + k, " ".join(w), "x"))
    rows += [(2000 + k, " ".join(base), "x") for k in range(30)]
    rows += [(3000, "", "x"), (3001, None, "x"), (3002, "one two", "x"), (3003, "ONE  two\n", "x"), (3004, "two one", "x"), (3005, "É é", "x"), (3006, "é é", "x")]
    for k in range(20):  # pairs close to the threshold
        w = make(60)
        v = list(w)
        v[rng.randrange(8, 50)] = "zz"
        rows += [(4000 + 2 * k, " ".join(w), "x"), (4001 + 2 * k, " ".join(v), "x")]
    return rows


def test_near_duplicates_under_a_template(spark):
    """Many documents share most of their words but are no near-duplicates; each of the true pairs among them is found."""
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(3000)]
    template = [rng.choice(vocab) for _ in range(80)]
    rows = []
    for k in range(250):
        tail = [rng.choice(vocab) for _ in range(24)]
        rows.append((2 * k, " ".join(template + tail), "x"))
        tail[rng.randrange(24)] = "zz"  # a copy with one word changed
        rows.append((2 * k + 1, " ".join(template + tail), "x"))
    sets, want = _brute(rows)
    assert max(sum(want[d] == c for d in want) for c in set(want.values())) < 10
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    for volume in (2_000_000, 4000):  # one node of 50 times the limit, compared as it is and by pairs of blocks
        got = {r.doc_id: r.component_id for r in near_duplicates(df, limit=10, volume=volume).collect()}
        assert got == want


def test_near_duplicates(spark):
    rows = _rows(1)
    sets, want = _brute(rows)
    extra = [(None, rows[130][1], "x"), (5, rows[5][1], "x")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, n string")
    for limit, depth in ((250, 4), (8, 2)):
        got = near_duplicates(df, limit=limit, depth=depth).collect()
        assert len(got) == len(rows) + 2
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_that_share_a_template(spark):
    rng = random.Random(11)
    template = [f"t{k}" for k in range(84)]
    own = lambda k, n: [f"o{k}_{j}" for j in range(n)]
    rows = [(k, " ".join(template + own(k, 16))) for k in range(400)]  # 80 of 112 shingles are common to two: 0.71
    for k in range(0, 400, 10):  # with 4 of 16 own words in common: 84 of 108, 0.78
        rows[k + 1] = (k + 1, " ".join(template + own(k, 4) + own(k + 1, 12)))
    rng.shuffle(rows)
    sets, want = _brute(rows)
    assert len(set(want.values())) == 360
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df, trees=1, limit=10, depth=1).collect()}
    assert sum(got[a] == got[a + 1] for a in range(0, 400, 10)) >= 20  # one tree of one level: a pair meets with probability 0.8 or so
    assert all(got[d] in (d, want[d]) for d in want)


def test_pairs_of_blocks_leave_no_pair_out(spark):
    for near in (0, 30, 70):  # of 70 members, so many are in one component
        links = spark.createDataFrame([(0, k) for k in range(1, near)], "u long, v long")
        members = spark.createDataFrame([(9, k) for k in range(70)], "path long, doc long")
        tasks = {}
        for r in _pairs_of_blocks(members.withColumn("n", F.lit(1).cast("long")), links, 8).collect():
            tasks.setdefault(r.path, set()).add(r.doc)
        met = {(a, b) for t in tasks.values() for a in t for b in t if a < b}
        assert {(a, b) for b in range(70) for a in range(b) if b >= near} <= met
        assert (near < 70) == bool(tasks)


def test_links_of_a_node_connect_what_brute_force_connects():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, rng.integers(5, 30))).astype(np.uint64) for _ in range(60)]
    want = union(range(60), [(a, b) for a in range(60) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))])
    assert union(range(60), list(links_of(sets, 60))) == want
    assert union(range(60), list(links_of(sets, 60, limit=10))) == want


def test_hadamard():
    x = np.random.default_rng(1).normal(size=(3, 8))
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(8)] for i in range(8)])
    assert np.allclose(hadamard(x), x @ h)


def test_plan_grows():
    assert plan(100, 64)[1] == 1 and plan(10**9, 64)[1] >= 4


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(150, 16))
    near = [v[k % 30] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2]) for k in range(150)]
    rows = [(k, [float(np.float32(x)) for x in r], "a") for k, r in enumerate([*v, *near])]
    rows += [(500 + k, rows[3][1], "a") for k in range(12)]
    bad = [(600, None, "a"), (601, [], "a"), (602, [0.0] * 16, "a"), (603, [math.nan] + [1.0] * 15, "a"), (604, [None] + [1.0] * 15, "a"), (605, [math.inf] + [1.0] * 15, "a"), (606, [1.0, 2.0], "a")]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    ids = [r[0] for r in rows]
    root = union(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(close))])
    df = spark.createDataFrame(rows + bad + [(None, rows[3][1], "a")], "vec_id long, embedding array<float>, id string")
    for block in (1024, 16):
        got = {r.vec_id: r for r in embedding_links(df, block=block).collect()}
        for k, i in enumerate(ids):
            extra = int(i == 3 or i >= 500 or bool(close[k][ids.index(3)]))  # the copy without id
            assert got[i].component_id == root[i], i
            assert got[i].n_links in (close[k].sum(), close[k].sum() + extra), i
            assert got[i].kept == (root[i] == i)
        for i, *_ in bad:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
