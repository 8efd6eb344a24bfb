"""Every opN_ query over whole given tables, against plain versions of what it must return; and the cases that any table may hold."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from surveil.llm import conversations, decontaminate, embeddings, fill_middle, language, near_duplicates, pieces, quality, queries, repeated_windows, secrets, suffix_arrays, suffix_tree, token_counts

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{DATA}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), [x or "" for x in t["text"].to_pylist()]))


def rows_of(spark, name, key="doc_id"):
    got = queries.QUERIES[name](spark, DATA).collect()
    out = {r[key]: r for r in got}
    assert len(out) == len(got)
    return out


def test_op2_by_all_windows(spark, texts):
    words = {d: WORDS.findall(t) for d, t in texts.items()}
    first: dict[tuple, int] = {}
    for d in sorted(words, reverse=True):
        for k in range(len(words[d]) - 49):
            first[tuple(words[d][k : k + 50])] = d
    got = rows_of(spark, "op2_super_kmers")
    assert got.keys() == texts.keys()
    for d, w in words.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < d:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_op5_by_all_strings(spark, texts):
    raw = {d: t.encode() for d, t in texts.items()}
    seen = Counter(hash(t[k : k + 400]) for t in raw.values() for k in range(len(t) - 399))
    got = rows_of(spark, "op5_suffix_blocks")
    assert got.keys() == texts.keys()
    for d, t in raw.items():
        gone = np.zeros(len(t) + 1, np.int32)
        for k in range(len(t) - 399):
            if seen[hash(t[k : k + 400])] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def _components(links, nodes):
    low = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                moved = True
    return low


def test_op9_by_all_pairs(spark, texts):
    sets = {}
    for d, t in texts.items():
        w = WORDS.findall(t.translate(LOWER))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = _components(links, ids)
    got = rows_of(spark, "op9_chosen_path")
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), low[d], low[d] == d) for d in ids}


def test_op7_by_all_pairs(spark):
    t = pq.read_table(f"{DATA}/embeddings.parquet")
    ids, x = t["vec_id"].to_pylist(), np.array(t["embedding"].to_pylist(), float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    a, b = np.nonzero(x @ x.T >= 0.95)
    links = [(ids[i], ids[j]) for i, j in zip(a, b) if i < j]
    n, low = Counter(v for pair in links for v in pair), _components(links, ids)
    got = rows_of(spark, "op7_cross_polytope", "vec_id")
    assert {d: (r.n_links, r.component_id, r.kept) for d, r in got.items()} == {d: (n[d], low[d], low[d] == d) for d in ids}


def test_op4_base_by_counting(spark, texts):
    tokens = {d: [*WORDS.findall(t.translate(LOWER)), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    count = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    got = rows_of(spark, "op4_suffix_tree")
    assert got.keys() == texts.keys()
    for d, ws in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) and r.score < 0


def test_op10_held_out_rows(spark, texts):
    got = rows_of(spark, "op10_quality_classifier")
    assert got.keys() == texts.keys()
    assert all((r.held_out, r.predicted) == (zlib.crc32(str(d).encode()) % 5 == 0, int(r.score >= 0.3)) and 0 <= r.score <= 1 for d, r in got.items())
    labels = pq.read_table(f"{DATA}/labels.parquet")
    out = [(got[d].predicted, q) for d, q in zip(labels["doc_id"].to_pylist(), labels["quality"].to_pylist()) if q is not None and d in got and got[d].held_out]
    assert np.mean([p == q for p, q in out]) >= 0.9


def test_op10_model_by_hand(spark):
    """Means, shrunk covariances and scores against numpy on the same statistics."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.document_statistics(docs)
    model = quality.train_on(stats, labels)
    x = {r.doc_id: np.array(r.stats) for r in stats.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 5}
    part = [np.array([x[d] for d, q in y.items() if q == k]) for k in (0, 1)]
    cov = [np.cov(p.T, bias=True) for p in part]
    pooled = (cov[0] * len(part[0]) + cov[1] * len(part[1])) / len(y)
    log_p = []
    some = np.array([x[d] for d in sorted(x)])
    for k in (0, 1):
        c = 0.7 * cov[k] + 0.3 * pooled
        c = 0.95 * c + 0.05 * np.diag(np.maximum(np.diag(pooled), 1e-3 * (np.diag(pooled).mean() + 1e-9)))
        far = some - part[k].mean(0)
        log_p.append(-0.5 * (far * np.linalg.solve(c, far.T).T).sum(1) - 0.5 * np.linalg.slogdet(c)[1])
    odds = log_p[1] - log_p[0] + np.log((len(part[1]) + 0.5) / (len(part[0]) + 0.5))
    assert np.allclose(model.log_odds(some), odds, rtol=1e-6, atol=1e-6)


def test_op1_pairs_by_plain_tiling(spark, texts):
    """Every given item against every given text, tiled cell by cell where they share five words; coverage is told to a tile."""
    got = {(r.doc_id, r.item_id): r for r in queries.QUERIES["op1_greedy_tiling"](spark, DATA).collect()}
    bench = pq.read_table(f"{DATA}/benchmark.parquet")
    hashed = lambda t: decontaminate.token_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tolist()
    docs = {d: hashed(t) for d, t in texts.items() if t}
    grams = {d: {tuple(h[k : k + 5]) for k in range(len(h) - 4)} for d, h in docs.items()}
    want = {}
    for i, t in zip(bench["item_id"].to_pylist(), bench["text"].to_pylist()):
        p = hashed(t)
        mine = [tuple(p[k : k + 5]) for k in range(len(p) - 4)]
        for d, have in grams.items():
            upper = {k + j for k, g in enumerate(mine) if g in have for j in range(5)}  # words that any tile could cover
            if len(p) >= 5 and len(upper) >= decontaminate.THRESHOLD * len(p):
                want[d, i] = len(upper) / len(p)
    assert got.keys() <= want.keys()
    assert all(decontaminate.THRESHOLD <= r.coverage <= want[k] + 1e-12 and r.matched_tokens == round(r.coverage * r.item_tokens) for k, r in got.items())
    # whole items in a text are always found
    assert {k for k, upper in want.items() if upper == 1.0} <= got.keys()


def test_op6_and_op8_are_whole(spark, texts):
    by_doc = {}
    for r in queries.QUERIES["op6_section_tokens"](spark, DATA).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    assert all(sum(r.n_tokens for r in rs) == rs[0].doc_tokens and max(r.end for r in rs) == len(texts[d]) for d, rs in by_doc.items())
    assert {d for d, r in rows_of(spark, "op8_piece_lattice").items() if r.round_trip} == texts.keys()


# ---------------------------------------------------------------- cases that any table may hold

OPERATORS = {
    "op2": repeated_windows.dedup_windows, "op3": lambda d: secrets.find_secrets(d), "op4": suffix_tree.lm_scores, "op5": suffix_arrays.dedup_bytes, "op6": token_counts.section_tokens,
    "op8": lambda d: pieces.encode(d), "op9": near_duplicates.near_duplicates, "op11": lambda d: language.identify(d, language.learn(d)), "op12": fill_middle.fill_in_middle,
}


def awkward(spark, empty=False):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names the operators use themselves."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa. "
    rows = [(1, base * 3, "en"), (2, base * 3, "en"), (2, base * 3, "en"), (3, None, None), (4, "", "en"), (5, " \n", None), (6, "x", "de"), (7, base * 20_000, "en"), (8, "é" * 3000, "fr"), (None, base, "en"), (9, "ends in\r\n", None)]
    d = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string")
    clash = ["source", "n", "key", "h", "row", "b", "ids", "section", "held_out", "score", "word", "draw", "place", "x", "y", "start", "end", "form", "output", "n_words", "kept", "component_id", "u", "v", "stats"]
    return d.select("*", *(F.lit(7).alias(c) for c in clash), F.length("text").cast("long").alias("n_chars"))


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    d = awkward(spark)
    got = OPERATORS[name](d).collect()
    per_row = Counter(r.doc_id for r in got)
    want = Counter([1, 2, 2, 3, 4, 5, 6, 7, 8, None, 9])
    if name == "op6":  # one row for each line
        assert per_row.keys() == want.keys()
    else:
        assert per_row == want
    assert OPERATORS[name](awkward(spark, empty=True)).count() == 0


def test_awkward_stages(spark):
    """Stages keep the columns; of copies that share an id all or none stay; empty tables stay empty."""
    d, none = awkward(spark), awkward(spark, empty=True)
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0), (99, None, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "zeta eta theta iota kappa alpha beta", 5), (2, None, 5), (None, "", 5)], "item_id long, text string, n int")
    stages = {"quality": lambda x: quality.keep_quality(x, labels), "near": near_duplicates.drop_near_duplicates, "leaks": lambda x: decontaminate.drop_contaminated(x, bench), "secrets": secrets.redact_secrets}
    kept = {}
    for name, stage in stages.items():
        out = stage(d)
        assert out.columns == d.columns and stage(none).count() == 0
        kept[name] = sorted((r.doc_id is not None, r.doc_id or 0) for r in out.select("doc_id").collect())
    ids = lambda name: [k for some, k in kept[name] if some]
    assert len(kept["secrets"]) == d.count() and set(ids("near")) == {1, 3, 4, 5, 6, 8, 9}  # 7 has the shingles of 1
    assert {3, 4, 5, 6, 8, 9} <= set(ids("leaks")) and not {1, 2, 7} & set(ids("leaks"))
    assert quality.keep_quality(d, labels.limit(0)).count() == d.count()  # without labels every score is a half


def test_awkward_conversations_and_vectors(spark):
    c = spark.createDataFrame([(1, None, None, None, 1), (None, 1, "user", "x" * 1_000_000, 2), (1, 1, "user", "a.", 3), (1, 1, "user", "a.", 3)], "conv_id long, turn long, role string, text string, audit int")
    assert {r.conv_id for r in conversations.repair(c).collect()} == {1, None}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("x", F.lit(1))
    got = sorted((r.vec_id or 0, r.component_id or 0) for r in embeddings.embedding_links(v).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7)] and embeddings.embedding_links(v.limit(0)).count() == 0
