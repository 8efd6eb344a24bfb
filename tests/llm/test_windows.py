"""Word and byte windows against brute force, with planted repeats, hot minimisers and odd rows."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from surveil.llm import _text as T
from surveil.llm.repeated_windows import dedup_windows
from surveil.llm.suffix_arrays import Cover, cover, dedup_bytes, sort_windows

SCHEMA = "doc_id long, text string, s long, pos long, mini string"


def corpus(seed: int, unit: str = "word"):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdeéñß"), rng.integers(1, 7))) for _ in range(60)]
    make = lambda n: " ".join(rng.choice(vocab, n))
    passage, other = make(80), make(64)
    rows = [(k, f"{make(int(rng.integers(0, 90)))} {passage} {make(int(rng.integers(0, 60)))}", 1, 2, "x") for k in range(40)]
    rows += [(100 + k, f"{make(30)}\n\n{other}\t{make(20)}  {passage[: 20 + k]}", 1, 2, "x") for k in range(30)]
    rows += [(200, "a " * 400, 1, 2, "x"), (201, "a " * 300, 1, 2, "x"), (202, "", 1, 2, "x"), (203, None, 1, 2, "x"), (204, "   \n ", 1, 2, "x")]
    rows += [(None, f"{passage} {make(5)}", 1, 2, "x"), (5, f"{other} {make(9)}", 1, 2, "x"), (3, rows[3][1], 1, 2, "x")]
    return rows


def brute_words(rows, k):
    last = 1 << 62
    least = {}
    cut = lambda t: (t or "").encode().split()
    for d, t, *_ in rows:
        w = cut(t)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            least[key] = min(least.get(key, last + 1), last if d is None else d)
    out = []
    for d, t, *_ in rows:
        w = cut(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if least[tuple(w[i : i + k])] < (last if d is None else d):
                gone[i : i + k] = [True] * k
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def brute_bytes(rows, k):
    n = defaultdict(int)
    raws = [(d, (t or "").encode()) for d, t, *_ in rows]
    for _, r in raws:
        for i in range(len(r) - k + 1):
            n[r[i : i + k]] += 1
    out = []
    for d, r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - k + 1):
            if n[r[i : i + k]] > 1:
                gone[i : i + k] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(r), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [50_000, 4])
def test_word_windows(spark, hot):
    rows = corpus(1)
    got = dedup_windows(spark.createDataFrame(rows, SCHEMA), k=12, m=3, hot_runs=hot).collect()
    assert sorted(map(tuple, got), key=str) == brute_words(rows, 12)


@pytest.mark.parametrize("hot,k", [(50_000, 60), (4, 60), (50_000, 240)])
def test_byte_windows(spark, hot, k):
    rows = corpus(2)
    got = dedup_bytes(spark.createDataFrame(rows, SCHEMA), k=k, m=8, hot_runs=hot).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute_bytes(rows, k)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dedup_windows(none).count() == 0
    assert dedup_bytes(none).count() == 0


def test_covers():
    for r in (0, 1, 2):
        v, at = cover(r)
        assert len(at) == 6 * r + 4
        assert {(int(a) - int(b)) % v for a in at for b in at} == set(range(v))
    c = Cover(1)
    for a in range(0, 73, 7):
        for b in range(73):
            assert c.held[(a + c.shift[a, b]) % 73] and c.held[(b + c.shift[a, b]) % 73]


@pytest.mark.parametrize("k", [39, 40, 55, 100, 218, 219, 290, 400, 500, 640])
def test_sorted_windows_group_equal_ones(k):
    rng = np.random.default_rng(k)
    base = rng.integers(97, 99, 900).astype(np.uint8)
    parts = [base.copy() for _ in range(6)]
    for p in parts:
        p[rng.integers(0, 900, 2)] = 120
    text = np.concatenate(parts)
    start = np.concatenate([np.arange(900 - k + 1) + 900 * j for j in range(6)])
    order, group = sort_windows(text, start, k)
    raw = text.tobytes()
    seen = {}
    for i, g in zip(order.tolist(), group.tolist()):
        assert seen.setdefault(raw[start[i] : start[i] + k], g) == g
    assert len(set(seen.values())) == len(seen)


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    texts = ["a b", "", None, " x y z \t\x0b\x0cq\r\n", "é ñ", "\x1c\x1d a"]
    data, off = T.text_bytes(pa.array(texts))
    w = T.words_of(data, off)
    for d, t in enumerate(texts):
        got = [w.data[w.start[i] : w.end[i]].tobytes() for i in range(w.first[d], w.first[d + 1])]
        assert got == (t or "").encode().split()
    h = w.hashes()
    assert len(set(h.tolist())) == len({w.data[a:b].tobytes() for a, b in zip(w.start, w.end)})
