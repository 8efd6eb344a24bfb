"""Language identification, fill-in-the-middle and conversation repair."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from surveil.llm import _text as T
from surveil.llm import conversations as C
from surveil.llm import fill_middle as M
from surveil.llm import language as L

DATA = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def same_as_sql(df, sql, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want = con.execute(sql)
    cols = sorted(c[0] for c in want.description)
    assert sorted(df.columns) == cols
    place = [[c[0] for c in want.description].index(c) for c in cols]
    rows = sorted(tuple(r[k] for k in place) for r in want.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == rows and rows


# ---------------------------------------------------------------- fill in the middle


def fim_by_hand(doc_id, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    x = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_hand(spark):
    rng = np.random.default_rng(1)
    bits = [" ", "\n", "\t\x0b", "a", "é漢", "<P", "S>", "<", "<M>", "\x00", " ", "word", "𝒳", "\x1c", "."]
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(300)] + [None, "", " ", "  \n", "x", "x ", "one two <S> three", "long " * 200_000]
    rows = [(k, t, 1, "a", "b") for k, t in enumerate(texts)] + [(None, "null id here " * 9, 1, "a", "b"), (3, texts[3], 1, "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, output string, h1 string")
    got = M.fill_in_middle(docs).withColumn("back", M.restored(M.F.col("output"), M.F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((d, *fim_by_hand(d, t), t or "") for d, t, *_ in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_query(spark):
    same_as_sql(M.op12_fill_in_middle(spark, DATA), M.OP12_SQL, "documents")


# ---------------------------------------------------------------- conversations


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repaired_by_hand(rows):
    """All edits of one conversation, tried one by one from the front, the cheapest kept by (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha(r[3])))
    seen, faults = set(), []
    for _, _, role, text in rows:
        tail = text.strip(" \t\n\x0b\f\r")
        faults.append(1 if not tail else 2 if (role, text) in seen else 3 if tail[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    lawful = re.compile("(s?(ua)+)?")
    # what may follow, and the cheapest way there: (initials so far as a state) -> (cost, audit, lines)
    best = {"": (0, "", [])}

    def state(initials):
        return initials if len(initials) <= 1 else initials[-1] if initials[-1] != "a" else "ua"

    def put(table, initials, way):
        if not any(lawful.fullmatch(initials + rest) for rest in ("", "ua", "a")):
            return False
        k = state(initials)
        if k not in table or way[:2] < table[k][:2]:
            table[k] = way
            return True
        return False

    def inserts(table):
        todo = list(table)
        while todo:
            k = todo.pop()
            c, a, lines = table[k]
            for role in ("user", "assistant"):
                if put(table, k + role[0], (c + 3, a + "I", [*lines, f"{role}:"])):
                    todo.append(state(k + role[0]))

    for (_, _, role, text), fault in zip(rows, faults):
        inserts(best)
        after = {}
        late = 3 if fault == 3 else 0
        for k, (c, a, lines) in best.items():
            put(after, k, (c + 4, a + "D", lines))
            if fault not in (1, 2):
                if role:
                    put(after, k + role[0], (c + late, a + "K", [*lines, f"{role}:{text}"]))
                for new in ("user", "assistant"):
                    put(after, k + new[0], (c + 3 + late, a + "R", [*lines, f"{new}:{text}"]))
        best = after
    inserts(best)
    cost, audit, lines = min((best[k] for k in ("", "ua") if k in best), key=lambda w: w[:2])
    n = Counter(faults)
    return gaps, n[1], n[2], n[3], illegal, cost, audit, sha("\n".join(lines))


def test_least_audit_by_every_edit():
    """The automaton against all edits of all short signatures; at most two rows are inserted at one place."""
    lawful = re.compile("(s?(ua)+)?")
    symbols = [ord(c) for c in "xsuaoSUA"]

    def every(signature):
        ways = [(0, "", "")]
        for k in range(len(signature) + 1):
            ways = [(c + 3 * len(i), a + "I" * len(i), s + "".join(i)) for c, a, s in ways for n in range(3) for i in itertools.product("ua", repeat=n)]
            if k < len(signature):
                x = chr(signature[k])
                late = 3 if x.isupper() else 0
                more = [(c + 4, a + "D", s) for c, a, s in ways]
                if x != "x":
                    more += [(c + late, a + "K", s + x.lower()) for c, a, s in ways] + [(c + 3 + late, a + "R", s + r) for c, a, s in ways for r in "ua"]
                ways = [w for w in more if w[0] <= 4 * len(signature)]
        return min((c, a) for c, a, s in ways if lawful.fullmatch(s))

    automaton = C.Automaton()
    todo = [bytes(s) for n in range(4) for s in itertools.product(symbols, repeat=n)]
    for s in sorted(todo, key=lambda s: s[::-1]):
        assert automaton.repair(s) == every(s), s
    assert len(automaton.steps) < 400
    rng = np.random.default_rng(3)
    for s in (bytes(rng.choice(symbols, 200).astype(np.uint8)) for _ in range(20)):  # in any order
        assert automaton.repair(s) == C.Automaton().repair(s)


def test_repair_against_hand(spark):
    rng = np.random.default_rng(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "ubuntu"], ["Yes.", "no", "", " \n", "Why?!  ", None, "é…", "a.b", " "]
    rows = []
    for conv in [*range(60), None]:
        for k in range(rng.integers(1, 9)):
            rows.append((conv, None if rng.random() < 0.1 else int(k + 3 * (rng.random() < 0.1)), roles[rng.choice(7, p=[0.35, 0.35, 0.08, 0.07, 0.05, 0.05, 0.05])], str(rng.choice(texts[:5])) if rng.random() < 0.7 else texts[rng.integers(9)]))
    rows += [(100, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(3000)]
    rows += [(101, 5, "user", "same again.")] * 40
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, kind int, audit string").repartition(7)
    want = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = damaged_by_hand([r for r in rows if r[0] == conv])
        want[conv] = repaired_by_hand(mine) if mine else (0, 0, 0, 0, 0, 0, "", sha(""))
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(df).collect()}
    assert got == want
    lines = {}
    for r in sorted(C.repaired_rows(df).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(sha("\n".join(lines.get(c, []))) == w[-1] for c, w in want.items())
    assert C.repair(df.limit(0)).count() == 0 and C.repaired_rows(df.limit(0)).count() == 0


def test_repair_across_batches(spark):
    rows = [(k // 50, k % 50, ("user", "assistant")[k % 2], f"turn {k}." if k % 7 else "cut") for k in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.conv_id: tuple(r)[1:] for r in C.repair(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == {c: repaired_by_hand(damaged_by_hand([r for r in rows if r[0] == c])) for c in range(10)}


def test_repair_query(spark):
    same_as_sql(C.op13_suffix_automaton(spark, DATA), C.OP13_SQL, "conversations")


# ---------------------------------------------------------------- languages


def test_grams():
    texts = ["Añb  ,c", "", "12", "xY"]
    data, off = T.text_bytes(pa.array(texts))
    doc, place, some = L.grams_of(data, off)
    assert some.tolist() == [True, False, False, True]
    for k, t in enumerate(["añb c", None, None, "xy"]):
        grams = [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)] if t else []
        grams = [g for g in grams if g != " "]
        assert (doc == k).sum() == len(grams)
        one, off1 = T.text_bytes(pa.array([t or ""]))
        assert sorted(place[doc == k]) == sorted(L.grams_of(one, off1)[1])
    assert len({int(p) for p in place[doc == 0]}) == len(set("añbc")) + len(["añ", "ñb", "b ", " c"]) + len(["añb", "ñb ", "b c"])


def test_leader_follows_its_formula():
    rng = np.random.default_rng(2)
    f, z, n = L.Leader(3), np.zeros((5, 3)), np.zeros((5, 3))
    for _ in range(50):
        place, x, y = np.array([0, 2, 4]), rng.random(3) * 3, int(rng.integers(3))
        w = np.zeros((5, 3))
        for i in range(5):
            for k in range(3):
                if abs(z[i, k]) > f.l1:
                    w[i, k] = -(z[i, k] - np.sign(z[i, k]) * f.l1) / ((f.beta + n[i, k] ** 0.5) / f.alpha + f.l2)
        s = [sum(x[j] * w[i, k] for j, i in enumerate(place)) for k in range(3)]
        p = np.exp(s) / np.exp(s).sum()
        for j, i in enumerate(place):
            for k in range(3):
                g = (p[k] - (k == y)) * x[j]
                sigma = ((n[i, k] + g * g) ** 0.5 - n[i, k] ** 0.5) / f.alpha
                z[i, k] += g - sigma * w[i, k]
                n[i, k] += g * g
        f.learn(place, x, y)
    assert np.allclose(f.z[:5], z) and np.allclose(f.n[:5], n) and not f.weights(np.array([1, 3])).any()


def test_temperature_is_the_likeliest():
    rng = np.random.default_rng(3)
    s = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=p) for p in L.softmax(s)])
    assert abs(np.log(L.temperature(s * 3, y) / 3)) < 0.1
    assert L.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_document_frequencies(spark, given):
    texts = [r.text for r in given.select("text").limit(20).collect()] + [None, "77"]
    n, df = L.document_frequencies(spark.createDataFrame([(t, 1) for t in texts], "text string, n int").repartition(3))
    want = Counter(p for t in texts for p in set(L.grams_of(*T.text_bytes(pa.array([t or ""])))[1].tolist()))
    assert n == 20 and {int(k): int(df[k]) for k in np.flatnonzero(df)} == want


def test_languages(spark, given):
    """Held-out accuracy; and what has no answer."""
    rows = L.op11_ftrl_languages(spark, DATA).collect()
    truth = {r.doc_id: r.lang for r in given.select("doc_id", "lang").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in out]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    model = L.learn(given)
    odd = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "12 -- ! ", 0.0), (4, "the and of that " * 300_000, 0.0), (5, "漢字", 0.0), (None, "the and", 0.0), (5, "漢字", 0.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in L.identify(odd, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4)] == ["und", "und", "und", "en"] and [got[k].score for k in (1, 2, 3)] == [0, 0, 0]
    assert got[5].lang_pred in model.names and not got[None].held_out
    assert L.identify(odd.limit(0), model).count() == 0


def test_held_out_rows_and_null_labels_teach_nothing(spark):
    en, xx = "the house of that man and the tree", "zqzq vkvk zqvk jjqz"
    rows = []
    for k in range(200):
        held = zlib.crc32(str(k).encode()) % 4 == 2
        rows.append((k, xx if held else en, "xx" if held else "en"))
    rows += [(1000 + k, xx, None) for k in range(20)]
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ["en"]
    bare = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in L.identify(bare, L.learn(bare)).collect()] == [(1, zlib.crc32(b"1") % 4 == 2, "und", 0.0)]


def test_the_sample_is_bounded_and_spread(spark, monkeypatch):
    rows = [(k, f"alpha beta {k}" if k % 10 else f"gamma delta {k}", "aa" if k % 10 else "bb") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(docs, per_lang=50)
    got = {r.doc_id: r.lang_pred for r in L.identify(docs, model).collect()}
    assert all(got[k] == lang for k, _, lang in rows)
