"""What the field finds beyond the patterns, and the gradient that it follows."""

import numpy as np

from surveil.llm import secrets as S

DATA = "/root/testdata/sf0.01"


def test_forms_that_no_pattern_knows(spark):
    """Secrets planted in given texts: nine of ten are found, and clean texts are left alone."""
    given = spark.read.parquet(f"{DATA}/documents.parquet")
    field = S.learn(given)
    texts = [r.text for r in given.filter("length(text) between 300 and 1500").orderBy("doc_id").limit(200).collect()]
    clean = [t for t in texts if not S.base_spans(t.encode())]
    rng = np.random.default_rng(5)
    pick = lambda a, n: "".join(rng.choice(list(a), n))
    capital, mixed = "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    forms = [lambda: (pick(capital, 40), ""), lambda: (pick(capital, 32), 'auth => "'), lambda: (pick(mixed, 40), "key: "), lambda: (pick(mixed, 36), "bearer "), lambda: (pick(mixed, 24), ""), lambda: ("ghp_" + pick(mixed, 36), "")]
    rows, where = [], {}
    for k in range(120):
        secret, lead = forms[k % len(forms)]()
        words = clean[k % len(clean)].split(" ")
        words.insert(int(rng.integers(len(words) + 1)), lead + secret)
        text = " ".join(words)
        rows.append((k, text))
        where[k] = (text.index(secret), text.index(secret) + len(secret))
    rows += [(1000 + k, t) for k, t in enumerate(clean)]
    caught = false = 0
    for r in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), field).collect():
        spans = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x]
        a, b = where.get(r.doc_id, (-1, -1))
        touching = [s < b and e > a for s, e in spans]
        caught += any(touching)
        false += touching.count(False)
    assert caught >= 0.9 * len(where) and caught / (caught + false) >= 0.95
    assert S.find_secrets(given, field).agg({"n_crf": "sum"}).first()[0] == 0  # all secrets there are ones that the patterns match


def test_base_spans_by_plain_patterns(spark):
    """base_sha256 of every given text against the contract's patterns, in code points."""
    import hashlib
    import re

    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    given = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in S.find_secrets(given, S.Field()).collect()}
    for r in given.select("doc_id", "text").collect():
        spans = [("assign", m.span()) for m in assign.finditer(r.text) if len(m[2]) >= 12] + [("access", m.span()) for m in re.finditer("AKIA[A-Z0-9]+", r.text) if len(m[0]) >= 18] + [("hex", m.span()) for m in re.finditer("[0-9a-f]+", r.text) if len(m[0]) >= 16]
        spans.sort(key=lambda x: (x[1][0], ("assign", "access", "hex").index(x[0])))
        said = ",".join(f"{k}:{a}:{b}" for k, (a, b) in spans)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[r.doc_id].spans == said
        assert (got[r.doc_id].n_assign, got[r.doc_id].n_access, got[r.doc_id].n_hex) == tuple(sum(k == x for k, _ in spans) for x in ("assign", "access", "hex"))


def test_fit_raises_the_likelihood():
    """A tiny field by its exact likelihood, over all paths."""
    import itertools

    rng = np.random.default_rng(1)
    first = np.array([0, 5, 9, 13])
    tags = np.array([0, 1, 2, 0, 0, 0, 1, 2, 2, 0, 0, 0, 0])
    feats = [np.where(tags > 0, 1, 0) * rng.integers(1, 3, 13) if k == 0 else np.zeros(13, int) for k in range(len(S.N_FEATURES))]

    def likelihood(f):
        total = 0.0
        e = f.scores(feats)
        for a, b in zip(first[:-1], first[1:]):
            value = lambda p, a=a: f.start[p[0]] + sum(e[a + i, t] for i, t in enumerate(p)) + sum(f.move[s, t] for s, t in zip(p, p[1:]))
            total += value(tags[a:b]) - np.log(sum(np.exp(value(p)) for p in itertools.product(range(3), repeat=b - a)))
        return total

    before, after = S.Field(), S.Field()
    after.fit(feats, tags, first, steps=40)
    assert after.taught and likelihood(after) > -0.5 > likelihood(before)
    tagged = after.decode(after.scores(feats), first, np.arange(3))
    assert tagged.tolist() == tags.tolist()
