"""Secret scans: fixed patterns plus a linear-chain conditional random field.

A text is cut into tokens: runs of ASCII letters, digits and ``_+/-.`` and of
non-ASCII bytes, and single other characters. The field tags each token as
begin, inside or outside of a secret from its shape (length, kinds of
characters, switches between digits and letters, hexadecimal digits only, first
bytes), its neighbours (the two tokens before and the one after, how long ago
a word such as ``password`` came) and features of the whole file (shares of
symbols and of assignments, whether such a word occurs), decoded by Viterbi over the whole text.

The field learns from the spans of the patterns, on at most SAMPLE_ROWS documents of at
most SAMPLE_CHARS characters: the rows with the smallest hash of id and text, so the
same documents give the same field. Those with spans teach twice, the second time without
the features of neighbours and telling words, so that the shape of a secret counts where no such word stands by it, and then in
forms that the patterns do not know: capital letters, letters and digits of all kinds, other words in the place of the telling ones.
Stretches without a secret teach in turns, a part of them in each step, so that all of them teach in the time of a few. What the field
adds are spans of MIN_SPAN bytes or more that touch none of the patterns' spans. Scanning itself covers all rows
and whole texts and moves no row.

Null and empty texts have no spans. Repeated rows give repeated rows; other columns are
ignored. Without any secret to learn from the field tags nothing.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import table
from ._text import LOWER, doc_chunks, spread

SAMPLE_ROWS, SAMPLE_CHARS, MIN_SPAN = 1500, 8000, 12
KINDS = ("assign", "access", "hex", "crf")

#: The patterns of the base spans.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

# ---------------------------------------------------------------- patterns


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_HEX = _class(b"0123456789abcdef")


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of all fixed patterns of one text, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found)


def may_match(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that a fixed pattern could match: those with one of its words or a long hexadecimal run."""
    low = LOWER[data].tobytes()
    at = []
    for w in (*WORDS, b"akia"):
        k = low.find(w)
        while k >= 0:
            at.append(k)
            k = low.find(w, k + 1)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _HEX[data]
    turn = np.flatnonzero(np.diff(inside))
    at = np.concatenate([np.array(at, np.int64), turn[::2][turn[1::2] - turn[::2] >= 16]])
    rows = np.zeros(len(off) - 1, bool)
    rows[np.searchsorted(off, at, "right") - 1] = True  # a run over two texts marks a row too many, which does no harm ...
    if len(at):  # ... if the later text is marked as well
        rows[np.searchsorted(off, np.minimum(at + 15, len(data) - 1), "right") - 1] = True
        long = np.flatnonzero(turn[1::2] - turn[::2] >= 16)
        for s, e in zip(turn[::2][long].tolist(), turn[1::2][long].tolist()):
            rows[np.searchsorted(off, s, "right") - 1 : np.searchsorted(off, e - 1, "right")] = True
    return rows


# ---------------------------------------------------------------- features

_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 part of a word, 2 stands alone
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+/-.")] = 1
_KIND[128:] = 1
_TRAITS = np.stack([_class(b"0123456789"), _class(b"abcdefghijklmnopqrstuvwxyz"), _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class(b"_+/-."), _class(b"0123456789abcdefABCDEF")]).astype(np.uint8)
_LENGTHS = np.array([1, 2, 4, 8, 12, 16, 24, 32, 48])
L = len(_LENGTHS) + 1
N_FEATURES = (L * 16, 8 * 8, L * 2, 257, 10 * L, 200, 10 * L, 6 * L, 32 * L)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all tokens, and each row's first one."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    word = kind == 1
    begin = word & (np.append(True, ~word[:-1]) | edge[:-1]) | (kind == 2)
    stop = word & (np.append(~word[1:], True) | edge[1:]) | (kind == 2)
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(stop) + 1, np.searchsorted(start, off)


def features(data: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, hide: bool = False) -> list[np.ndarray]:
    """One small number per token and template. hide: as if each token stood alone and there were no telling words."""
    n = len(start)
    size = end - start
    bucket = np.searchsorted(_LENGTHS, size, "right").astype(np.int32)
    held = np.stack([np.add.reduceat(t[data], start, dtype=np.int32) for t in _TRAITS])  # spaces count for none
    shape = (held[:4] > 0).T @ np.array([1, 2, 4, 8])
    digit = _TRAITS[0][data]
    letter = _TRAITS[1][data] | _TRAITS[2][data]
    switch = np.zeros(len(data), np.uint8)
    switch[1:] = (digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1])
    switch[start] = 0
    switches = np.add.reduceat(switch, start, dtype=np.int32)
    hexed = (held[4] == size) & (held[0] > 0)
    head = np.zeros(n, np.int64)
    long = np.flatnonzero(size >= 8)
    for k in range(4):
        head[long] = head[long] * 131 + LOWER[data[start[long] + k]]
    head[long] = 1 + head[long] % 256
    lead = data[start]
    role = np.full(n, 1, np.int32)  # 1 other sign, 2 '=', 3 ':', 4 quote, 5 plain word, 6 with digits, 7 long with digits, 8 a telling word
    role[lead == ord("=")] = 2
    role[lead == ord(":")] = 3
    role[(lead == ord('"')) | (lead == ord("'"))] = 4
    word = _KIND[lead] == 1
    role[word] = 5
    role[word & (held[0] > 0)] = 6
    role[word & (held[0] > 0) & (size >= 12)] = 7
    short = np.flatnonzero((size >= 5) & (size <= 24))
    key = np.zeros(n, bool)
    low = LOWER[data].tobytes()
    hit = np.zeros(len(data) + 1, bool)
    for w in () if hide else WORDS:
        k = low.find(w)
        while k >= 0:
            hit[k] = True
            k = low.find(w, k + 1)
    at = np.searchsorted(start, np.flatnonzero(hit), "right") - 1
    key[at[at >= 0]] = True
    key &= np.isin(np.arange(n), short)
    role[key] = 8
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def near(step: int) -> np.ndarray:
        """The role of the token so far off, 9 beyond the text."""
        out = np.full(n, 9, np.int32)
        if hide:
            return out
        if step < 0:
            out[-step:] = np.where(row[-step:] == row[:step], role[:step], 9)
        else:
            out[:-step] = np.where(row[step:] == row[:-step], role[step:], 9)
        return out

    since = np.arange(n) - np.maximum.accumulate(np.where(key, np.arange(n), -10))
    since = np.where((since <= 5) & (since > 0) & (row == row[np.maximum(np.arange(n) - since, 0)]), since, 0)
    docs = len(first) - 1
    count = np.maximum(np.diff(first), 1)
    signs = np.bincount(row, ~word, docs) / count
    assigns = np.bincount(row, role == 2, docs) / count
    file = np.minimum((signs * 16).astype(int), 3) * 8 + np.minimum((assigns * 64).astype(int), 3) * 2 + (np.bincount(row, key, docs) > 0)
    return [bucket * 16 + shape, np.minimum(held[0] * 8 // np.maximum(size, 1), 7) * 8 + np.minimum(switches, 7), bucket * 2 + hexed, head, near(-1) * L + bucket, (near(-2) * 10 + near(-1)) * 2 + (role == 7), near(1) * L + bucket, since * L + bucket, file[row] * L + bucket]


# ---------------------------------------------------------------- the field

O, B_, I_ = 0, 1, 2
_NEVER = -1e9


class Field:
    """Weights of the field: per template a value x tag table, tag transitions, and starts."""

    def __init__(self):
        self.emit = [np.zeros((n, 3)) for n in N_FEATURES]
        self.move = np.zeros((3, 3))
        self.move[O, I_] = _NEVER
        self.start = np.array([0.0, 0.0, _NEVER])
        self.taught = False

    def scores(self, feats: list[np.ndarray]) -> np.ndarray:
        out = self.emit[0][feats[0]]
        for w, f in zip(self.emit[1:], feats[1:]):
            out += w[f]
        return out

    def fit(self, feats: list[np.ndarray], tags: np.ndarray, first: np.ndarray, more: tuple | None = None, steps: int = 60, rate: float = 0.4, l2: float = 1e-5, piece: int = 64, plain_tokens: int = 40_000) -> None:
        """Maximise the conditional likelihood of the tags by gradient ascent; texts are cut to pieces of that many tokens.

        Each step takes all pieces with a secret and an equal part of the others, about plain_tokens, which count for all of them. more: features, tags
        and firsts of varied texts, of which only pieces with a secret are taken.
        """
        n = len(tags)
        if more is not None:
            feats, first = [np.concatenate(x) for x in zip(feats, more[0])], np.append(first, n + more[2][1:])
            tags = np.concatenate([tags, more[1]])
        cuts = np.concatenate([np.arange(a, b, piece) for a, b in zip(first[:-1], first[1:])] or [np.zeros(0, int)])
        if not len(cuts) or not (tags != O).any():
            return
        self.taught = True
        size = np.diff(np.append(cuts, len(tags)))
        secret = np.add.reduceat(tags != O, cuts) > 0
        plain = np.flatnonzero(~secret & (cuts < n))
        parts = int(max(1, -(-int(size[plain].sum()) // plain_tokens)))
        batches = []
        for k in range(parts):
            of = np.concatenate([np.flatnonzero(secret), plain[k::parts]])
            of = of[np.argsort(-size[of], kind="stable")]
            group, place = spread(size[of])
            token = cuts[of][group] + place
            worth = np.where(secret[of], 1.0, parts)
            here = np.cumsum(size[of]) - size[of]
            y, w = tags[token], worth[group]
            gold = np.zeros((len(token), 3))
            gold[np.arange(len(token)), y] = w
            at = np.flatnonzero(place > 0)
            pairs = np.zeros((3, 3))
            np.add.at(pairs, (y[at - 1], y[at]), w[at])
            live = [int((size[of] > t).sum()) for t in range(int(size[of[0]]))]
            batches.append(([f[token] for f in feats], gold, w[:, None], here, live, at, pairs))
        weights = [*self.emit, self.move, self.start]
        mean, var = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        m = int(secret.sum()) + len(plain)

        for step in range(1, steps + 1):
            held, gold, worth, cut, live, at, pairs = batches[step % parts]
            n = len(gold)
            e = self.scores(held)
            e = np.exp(e - e.max(1, keepdims=True))  # scaled to sum to 1 at each token, so nothing underflows
            move = np.exp(self.move)
            fwd, bwd = np.empty((n, 3)), np.ones((n, 3))
            fwd[cut] = np.exp(self.start) * e[cut]
            fwd[cut] /= fwd[cut].sum(1, keepdims=True)
            for t in range(1, len(live)):
                here = cut[: live[t]] + t
                a = (fwd[here - 1] @ move) * e[here]
                fwd[here] = a / a.sum(1, keepdims=True)
            for t in range(len(live) - 1, 0, -1):
                here = cut[: live[t]] + t
                b = (e[here] * bwd[here]) @ move.T
                bwd[here - 1] = b / b.sum(1, keepdims=True)
            prob = fwd * bwd
            prob *= worth / prob.sum(1, keepdims=True)
            after = e[at] * bwd[at]
            weight = worth[at] / ((fwd[at - 1] @ move) * after).sum(1, keepdims=True)
            both = ((fwd[at - 1] * weight).T @ after) * move
            diff = gold - prob
            grads = [np.stack([np.bincount(f, diff[:, k], len(w)) for k in range(3)], 1) for f, w in zip(held, self.emit)]
            grads += [pairs - both, diff[cut].sum(0)]
            for w, g, m1, m2 in zip(weights, grads, mean, var):
                g = g / m - l2 * np.where(w > _NEVER / 2, w, 0)
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                w += np.where(w > _NEVER / 2, rate * 0.5 * (1 + np.cos(np.pi * step / steps)) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8), 0)

    def suspects(self, e: np.ndarray) -> np.ndarray:
        """Tokens without which tagging all as outside is the best path: two moves can gain no more than this."""
        top = max(self.move.max(), self.start.max())
        return e[:, 1:].max(1) - e[:, O] + 2 * (top - min(self.move[O, O], self.start[O])) >= 0

    def decode(self, e: np.ndarray, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The best tags of the tokens of the given rows by Viterbi; others stay outside."""
        tags = np.zeros(len(e), np.int8)
        size = (first[1:] - first[:-1])[rows]
        rows, size = rows[o := np.argsort(-size, kind="stable")], size[o]
        at0 = first[rows]
        if not len(rows):
            return tags
        back = np.zeros((len(e), 3), np.int8)
        live = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        best = self.start + e[at0]
        last = np.zeros((len(rows), 3))
        for t in range(1, int(size[0])):
            k = live[t]
            if k < len(best):
                last[k : len(best)] = best[k:]
            at = at0[:k] + t
            via = best[:k, :, None] + self.move
            back[at] = via.argmax(1)
            best = via.max(1) + e[at]
        last[: len(best)] = best
        now = last.argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            k = live[t]
            at = at0[:k] + t
            tags[at] = now[:k]
            if t:
                now[:k] = back[at, now[:k]]
        return tags


_LETTERS = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
_MIXED = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz01234567890123456789", np.uint8)


def varied(text: np.ndarray, spans: list[tuple[int, int, int]], form: int, rng: np.random.Generator) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A text with its secrets in another form, and where they are then: 0 in capitals, 1 of letters of both cases and digits, cut off at some length, the rest a word. Telling words become other words."""
    out, places = text.copy(), []
    for s, kind, e in spans:
        if kind == 0:
            m = ASSIGN.match(text[s:e].tobytes())
            out[s : s + m.end(1)] = rng.choice(_LETTERS, m.end(1))
            s += m.start(2)
        part = out[s:e]
        if form == 0:
            out[s:e] = np.where((part >= 97) & (part <= 122), part - 32, part)
        else:
            out[s:e] = rng.choice(_MIXED, e - s)
            if e - s > 20:
                end = s + int(rng.integers(16, e - s))
                out[end:e] = rng.choice(_LETTERS, e - end)
                out[end] = 32
                e = end
        places.append((s, 1, e))
    return out, places


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Field:
    rows = max(1, docs.count())
    most = min(2**63 - 1, -(2**63) + int(2**64 * 1.5 * sample_rows / rows))  # hashes beyond this one are not among the smallest sample_rows
    few = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text")).filter((F.col("h") <= most) & (F.length("text") <= sample_chars))
    texts = few.orderBy("h", "text").limit(sample_rows).select("text").toArrow()["text"]
    field = Field()
    seen, extra = ([], [], []), ([], [], [])
    rng = np.random.default_rng(0)

    def teach(data: np.ndarray, off: np.ndarray, spans: list, hide: bool, to: tuple) -> None:
        feats, tags, sizes = to
        start, end, first = tokens(data, off)
        if not len(start):
            return
        raw, y = data.tobytes(), np.zeros(len(start), np.int64)
        for d, found in enumerate(spans):
            a, b = first[d], first[d + 1]
            sizes.append(int(b - a))
            for s, kind, e in found:
                if kind == 0:
                    s = ASSIGN.match(raw[off[d] + s : off[d] + e]).start(2) + s
                inside = np.flatnonzero((start[a:b] < off[d] + e) & (end[a:b] > off[d] + s)) + a
                if len(inside) and not y[inside].any():
                    y[inside] = I_
                    y[inside[0]] = B_
        feats.append([f.astype(np.int32) for f in features(data, off, start, end, first, hide)])
        tags.append(y)

    for _, _, data, off in doc_chunks(texts):
        raw = [data[a:b] for a, b in zip(off[:-1], off[1:])]
        spans = [base_spans(x.tobytes()) if maybe else [] for x, maybe in zip(raw, may_match(data, off).tolist())]
        teach(data, off, spans, False, seen)
        if some := [k for k, x in enumerate(spans) if x]:
            which, places = [spans[k] for k in some], np.append(0, np.cumsum([len(raw[k]) for k in some]))
            teach(np.concatenate([raw[k] for k in some]), places, which, True, seen)
            for form in (0, 1):
                other = [varied(raw[k], spans[k], form, rng) for k in some]
                for hide in (False, True):
                    teach(np.concatenate([x for x, _ in other]), places, [x for _, x in other], hide, extra)
    joined = lambda x: ([np.concatenate(f) for f in zip(*x[0])], np.concatenate(x[1]), np.append(0, np.cumsum(x[2])))
    if seen[2]:
        field.fit(*joined(seen), more=joined(extra) if extra[2] else None)
    return field


def scan(data: np.ndarray, off: np.ndarray, field: Field, min_span: int = MIN_SPAN) -> dict[int, list[tuple[int, int, int]]]:
    """row -> sorted (start, kind, end) in bytes, for rows with any span."""
    raw = data.tobytes()
    out = {}
    for d in np.flatnonzero(may_match(data, off)).tolist():
        found = base_spans(raw[off[d] : off[d + 1]])
        if found:
            out[d] = found
    start, end, first = tokens(data, off)
    if not field.taught or not len(start):
        return out
    e = field.scores(features(data, off, start, end, first))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    tags = field.decode(e, first, np.unique(row[field.suspects(e)]))
    for t in np.flatnonzero(tags == B_).tolist():
        last = t
        while last + 1 < first[row[t] + 1] and tags[last + 1] == I_:
            last += 1
        d = int(row[t])
        a, b = int(start[t] - off[d]), int(end[last] - off[d])
        if b - a >= min_span and all(b <= s or a >= x for s, k, x in out.get(d, ()) if k < 3):
            out.setdefault(d, []).append((a, 3, b))
    return {d: sorted(x) for d, x in out.items()}


def _points(text: bytes, spans: list) -> list[tuple[int, int, int]]:
    """Byte places as code points."""
    if text.isascii():
        return spans
    count = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    return [(int(count[s]), k, int(count[e])) for s, k, e in spans]


def find_secrets(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf."""
    sent = docs.sparkSession.sparkContext.broadcast(field or learn(docs, id_col, text_col))
    say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for b in batches:
            for lo, hi, data, off in doc_chunks(b.column(1)):
                n = hi - lo
                counts, sha, text = np.zeros((4, n), np.int64), [none] * n, [""] * n
                for d, spans in scan(data, off, sent.value).items():
                    spans = _points(data[off[d] : off[d + 1]].tobytes(), spans)
                    for _, k, _ in spans:
                        counts[k, d] += 1
                    sha[d] = hashlib.sha256(say([x for x in spans if x[1] < 3]).encode()).hexdigest()
                    text[d] = say(spans)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), *map(pa.array, counts[:3]), pa.array(sha), pa.array(text), pa.array(counts[3])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def op3_secret_field(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def redact_secrets(docs: DataFrame, mask: str = "<SECRET>") -> DataFrame:
    """docs with every span replaced by the mask, and n_chars, if there is such a column, to match; no row is dropped. Null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs))
    schema, place, size = docs.schema, docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            for lo, hi, data, off in doc_chunks(b.column(place), 1 << 21):
                part = b.slice(lo, hi - lo)
                found = scan(data, off, sent.value)
                if found:
                    texts = part.column(place).to_pylist()
                    sizes = part.column(size).to_pylist() if size is not None else [0] * len(texts)
                    for d, spans in found.items():
                        raw, out, at = data[off[d] : off[d + 1]].tobytes(), [], 0
                        for s, _, e in spans:
                            if e > at:
                                if s >= at:
                                    out += [raw[at:s], mask.encode()]
                                at = e
                        texts[d] = b"".join([*out, raw[at:]]).decode()
                        sizes[d] = len(texts[d])
                    part = part.set_column(place, part.schema.field(place), pa.array(texts, part.column(place).type))
                    if size is not None:
                        part = part.set_column(size, part.schema.field(size), pa.array(sizes, part.column(size).type))
                yield part

    return docs.mapInArrow(run, schema)
