"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text becomes lower-case letters with one space for all between them; its 1- to 3-grams are
hashed to 2**16 places. A feature is the n-gram's share of the text times its inverse document
frequency, which is counted over all documents that teach. Scores are linear in these, so a
text is scored in one pass, whatever its length.

Weights are learned by follow-the-regularised-leader, each with its own rate, under an elastic
net: the L1 part leaves most of them zero. They learn from about ``per_lang`` documents of each
language (`PER_LANG`, a documented bound; the rows with the smallest hash of their id, whole
texts) of the ``langs`` commonest values of lang (`LANGS`). A fifth of these is kept from the
weights and sets the temperature by which scores are divided, so that they can be read as
probabilities. Of the model only weights other than zero reach the driver.

A null text or one without a letter is ``und`` with score 0, and so is every text if no row
teaches. Rows with a null lang teach nothing; if two languages score alike, the one that sorts
first is taken. Repeated rows are scored, and counted, one by one; a row with a null id is not
held out and teaches. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import crc_mod, table
from ._text import doc_chunks

BITS = 16
PLACES = 1 << BITS
GRAMS = 3
PER_LANG = 600
LANGS = 1000
UNKNOWN = "und"
_SCALE = 100.0  # shares are small; this brings features near 1

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space; made once per worker."""
    if not _LETTER:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                out[c] = ord(s.lower()[0])
        _LETTER.append(out)
    return _LETTER[0]


def grams_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and place of each n-gram of some texts, sorted by document, and whether each document has a letter."""
    rows = len(off) - 1
    wide = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    point = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=point[1:])
    first = point[off]
    x = _letters()[wide]
    doc = np.repeat(np.arange(rows), np.diff(first))
    letter = x != 32
    some = np.bincount(doc[letter], minlength=rows) > 0
    # one space for a run of them, none at the beginning of a text
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (doc[1:] == doc[:-1])
    x, doc = x[keep].astype(np.uint64), doc[keep]
    out = []
    h = np.zeros(len(x), np.uint64)
    for n in range(1, GRAMS + 1):
        size = len(x) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint64(0x9E3779B97F4A7C15) + x[n - 1 :] + np.uint64(n)
        mixed = h ^ (h >> np.uint64(29))
        place = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
        inside = doc[:size] == doc[n - 1 :]
        if n == 1:
            inside &= x != 32
        out.append((doc[:size][inside], place[inside].astype(np.int64)))
    return np.concatenate([d for d, _ in out] or [np.zeros(0, np.int64)]), np.concatenate([p for _, p in out] or [np.zeros(0, np.int64)]), some


# ------------------------------------------------------------------ learning


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts have letters, and how many of these hold each place. Tasks count; 2**16 sums at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(PLACES, np.int64), 0
        held = np.zeros(PLACES, bool)
        for b in batches:
            for _, _, data, off in doc_chunks(b.column(0)):
                doc, place, some = grams_of(data, off)
                n += int(some.sum())
                order = np.argsort(doc, kind="stable")
                place = place[order]
                bound = np.searchsorted(doc[order], np.arange(len(off)))
                for a, z in zip(bound[:-1], bound[1:], strict=True):
                    held[place[a:z]] = True
                    df += held
                    held[place[a:z]] = False
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["place", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = rows["place"].to_numpy(), rows["n"].to_numpy()
    out = np.zeros(PLACES, np.int64)
    out[place[place >= 0]] = n[place >= 0]
    return int(n[place < 0].sum()), out


def inverse(n: int, df: np.ndarray) -> np.ndarray:
    """Inverse document frequencies; of places never seen, zero: no weight belongs to them."""
    return np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0.0)


def features(doc: np.ndarray, place: np.ndarray, rows: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct places and features, one document after the other, and where each begins."""
    key, count = np.unique(doc * PLACES + place, return_counts=True)
    doc, place = key >> BITS, key & (PLACES - 1)
    total = np.maximum(np.bincount(doc, count, rows), 1)
    return place, _SCALE * count / total[doc] * idf[place], np.searchsorted(doc, np.arange(rows + 1))


@dataclass
class Leader:
    """Multinomial follow-the-regularised-leader with per-coordinate rates."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.3
    l2: float = 0.1

    def __post_init__(self):
        self.z, self.n = np.zeros((PLACES, self.classes)), np.zeros((PLACES, self.classes))

    def weights(self, place: np.ndarray) -> np.ndarray:
        z, n = self.z[place], self.n[place]
        far = np.abs(z) > self.l1
        return np.where(far, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, place: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(place)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[place]
        more = n + g * g
        self.z[place] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[place] = more


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """What logits are divided by for the likeliest labels: golden section on its logarithm. 1 without rows."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        top = s.max(1)
        return float((top + np.log(np.exp(s - top[:, None]).sum(1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    for _ in range(40):
        if loss(a) <= loss(b):
            hi, b = b, a
            a = hi - ratio * (hi - lo)
        else:
            lo, a = a, b
            b = lo + ratio * (hi - lo)
    return float(np.exp((lo + hi) / 2))


@dataclass
class Languages:
    """names: sorted. place: the places that have a weight; weight: for each a row of one number a language, its frequency and the temperature included."""

    names: list[str]
    place: np.ndarray
    weight: np.ndarray

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of each text (-1: none) and its probability."""
        doc, place, some = grams_of(data, off)
        rows = len(off) - 1
        if not self.names:
            return np.full(rows, -1), np.zeros(rows)
        slot = np.zeros(PLACES, np.int64)
        slot[self.place] = 1 + np.arange(len(self.place))
        at = slot[place]
        used = at > 0
        total = np.maximum(np.bincount(doc, minlength=rows), 1)
        w = self.weight[at[used] - 1]
        logits = np.column_stack([np.bincount(doc[used], w[:, k], rows) for k in range(len(self.names))]) * (_SCALE / total)[:, None]
        p = softmax(logits)
        best = p.argmax(1)
        return np.where(some, best, -1), np.where(some, p[np.arange(rows), best], 0.0)


def learn(docs: DataFrame, per_lang: int = PER_LANG, langs: int = LANGS, epochs: int = 4, folds: int = 4, held_out: int = 2) -> Languages:
    """The model of docs (doc_id, text, lang) whose crc32(doc_id as text) mod folds is not held_out."""
    spark = docs.sparkSession
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    taught = taught.filter(F.coalesce(crc_mod("doc_id", folds) != held_out, F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in taught.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(langs).collect()}
    if not counts:
        return Languages([], np.zeros(0, np.int64), np.zeros((0, 0)))
    names = sorted(counts)
    idf = inverse(*document_frequencies(taught))
    sent = spark.sparkContext.broadcast(idf)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in doc_chunks(b.column(2)):
                doc, place, some = grams_of(data, off)
                place, x, first = features(doc, place, hi - lo, sent.value)
                first = first.astype(np.int32)
                row = pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(first, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(first, pa.array(x.astype(np.float32)))], names=["draw", "y", "place", "x"])
                yield row.filter(pa.array(some))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for draw, y, place, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                rows.append((draw, y, place.values.to_numpy(), x.values.to_numpy().astype(float)))
        leader = Leader(len(names))
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                draw, y, place, x = rows[k]
                if draw % 5:
                    leader.learn(place, x, y)
        w = leader.weights(np.arange(PLACES))
        kept = [r for r in rows if r[0] % 5 == 0]
        t = temperature(np.array([x @ w[place] for _, _, place, x in kept]), np.array([y for _, y, _, _ in kept], np.int64))
        w *= sent.value[:, None] / t
        place, y = np.nonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(y), pa.array(w[place, y])], names=["place", "y", "w"])

    # about per_lang rows of each language: those whose hash lies below that share of all hashes
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(1 << 40))
    share = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(int(min(1.0, per_lang / counts[k]) * (1 << 40))))])
    number = F.create_map(*[x for k, name in enumerate(names) for x in (F.lit(name), F.lit(k))])
    sample = taught.select(draw.alias("draw"), number[F.col("lang")].alias("y"), "text", share[F.col("lang")].alias("below")).filter("draw < below").drop("below")
    lists = sample.mapInArrow(featured, "draw long, y int, place array<int>, x array<float>")
    one = lists.repartition(1).sortWithinPartitions("draw", "y")  # the bounded sample, in one order whatever its files
    got = one.mapInArrow(fitted, "place long, y long, w double").toArrow()
    place = np.unique(got["place"].to_numpy())
    weight = np.zeros((len(place), len(names)))
    weight[np.searchsorted(place, got["place"].to_numpy()), got["y"].to_numpy()] = got["w"].to_numpy()
    return Languages(names, place, weight)


def identify(docs: DataFrame, model: Languages, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Every row of docs: doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*sent.value.names, UNKNOWN])
        for b in batches:
            for lo, hi, data, off in doc_chunks(b.column(2)):
                best, p = sent.value.predict(data, off)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), names.take(pa.array(best % len(names))), pa.array(p)], names=["doc_id", "held_out", "lang_pred", "score"])

    out = F.coalesce(crc_mod("doc_id", folds) == held_out, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op11_ftrl_languages(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
