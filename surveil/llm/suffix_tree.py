"""LM scoring with a probabilistic suffix tree over words.

A text is its words, lower-cased (A-Z), then one end symbol. The root of the tree is the add-one
unigram model: (c + 1) / (N + V + 1) of a word that occurs c times among N training symbols of which V are distinct.
Other states are all contexts of up to DEPTH preceding words (one end symbol stands before a text). A context is kept if its next-word counts
diverge from what its parent (the context without its first word) predicts by more than `gain` nats. The next words that follow it LEAST times or
more are listed. With b the smoothing weight, P(w | s) = (n(s, w) if listed + (n(s) - listed + b) P(w | parent)) / (n(s) + b), which sums to
one. A word is scored in the longest kept suffix of what precedes it.

No context or next word is left out, however rare. How one is counted follows from its share of all positions, which never changes a score:

1. Contexts of more than one in HOT_CONTEXTS positions and their next words of more than one in HOT_CELLS are counted level by level and sent to all
   tasks, like the COMMON commonest words. Their number is bounded whatever the corpus.
2. Places with another next word of such a context, or with a word that is not common, are dealt by that pair, or word, and counted where they meet;
   sums over them complete the divergence of the sent contexts.
3. Places with a context that is not sent are dealt by the shortest such one. All longer contexts of these places meet in the same bucket, which
   tests and scores them. A group of it holds at most one in HOT_CONTEXTS places and no more than BUCKET, up to MOST_CONTEXTS times BUCKET places in all.

A context that occurs too seldom to diverge by more than `gain`, whatever follows it (`_never`: up to twice by default), is never kept. So neither is one with a word
that occurs no more often: a place goes no further than that, and travels without such words.

Places travel packed by columns. Each bucket adds up what it finds for a row, and the rows' sums are added in one last shuffle.

`contexts` and `cells`, if given, leave out contexts, and next words of longer ones, of one in so many positions or less.
Null and empty texts are one end symbol. A null id counts as training. Repeated rows count and are scored one by one.
Without training text all probabilities are 1 (N = V = 0). Other columns are ignored. Words and contexts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import crc_mod, cut, shuffle_parts, table
from ._text import LOWER, doc_chunks, mix64, words_of
from ._windows import NO_ID, deflate, inflate

DEPTH, COMMON, LEAST, GAIN, SMOOTH = 3, 3 << 19, 2, 50.0, 10.0
HOT_CONTEXTS, HOT_CELLS = 1 << 10, 1 << 21  # what is sent, as shares of all positions
BUCKET = 1 << 18  # places of a bucket; contexts of more are sent too, as long as these are MOST_CONTEXTS at most
MOST_CONTEXTS = 1 << 18
END = np.uint64(0)
GONE, _RARE = -1, np.uint64(1 << 63)  # a word that no longer matters; what marks the hash of one that is not common
_HELD = 2_000_000  # counts that a task holds before it sends them
_SPOTS, _ROWS = 600_000, 700_000  # likewise spots, and sums of rows


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, each text closed by END, and each text's first one."""
    w = words_of(LOWER[data], off)
    n = len(w.first) - 1
    out = np.full(len(w.start) + n, END, np.uint64)
    out[np.arange(len(w.start)) + w.doc] = w.hashes()
    return out, w.first + np.arange(n + 1)


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in sorted keys, -1 where it isn't there."""
    if not len(keys):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def _summed(texts: DataFrame, keys_of) -> DataFrame:
    """(key, n): how often each key of keys_of(bytes, offsets) occurs in all texts."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send():
            key = np.concatenate([k for k, _ in held])
            order = np.argsort(key)
            key = key[order]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            n = np.add.reduceat(np.concatenate([c for _, c in held])[order], head) if len(head) else np.zeros(0, np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key[head].view(np.int64)), pa.array(n)], names=["key", "n"])

        for b in batches:
            for _, _, data, off in doc_chunks(b.column(0)):
                held.append(np.unique(keys_of(data, off), return_counts=True))
                if sum(len(k) for k, _ in held) > _HELD:
                    yield send()
        if held:
            yield send()

    return texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Contexts of one length. pair: sorted (place of the suffix without the first word, or 0) << 32 | first word; cell: sorted context << 32 | next word.

    ahead: sorted (place of the prefix without the last word) << 32 | last word, of contexts of two words or more, and ahead_at the context of each.
    """

    pair: np.ndarray
    ahead: np.ndarray
    ahead_at: np.ndarray
    kept: np.ndarray
    rest: np.ndarray  # log10 of what an unlisted word's probability is multiplied by
    cell: np.ndarray
    gain: np.ndarray  # log10 P(w | s) / P(w), by cell
    n: np.ndarray  # count, by cell
    size: np.ndarray  # smoothed size, by context


@dataclass
class Tree:
    word: np.ndarray  # sorted hashes of the common words
    count: np.ndarray
    n: int
    v: int
    levels: list[Level] = field(default_factory=list)
    lead: np.ndarray | None = None  # for each value of the leading bits, the first word that has them

    def find(self, sym: np.ndarray) -> np.ndarray:
        """Places among the common words, -1 for others: from the first word with the same leading bits on."""
        if not len(self.word):
            return np.full(len(sym), -1, np.int64)
        shift = np.uint64(64 - len(self.word).bit_length())
        if self.lead is None:
            self.lead = np.append(0, np.cumsum(np.bincount((self.word >> shift).astype(np.int64), minlength=1 << (64 - int(shift)))))[:-1].astype(np.int32)
        last = len(self.word) - 1
        at = np.minimum(self.lead[(sym >> shift).astype(np.int64)], last).astype(np.int64)
        live = np.flatnonzero(self.word[at] < sym)
        while len(live):
            at[live] += 1
            live = live[at[live] < last]
            live = live[self.word[at[live]] < sym[live]]
        at = np.minimum(at, last)
        return np.where(self.word[at] == sym, at, -1)

    def root(self, count: np.ndarray) -> np.ndarray:
        return (count + 1.0) / (self.n + self.v + 1.0)

    def places(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each symbol's place among the common words, and for each level the context before each symbol, -1 if it is none."""
        word = self.find(sym)
        end = int(self.find(np.array([END]))[0])
        at = np.arange(len(sym)) - np.repeat(first[:-1], np.diff(first))
        states, deep = [], None
        for d, level in enumerate(self.levels, 1):
            before = np.full(len(sym), end, np.int64)
            before[d:] = np.where(at[d:] >= d, word[:-d], end)
            some = np.flatnonzero(before >= 0) if d == 1 else np.flatnonzero((before >= 0) & (deep >= 0) & (at >= d - 1))
            found = np.full(len(sym), -1, np.int64)
            found[some] = _find(level.pair, before[some] if d == 1 else (deep[some] << 32) | before[some])
            deep = found
            states.append(deep)
        return word, states

    def ratio(self, d: int, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 P(word | longest kept suffix of the context) / P(word); state: places among the contexts of level d."""
        level = self.levels[d]
        below = self.ratio(d - 1, level.pair[state] >> 32, word) if d else np.zeros(len(state))
        cell = _find(level.cell, (state << 32) | word)
        gain = level.gain[np.maximum(cell, 0)] if len(level.gain) else 0
        return np.where(level.kept[state], np.where(cell >= 0, gain, level.rest[state] + below), below)

    def more(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each symbol's place, and log10 P(symbol | longest kept suffix) / P(symbol) by the cells held here."""
        word, states = self.places(sym, first)
        out = np.zeros(len(sym))
        for level, state in zip(self.levels, states):
            some = np.flatnonzero(state >= 0)
            some = some[level.kept[state[some]]]
            cell = self.cells(level, state[some], word[some])
            out[some] = np.where(cell >= 0, level.gain[np.maximum(cell, 0)] if len(level.gain) else 0, level.rest[state[some]] + out[some])
        return word, out

    def cells(self, level: Level, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        return _find(level.cell, np.where((state >= 0) & (word >= 0), (state << 32) | word, -1))

    def states(self, s: Spots) -> list[np.ndarray]:
        """For each level the context before each spot, -1 if it is none of this tree."""
        out: list[np.ndarray] = []
        for d, level in enumerate(self.levels, 1):
            before = s.word[d]
            some = np.flatnonzero(before >= 0) if d == 1 else np.flatnonzero((before >= 0) & (out[-1] >= 0) & (s.at >= d - 1))
            found = np.full(len(before), -1, np.int64)
            found[some] = _find(level.pair, before[some] if d == 1 else (out[-1][some] << 32) | before[some])
            out.append(found)
        return out

    def chance(self, s: Spots, states: list[np.ndarray], upto: int | None = None) -> np.ndarray:
        """P(word | longest kept suffix of up to `upto` words) of each spot, from the counts that it brings."""
        word = s.word[0]
        out = _root(s, self)
        for d, (level, state) in enumerate(zip(self.levels[:upto], states)):
            some = np.flatnonzero(state >= 0)
            some = some[level.kept[state[some]]]
            cell = self.cells(level, state[some], word[some])
            n = np.where(cell >= 0, level.n[np.maximum(cell, 0)] if len(level.n) else 0, s.n[d, some])
            out[some] = n / level.size[state[some]] + 10 ** level.rest[state[some]] * out[some]
        return out


def _planes(x: np.ndarray) -> bytes:
    """The bytes of equal weight side by side, which compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _steps(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Differences, beginning anew at each head, with the sign in the last bit."""
    step = np.diff(x, prepend=x.dtype.type(0))
    step[head] = x[head]
    return ((step << 1) ^ (step >> 63)).view(np.uint64)


def _summed_steps(x: np.ndarray) -> np.ndarray:
    x = x.view(np.int64)
    return np.cumsum(((x >> 1) & 0x7FFFFFFFFFFFFFFF) ^ -(x & 1))


@dataclass
class Spots:
    """Places in texts. word: the word and those before it, the last first: places among the common words, GONE, or marked hashes of others; n: how often the word follows each of the contexts sent (0: not listed)."""

    doc: np.ndarray
    tell: np.ndarray  # tells rows of one id apart
    train: np.ndarray
    at: np.ndarray  # place in the text, the depth at most
    rep: np.ndarray  # bit d: this spot stands for all of its next word of its context of level d
    many: np.ndarray  # count of a word that is not common
    n: np.ndarray
    word: np.ndarray

    def take(self, which: np.ndarray) -> Spots:
        return Spots(*(x.take(which, axis=-1) for x in vars(self).values()))

    @staticmethod
    def joined(parts: list[Spots]) -> Spots:
        return parts[0] if len(parts) == 1 else Spots(*(np.concatenate(x, axis=-1) for x in zip(*(vars(p).values() for p in parts))))

    def packed(self, order: np.ndarray, head: np.ndarray, code: np.ndarray) -> list[bytes]:
        """A blob for each run of `order` from one head to the next. code: a short number for each common word; 0 is GONE, 1 all others, whose hashes follow."""
        words = [w.take(order) for w in self.word]
        codes = [np.where(w >= 0, code[np.maximum(w, 0)], np.uint32(0)) for w in words]
        rare = [np.flatnonzero(w < GONE) for w in words]
        for c, r in zip(codes, rare):
            c[r] = 1
        flags = self.train | (self.at << np.uint8(1))
        columns = [*(_steps(x.take(order), head) for x in (self.doc, self.tell)), *(x.take(order) for x in (flags, self.rep, self.many, *self.n)), *codes]
        widths = [(int(x.max()).bit_length() + 7) // 8 for x in columns]
        planes = [(x >> x.dtype.type(8 * k)).astype(np.uint8) for x, width in zip(columns, widths) for k in range(width)]
        edge = np.append(head, len(order))
        hashes = [(w[r], np.searchsorted(r, edge).tolist()) for w, r in zip(words, rare)]
        edge = edge.tolist()
        return [deflate(b"".join([np.int64(hi - lo).tobytes(), bytes(widths), *(p[lo:hi] for p in planes), *(h[at[k] : at[k + 1]] for h, at in hashes)])) for k, (lo, hi) in enumerate(zip(edge, edge[1:]))]

    @staticmethod
    def unpack(z: bytes, depth: int, back: np.ndarray) -> Spots:
        raw, kinds = inflate(z), [np.uint64] * 2 + [np.uint8] * 2 + [np.uint32] * (2 * depth + 2)
        n, at, columns = int(np.frombuffer(raw, np.int64, 1)[0]), 8 + len(kinds), []
        for kind, width in zip(kinds, raw[8:at]):
            x = np.zeros(n, kind)
            for k in range(width):
                x |= np.frombuffer(raw, np.uint8, n, at).astype(kind) << kind(8 * k)
                at += n
            columns.append(x)
        doc, tell, flags, rep, many, *rest = columns
        word = np.empty((depth + 1, n), np.int64)
        for w, code in zip(word, rest[depth:]):
            w[:] = back.take(code)
            rare = np.flatnonzero(code == 1)
            w[rare] = np.frombuffer(raw, np.int64, len(rare), at)
            at += 8 * len(rare)
        return Spots(_summed_steps(doc), _summed_steps(tell), flags & 1, flags >> 1, rep, many, np.stack(rest[:depth]), word)


def _level(tree: Tree, pair: np.ndarray, ahead: np.ndarray, ahead_at: np.ndarray, size: np.ndarray, cell: np.ndarray, n: np.ndarray, gain: float, smooth: float, others: np.ndarray | None = None) -> Level:
    """The divergence test and the smoothed distributions of contexts with the given counts.

    others: rows of (count, predicted share, divergence) by context, of listed cells that are not among the given ones.
    """
    order = np.argsort(cell)
    cell, n = cell[order], n[order]
    ctx, word = cell >> 32, cell & 0xFFFFFFFF
    root = tree.root(tree.count[word])
    up = root * 10 ** tree.ratio(len(tree.levels) - 1, pair[ctx] >> 32, word) if tree.levels else root  # what the parent, in its longest kept suffix, predicts
    listed, share, kl = (np.bincount(ctx, x, len(pair)) for x in (n, up, n * np.log(n / size[ctx] / up)))
    if others is not None:
        listed, share, kl = listed + others[0], share + others[1], kl + others[2]
    rest = size - listed
    kl += np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / size / np.maximum(1 - share, 1e-12)), 0)
    weight = rest + smooth
    p = (n + weight[ctx] * up) / (size[ctx] + smooth)
    return Level(pair, ahead, ahead_at, kl > gain, np.log10(weight / (size + smooth)), cell, np.log10(p / root), n, size + smooth)


def _root(s: Spots, tree: Tree) -> np.ndarray:
    word = s.word[0]
    return tree.root(np.where(word >= 0, tree.count[np.maximum(word, 0)] if len(tree.count) else 0, s.many))


@dataclass
class Sent:
    """What all tasks get: the tree, short codes of its words, and the bounds."""

    tree: Tree
    depth: int
    least: int
    cell_floor: int  # of next words of contexts of two words or more
    context_floor: int  # likewise of those contexts; one-word contexts: word_floor
    word_floor: int
    gain: float
    smooth: float
    buckets: int
    code: np.ndarray
    back: np.ndarray
    never: int  # contexts that occur so often or less are never kept
    rarest: int  # words that are not common occur so often or less

    def floor(self, d: int) -> int:
        """Next words of level d that occur so often or less are not listed."""
        return max(self.least - 1, self.cell_floor if d else 0)

    def unpack(self, z: bytes) -> Spots:
        return Spots.unpack(z, self.depth, self.back)

    def deal(self, to: np.ndarray, s: Spots) -> tuple[list[int], list[bytes]]:
        if not len(to):
            return [], []
        to = (to % np.uint64(self.buckets)).astype(np.uint16 if self.buckets <= 1 << 16 else np.int64)
        order = np.argsort(to, kind="stable")
        to = to[order]
        head = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        return to[head].tolist(), s.packed(order, head, self.code)

    def lives(self, word: np.ndarray) -> np.ndarray:
        """Whether a context with the word may be kept."""
        common = word >= 0
        if self.rarest >= self.never:
            return common | ((word != GONE) & (self.rarest > self.never))
        return np.where(common, self.tree.count[np.where(common, word, 0)] > self.never if len(self.tree.count) else False, False)


class Shared:
    """A Sent for all tasks. Each executor writes a broadcast to its disk; the common words, which are most of it, are in one of their own, sent once."""

    def __init__(self, spark, sent: Sent, words=None):
        self.words = words or spark.sparkContext.broadcast((sent.tree.word, sent.tree.count, sent.code, sent.back))
        self.rest = spark.sparkContext.broadcast(replace(sent, tree=replace(sent.tree, word=None, count=None, lead=None), code=None, back=None))

    @property
    def value(self) -> Sent:
        sent = self.rest.value
        if sent.code is None:
            sent.tree.word, sent.tree.count, sent.code, sent.back = self.words.value
        return sent


def _deal(parts: int, rows: DataFrame) -> DataFrame:
    return rows.repartition(parts, "b").sortWithinPartitions("b")


def _per_bucket(batches):
    """(bucket, blobs) of rows that come sorted by bucket."""
    at, blobs = None, []
    for b in batches:
        for k, z in zip(b.column(0).to_pylist(), b.column(1)):
            if k != at and blobs:
                yield at, blobs
                blobs = []
            at = k
            blobs.append(z.as_py())
    if blobs:
        yield at, blobs


def _walk(batches, sent: Sent):
    """(rows, first, sym, word, at, states, asked, key) of runs of texts; asked: whether a spot has to be counted, and by what it is dealt then."""
    tree = sent.tree
    for b in batches:
        doc, tell, train = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        for lo, hi, data, off in doc_chunks(b.column(3)):
            sym, first = symbols(data, off)
            word, states = tree.places(sym, first)
            at = np.minimum(np.arange(len(sym)) - np.repeat(first[:-1], np.diff(first)), sent.depth)
            asked = word < 0
            key = np.where(asked, sym, 0)
            for d, (level, state) in enumerate(zip(tree.levels, states)):
                new = np.flatnonzero((state >= 0) & ~asked)
                new = new[tree.cells(level, state[new], word[new]) < 0]
                asked[new] = True
                key[new] = mix64((state[new].astype(np.uint64) << np.uint64(3)) + np.uint64(d + 1)) ^ sym[new]
            yield (doc[lo:hi], tell[lo:hi], train[lo:hi]), first, sym, word, at, states, asked, mix64(key)


def _named(sym: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Words by what Spots have for them."""
    return np.where(word >= 0, word, (sym | _RARE).view(np.int64))


def _spots(which: np.ndarray, rows, first: np.ndarray, sym: np.ndarray, word: np.ndarray, at: np.ndarray, tree: Tree, depth: int) -> Spots:
    row, at = np.searchsorted(first, which, "right") - 1, at[which]
    name, end = _named(sym, word), _named(np.array([END]), tree.find(np.array([END])))[0]
    words = np.empty((depth + 1, len(which)), np.int64)
    for d in range(depth + 1):
        words[d] = np.where(at >= d, name[np.maximum(which - d, 0)], end)
    doc, tell, train = (x[row] for x in rows)
    zero = np.zeros(len(which), np.uint8)
    return Spots(doc, tell, train.astype(np.uint8), at.astype(np.uint8), zero, zero.astype(np.uint32), np.zeros((depth, len(which)), np.uint32), words)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each one's group, an order by groups, and where each group begins in it."""
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order, np.flatnonzero(new)


def _pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(mix64(context + np.uint64(0x9E3779B97F4A7C15)) ^ word)


def _counted(s: Spots, sent: Sent) -> Spots:
    """The spots of a bucket with the counts of their words, where these are not common, and of their next words in sent contexts."""
    tree, train = sent.tree, s.train.astype(float)
    rare = np.flatnonzero(s.word[0] < 0)
    group, _, _ = _groups(s.word[0, rare])
    s.many[rare] = np.bincount(group, train[rare])[group] if len(rare) else 0
    for d, (level, state) in enumerate(zip(tree.levels, tree.states(s))):
        some = np.flatnonzero(state >= 0)
        some = some[tree.cells(level, state[some], s.word[0, some]) < 0]
        if not len(some):
            continue
        group, order, head = _groups(_pair_key(state[some].astype(np.uint64), s.word[0, some].view(np.uint64)))
        n = np.bincount(group, train[some])
        n[n <= sent.floor(d)] = 0
        s.n[d, some] = n[group]
        first = some[order[head]]
        s.rep[first[n > 0]] |= np.uint8(1 << d)
    return s


def _sums(met: DataFrame, bound: Shared, d: int, many: int) -> np.ndarray:
    """For each of the `many` sent contexts of level d the sums over its counted next words that _level takes as others; a task sends a row per context at most."""

    def run(batches):
        sent = bound.value
        size_ = sent.tree.levels[d].size - sent.smooth
        total = np.zeros((3, len(size_)))
        for b in batches:
            for z in b.column(0):
                s = sent.unpack(z.as_py())
                s = s.take(np.flatnonzero(s.rep & (1 << d)))
                states = sent.tree.states(s)
                n, up, ctx = s.n[d].astype(float), sent.tree.chance(s, states, d), states[d]
                total += [np.bincount(ctx, x, len(size_)) for x in (n, up, n * np.log(n / size_[ctx] / up))]
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, *total[:, some])], names=["ctx", "a", "b", "c"])

    found = met.select("z").mapInArrow(run, "ctx long, a double, b double, c double").groupBy("ctx").agg(*(F.sum(c).alias(c) for c in "abc")).toArrow()
    out = np.zeros((3, many))
    out[:, found["ctx"].to_numpy()] = [found[c].to_numpy() for c in "abc"]
    return out


def learn(texts: DataFrame, words: DataFrame, **bounds) -> Tree:
    """The part of the tree that is sent to all tasks; texts: of the training rows."""
    rows = texts.select(F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("tell"), F.lit(1).alias("train"), "text")
    return learn_all(rows, words, **bounds)[0].tree


def _never(n: int, v: int, least: int, gain: float, smooth: float) -> int:
    """So many occurrences are too few for a context to be kept.

    A context of s places lists a word w that follows it n_w times, LEAST or more; w follows the parent as often, so its predicted share is n_w / (N + V + 1 + b) at least, and
    log(n_w / s / share) no more than log((N + V + 1 + b) / s). What is not listed adds its number times log(1e12) at most; there is none where s is LEAST.
    """
    s, most = 0, n + v + 1 + smooth
    while gain >= 0 and s < n and (s + 1 < least or (s + 1) * max(np.log(most / (s + 1)), 0 if s + 1 == least else 12 * np.log(10)) < gain):
        s += 1
    return s


def _rarest(words: DataFrame, n: int, common: int) -> int:
    """A count that no more than `common` words exceed, the least one up to 1,000."""
    held, counts = 0, words.groupBy(F.least("n", F.lit(1000)).alias("n")).count().orderBy(F.col("n").desc()).collect()
    for r in counts:
        held += r["count"]
        if held > common:
            return r["n"] if r["n"] < 1000 else max(1000, n // common)
    return 0


def learn_all(
    rows: DataFrame, words: DataFrame, depth: int = DEPTH, contexts: int | None = None, cells: int | None = None, common: int = COMMON, least: int = LEAST, gain: float = GAIN, smooth: float = SMOOTH,
    hot_contexts: int = HOT_CONTEXTS, hot_cells: int = HOT_CELLS, bucket: int = BUCKET,
) -> tuple[Sent, DataFrame, Shared]:
    """What is sent to all tasks, (z) the counted spots, and what Spark has sent; rows: (doc, tell, train, text); words: (key, n) of the training texts' symbols."""
    spark = rows.sparkSession
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    never = 0 if contexts or cells else _never(n, v, least, gain, smooth)
    rarest = max(_rarest(words, n, common), never)
    top = words.filter(F.col("n") > rarest).toArrow()
    order = np.argsort(h := top["key"].to_numpy().view(np.uint64))
    tree = Tree(h[order], top["n"].to_numpy()[order], n, v)
    many_contexts, many_cells = n // (contexts or max(hot_contexts, min(n // bucket, MOST_CONTEXTS))), n // (cells or hot_cells)
    at = np.flatnonzero(tree.count > many_contexts)
    pair, size = at.astype(np.int64), tree.count[at].astype(float)
    empty = np.zeros(0, np.int64)
    ahead, ahead_at = empty, empty
    training = rows.filter("train = 1").select("text")
    sizes = []
    total, taught = rows.agg(F.count("*"), F.coalesce(F.sum("train"), F.lit(0))).first()
    by = np.argsort(-tree.count, kind="stable")
    rank = np.argsort(by)
    floor = n // cells if cells else 0
    given = Sent(
        tree, depth, least, floor, max(floor, n // contexts if contexts else 0), n // contexts if contexts else 0, gain, smooth,
        max(shuffle_parts(spark), n * total // max(taught, 1) // bucket), np.append(rank + 2, 0).astype(np.uint32), np.append([GONE, GONE], by).astype(np.int32), never, rarest,
    )
    common_words = None
    for d in range(1, depth + 1):
        tree.levels.append(Level(pair, ahead, ahead_at, np.zeros(len(pair), bool), np.zeros(len(pair)), empty, empty.astype(float), empty, size + smooth))
        sizes.append(size)
        if not len(pair):
            continue
        sent = Shared(spark, given, common_words)
        common_words = sent.words

        def followed(data, off, d=d, sent=sent):
            tree = sent.value.tree
            word, states = tree.places(*symbols(data, off))
            ok = (states[d - 1] >= 0) & (word >= 0)
            ok[ok] = tree.count[word[ok]] > many_cells
            return ((states[d - 1][ok] << 32) | word[ok]).astype(np.uint64)

        found = _summed(training, followed).filter((F.col("n") >= least) & (F.col("n") > many_cells)).toArrow()  # at most as many as cells are sent
        order = np.argsort(key := found["key"].to_numpy())
        tree.levels[-1].cell, tree.levels[-1].n = key[order], found["n"].to_numpy()[order].astype(float)
        # the next candidates: a sent context and a frequent word after it; keyed by their suffix, so extended to the left
        pair, ahead, ahead_at, size = _extend(tree.levels[-1], tree.levels[-1].cell, tree.levels[-1].n, many_contexts)
    bound = Shared(spark, given, common_words)

    def ask(batches):
        sent, held, keys, many = bound.value, [], [], 0

        def send():
            to, z = sent.deal(np.concatenate(keys), Spots.joined(held))
            held.clear(), keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(z, pa.binary())], names=["b", "z"])

        for rows_, first, sym, word, at, _, asked, key in _walk(batches, sent):
            which = np.flatnonzero(asked)
            held.append(_spots(which, rows_, first, sym, word, at, sent.tree, sent.depth))
            keys.append(key[which])
            many += len(which)
            if many > _SPOTS:
                yield send()
                many = 0
        if held:
            yield send()

    def meet(batches):
        for _, blobs in _per_bucket(batches):
            s = _counted(Spots.joined([bound.value.unpack(z) for z in blobs]), bound.value)
            for x in np.array_split(np.arange(len(s.doc)), len(s.doc) // 100_000 + 1):
                yield pa.RecordBatch.from_arrays([pa.array(s.packed(x, np.zeros(1, np.int64), bound.value.code), pa.binary())], names=["z"])

    met = cut(_deal(shuffle_parts(spark), rows.mapInArrow(ask, "b long, z binary")).mapInArrow(meet, "z binary"))
    done = Tree(tree.word, tree.count, n, v)
    for d, (level, size) in enumerate(zip(tree.levels, sizes)):
        if len(size):
            part = replace(given, tree=Tree(tree.word, tree.count, n, v, [*done.levels, level]))
            others = _sums(met, Shared(spark, part, bound.words), d, len(size))
            level = _level(done, level.pair, level.ahead, level.ahead_at, size, level.cell, level.n, gain, smooth, others)
        done.levels.append(level)
    out = replace(given, tree=done)
    return out, met, Shared(spark, out, bound.words)


def _extend(level: Level, cell: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Contexts of one word more from frequent cells: those whose suffix, the same without its first word, is a context of this level."""
    order = np.flatnonzero(n > least)
    order = order[np.argsort(cell[order])]
    ahead, n = cell[order], n[order]
    context, last = ahead >> 32, ahead & 0xFFFFFFFF
    suffix, first = level.pair[context] >> 32, level.pair[context] & 0xFFFFFFFF
    if len(level.ahead):
        found = _find(level.ahead, (suffix << 32) | last)
        state = np.where(found >= 0, level.ahead_at[np.maximum(found, 0)], -1)
    else:  # contexts of one word: the suffix is the last word alone
        state = _find(level.pair, last)
    ok = state >= 0
    pair, ahead, n = (state[ok] << 32) | first[ok], ahead[ok], n[ok]
    place = np.argsort(pair)
    at = np.empty(len(pair), np.int64)
    at[place] = np.arange(len(pair))
    return pair[place], ahead, at, n[place]


def _keys(s: Spots, known: np.ndarray) -> np.ndarray:
    """A hash of each spot's context of one word more than `known`."""
    out = np.zeros(len(s.doc), np.uint64)
    for d in range(1, len(s.word)):
        some = np.flatnonzero(known >= d - 1)
        out[some] = _pair_key(out[some], s.word[d, some].view(np.uint64))
    return out


def _deepened(p: np.ndarray, context: np.ndarray, word: np.ndarray, train: np.ndarray, d: int, sent: Sent) -> tuple[np.ndarray, np.ndarray]:
    """P(word) in contexts whose places are all here, from what their parents predict, and whether longer contexts may have next words to list."""
    of, _, _ = _groups(context)
    size = np.bincount(of, train)
    floor = sent.context_floor if d else sent.word_floor
    least = max(sent.least, sent.never + 1)
    on = (size >= least)[of]
    live = np.flatnonzero((size >= max(least, floor + 1))[of])  # others are not kept
    if not len(live):
        return p, on
    of, up = of[live], p[live]
    cell, order, head = _groups(_pair_key(of.astype(np.uint64), word[live].view(np.uint64)))
    first = order[head]
    n = np.bincount(cell, train[live])
    n[(n <= sent.floor(d)) | (word[live[first]] == GONE)] = 0
    some = np.flatnonzero(n)
    ctx, m, q = of[first[some]], n[some], up[first[some]]
    listed, share, kl = (np.bincount(ctx, x, len(size)).astype(float) for x in (m, q, m * np.log(m / size[ctx] / q)))
    rest = size - listed
    some = np.flatnonzero((rest > 0) & (size > 0))
    kl[some] += rest[some] * np.log(rest[some] / size[some] / np.maximum(1 - share[some], 1e-12))
    out = p.copy()
    out[live] = np.where((kl > sent.gain)[of], (n[cell] + (rest + sent.smooth)[of] * up) / (size + sent.smooth)[of], up)
    return out, on


_SUMS = ("doc", "tell", "rows", "n_tokens", "known", "base", "more")


class _Totals:
    """Sums by row, sent in blobs by a hash of the row's id."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.many, self.full = buckets, [], 0, False

    def add(self, doc, tell, *columns) -> None:
        self.held.append((doc, tell, *(x.astype(float) for x in columns)))
        self.many += len(doc)
        if self.many > _ROWS:
            self.sum()
            self.full = self.many > _ROWS // 2

    def gains(self, s: Spots, p: np.ndarray, tree: Tree) -> None:
        """Adds what P = p of these spots gives above their unigram score."""
        more = np.log10(p) - np.log10(_root(s, tree))
        some = np.flatnonzero(more)
        zero = np.zeros(len(some))
        self.add(s.doc[some], s.tell[some], zero, zero, zero, zero, more[some])

    def sum(self) -> None:
        doc, tell, *columns = map(np.concatenate, zip(*self.held))
        order = np.lexsort((tell, doc))
        doc, tell = doc[order], tell[order]
        head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tell[1:] != tell[:-1]))) if len(doc) else np.zeros(0, np.int64)
        self.held = [(doc[head], tell[head], *(np.add.reduceat(c[order], head) if len(head) else c for c in columns))]
        self.many = len(head)

    def send(self) -> tuple[list[int], list[bytes]]:
        self.sum()
        (columns,), self.held, self.many, self.full = self.held, [], 0, False
        to = (mix64(columns[0].view(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(to[order]) != 0)) if len(to) else np.zeros(0, np.int64)
        blobs = [deflate(b"".join([np.int64(len(x)).tobytes(), *(_planes(np.diff(c[x], prepend=c.dtype.type(0))) if k < 2 else _planes(c[x]) for k, c in enumerate(columns))])) for x in np.split(order, cuts[1:])] if len(to) else []
        return to[order][cuts].tolist(), blobs

    def read(self, z: bytes) -> None:
        raw = inflate(z)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        planes = np.frombuffer(raw, np.uint8, offset=8).reshape(len(_SUMS), 8, n)
        ints = [np.ascontiguousarray(x.T).view(np.int64)[:, 0].cumsum() for x in planes[:2]]
        self.add(*ints, *(np.ascontiguousarray(x.T).view(float)[:, 0] for x in planes[2:]))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, **bounds) -> DataFrame:
    """Every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, parts = docs.sparkSession, shuffle_parts(docs.sparkSession)
    held_out = lambda c: F.coalesce(crc_mod(c, folds) == fold, F.lit(False))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"), (~held_out(id_col)).cast("int").alias("train"))
    unique = texts.groupBy("doc").count().filter("count > 1").isEmpty()
    rows = texts.select("doc", (F.lit(0) if unique else F.xxhash64(F.coalesce("text", F.lit("")))).cast("long").alias("tell"), "train", "text")
    words = cut(_summed(rows.filter("train = 1"), lambda data, off: symbols(data, off)[0]))
    given, met, bound = learn_all(rows, words, **bounds)
    # a bucket below zero holds sums of rows, the others spots
    dealt = "b long, z binary"

    def batch(to, z, sums=False):
        return pa.RecordBatch.from_arrays([pa.array([-1 - k for k in to] if sums else to, pa.int64()), pa.array(z, pa.binary())], names=["b", "z"])

    def forward(source):
        """source: (spots, sums by row) -> spots that have a context that is not sent go on to it; the others are scored."""
        sent, totals = bound.value, _Totals(parts)
        held, keys, many = [], [], 0

        def send():
            to, z = sent.deal(np.concatenate(keys), Spots.joined(held))
            held.clear(), keys.clear()
            return batch(to, z)

        for s, states, row in source(sent):
            totals.add(*row)
            known = sum((x >= 0).astype(np.int8) for x in states)
            s.word[0, (s.word[0] < 0) & (s.many < sent.least)] = GONE  # never listed
            reach, live = np.zeros(len(known), np.int8), np.ones(len(known), bool)
            for d in range(1, sent.depth + 1):
                live &= sent.lives(s.word[d])
                s.word[d, ~live] = GONE
                reach += live & (s.at >= d - 1)
            cold = known < reach
            warm = s.take(np.flatnonzero(~cold))
            p = sent.tree.chance(warm, [x[~cold] for x in states])
            totals.gains(warm, p, sent.tree)
            which = np.flatnonzero(cold)
            s = s.take(which)
            s.rep[:] = 0
            held.append(s)
            keys.append(_keys(s, known[which]))
            many += len(which)
            if many > _SPOTS:
                yield send()
                many = 0
            if totals.full:
                yield batch(*totals.send(), sums=True)
        if held:
            yield send()
        if totals.held:
            yield batch(*totals.send(), sums=True)

    def from_texts(batches):
        def source(sent):
            for rows_, first, sym, word, at, states, asked, _ in _walk(batches, sent):
                n = len(first) - 1
                hit = word >= 0
                row = np.repeat(np.arange(n), np.diff(first))[hit]
                base = np.bincount(row, np.log10(sent.tree.count[word[hit]] + 1.0), n)
                totals = rows_[0], rows_[1], np.ones(n), np.diff(first), np.bincount(row, minlength=n), base, np.zeros(n)
                which = np.flatnonzero(~asked)
                yield _spots(which, rows_, first, sym, word, at, sent.tree, sent.depth), [x[which] for x in states], totals

        yield from forward(source)

    def from_met(batches):
        def source(sent):
            for b in batches:
                for z in b.column(0):
                    s = sent.unpack(z.as_py())
                    rare = np.flatnonzero(s.word[0] < 0)
                    zero = np.zeros(len(rare))
                    yield s, sent.tree.states(s), (s.doc[rare], s.tell[rare], zero, zero, s.many[rare] > 0, np.log10(s.many[rare] + 1.0), zero)

        yield from forward(source)

    def deepen(batches):
        sent, totals = bound.value, _Totals(parts)
        for b, blobs in _per_bucket(batches):
            if b < 0:
                for z in blobs:
                    totals.read(z)
            else:
                s = Spots.joined([sent.unpack(z) for z in blobs])
                states = sent.tree.states(s)
                p = sent.tree.chance(s, states)
                train = s.train.astype(float)
                key, live = np.zeros(len(p), np.uint64), np.ones(len(p), bool)
                for d, state in enumerate(states):
                    key = _pair_key(key, s.word[d + 1].view(np.uint64))
                    live &= s.word[d + 1] != GONE
                    some = np.flatnonzero(live & (state < 0) & (s.at >= d))
                    p[some], live[some] = _deepened(p[some], key[some], s.word[0, some], train[some], d, sent)
                totals.gains(s, p, sent.tree)
            if totals.full:
                yield batch(*totals.send())
        if totals.held:
            yield batch(*totals.send())

    def added(batches):
        for _, blobs in _per_bucket(batches):
            totals = _Totals(1)
            for z in blobs:
                totals.read(z)
            totals.sum()
            doc, tell, *columns = totals.held[0]
            yield pa.RecordBatch.from_arrays([pa.array(doc), *(pa.array(c) for c in columns)], names=["doc", *_SUMS[2:]])

    spots = _deal(parts, met.mapInArrow(from_met, dealt).unionByName(rows.mapInArrow(from_texts, dealt)))
    sums = _deal(parts, spots.mapInArrow(deepen, dealt)).mapInArrow(added, "doc long, rows double, n_tokens double, known double, base double, more double")
    # rows equal in id and text came together: each is one share of the sum
    each = sums.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))), *((F.col(c) / F.col("rows")).alias(c) for c in _SUMS[3:]))
    tree = given.tree
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(tree.n + tree.v + 1)))
    return each.withColumn("doc_id", F.nullif("doc", F.lit(NO_ID))).select("doc_id", held_out("doc_id").alias("held_out"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"), F.lit(tree.n).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("more")).alias("score"))


def op4_suffix_tree(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
