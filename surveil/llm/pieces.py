"""SentencePiece encoding and decoding over a relational lattice.

A space goes before the text; then a word is a run of spaces with what follows up to the next space or line feed, a
line feed, or a run of other characters, and no piece crosses a word's end. A word falls into stretches: where no piece of the
table has the two bytes that meet between two characters, no piece can span that place, so what lies before and behind it have best paths of their own.
The lattice of a stretch is a table: its substrings of bounded length are exploded (only of sizes that pieces with the same first
three characters have) and equi-joined to the piece table, edges are grouped by stretch, and an `aggregate` folds them in order of their end to the best
path: the highest sum of piece scores, on ties the longer last piece. A character that is no piece has an edge of its UTF-8 bytes' pieces
with a score below any other. Stretches of more than `longest` bytes, whose table would be large, are folded place by place to the same best path,
with the scores of the last places only and one piece per place to trace back. Decoding looks up each piece; every text comes back exactly.

The given vocabulary was made for merging; here its scores are used as path scores, so a path may differ from the one that merging takes.

Each distinct stretch goes through the lattice once. The commonest (at most `common`) are encoded first and sent to all tasks,
which compare them byte by byte. Documents are dealt to buckets of about BUCKET bytes of text by a hash. The other stretches of a bucket are dealt by their text to
meet their paths, and the paths travel to the bucket, those of one task and bucket packed together, where they come before its documents. A path tells its stretch. Which stretches are sent never changes the result.

Null texts give null pieces and empty ones give none. Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, shuffle_parts, table
from ._text import BYTE_VALUE, Rolling, spread, strings, text_bytes
from ._windows import gather

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
COMMON, LONGEST, BUCKET = 600_000, 256, 500_000
PARTS = 4  # the lattice of a partition is a hundred times its words: smaller partitions keep it in memory
WORD = re.compile(r" +[^ \n]*|\n|[^ \n]+")


@dataclass
class Pieces:
    """A piece table: text (a leading mark is a space), id and score; ids of the 256 byte pieces; each id's bytes."""

    table: pa.Table
    byte_ids: list[int]
    raw: list[bytes]
    longest: int


def load(model: str = MODEL) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    plain = [k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
    text = [sp.id_to_piece(k).replace("▁", " ") for k in plain]
    raw = [b""] * n
    for k, t in zip(plain, text):
        raw[k] = t.encode()
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    for b, k in enumerate(byte_ids):
        raw[k] = bytes([b])
    return Pieces(pa.table({"piece": text, "id": pa.array(plain, pa.int32()), "score": [float(sp.get_score(k)) for k in plain]}), byte_ids, raw, max(map(len, text)))


def words(text: str) -> list[str]:
    return WORD.findall(" " + text)


def _low(pieces: Pieces) -> float:
    return min(pieces.table["score"].to_pylist()) * 2 - 10


def best_path(word: str, score: dict[str, tuple[int, float]], longest: int, low: float, byte_ids: list[int]) -> list[int]:
    """The ids that lattice() gives for a word, from piece -> (id, score), in memory of one id and length per place."""
    ring = [0.0] * (longest + 1)  # scores of the last places
    ids, sizes = array("i", [-1]), array("i", [0])
    for end in range(1, len(word) + 1):
        top = None
        for start in range(max(0, end - longest), end):  # on ties the longer last piece stays
            k, x = score.get(word[start:end]) or ((-1, low) if end - start == 1 else (-2, 0.0))
            if k > -2 and (top is None or ring[start % len(ring)] + x > top):
                top, best, size = ring[start % len(ring)] + x, k, end - start
        ring[end % len(ring)] = top
        ids.append(best)
        sizes.append(size)
    out, end = [], len(word)
    while end:
        out += [ids[end]] if ids[end] >= 0 else [byte_ids[b] for b in reversed(word[end - 1].encode())]
        end -= sizes[end]
    return out[::-1]


def _sizes(pieces: Pieces) -> pa.Table:
    """(head, sizes): for three characters that begin some piece, the sizes of the pieces that a place before them can have."""
    texts = set(pieces.table["piece"].to_pylist())
    sizes: dict[str, set[int]] = defaultdict(lambda: {1})
    for t in texts:
        if len(t) > 2:
            sizes[t[:3]] |= {len(t)} | ({2} if t[:2] in texts else set())
    return pa.table({"head": list(sizes), "sizes": pa.array([sorted(x) for x in sizes.values()], pa.list_(pa.int32()))})


def lattice(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """rows with a distinct word each -> word, ids: the best path of each word."""
    spark = rows.sparkSession
    piece, sizes = (F.broadcast(spark.createDataFrame(t)) for t in (pieces.table, _sizes(pieces)))  # a vocabulary: its size does not follow the data
    n = F.length("word")
    places = rows.select("word", F.explode(F.sequence(F.lit(1), n)).alias("at")).withColumn("head", F.substring("word", F.col("at"), F.lit(3)))
    spans = places.join(sizes, "head", "left").select("word", "at", F.explode(F.coalesce("sizes", F.array(F.lit(1), F.lit(2)))).alias("size")).filter(F.col("size") <= n - F.col("at") + 1)
    edges = spans.withColumn("piece", F.substring("word", F.col("at"), F.col("size"))).join(piece, "piece", "left").filter("id is not null or size = 1")
    low = _low(pieces)
    edge = F.struct((F.col("at") + F.col("size") - 1).alias("end"), (F.col("at") - 1).alias("start"), F.coalesce("score", F.lit(low)).alias("score"), "id")
    grouped = edges.select("word", edge.alias("edge")).groupBy("word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    code = "hex(encode(substring(word, e.end, 1), 'utf-8'))"
    step = f"CASE WHEN e.id IS NULL THEN transform(sequence(1, length({code}), 2), k -> array({', '.join(map(str, pieces.byte_ids))})[cast(conv(substring({code}, k, 2), 16, 10) as int)]) ELSE array(e.id) END"
    # best[p]: score and pieces of the best path to place p; edges come by end, so only the last place can improve
    path = f"""aggregate(edges, array(named_struct('score', 0D, 'ids', cast(array() as array<int>))), (best, e) ->
        CASE WHEN size(best) <= e.end THEN concat(best, array(named_struct('score', best[e.start].score + e.score, 'ids', concat(best[e.start].ids, {step}))))
             WHEN best[e.start].score + e.score > best[e.end].score THEN concat(slice(best, 1, e.end), array(named_struct('score', best[e.start].score + e.score, 'ids', concat(best[e.start].ids, {step}))))
             ELSE best END, best -> element_at(best, -1).ids)"""
    return grouped.select("word", F.expr(path).alias("ids"))


_ROLL = Rolling(61)
_ZSTD = pa.Codec("zstd", 1)


def _deflate(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _inflate(z: bytes) -> bytes:
    return _ZSTD.decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True)


def _bundles(batches, narrow: np.dtype, held: int = 1 << 16):
    """Rows (b, ids) in runs of about `held`, one row for each b of a run: the number of its paths, their sizes, their ids."""

    def send(parts):
        to, size, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(to, kind="stable")
        which, place = spread(size[order])
        begin = np.cumsum(size) - size
        ids, size, to = ids[begin[order][which] + place], size[order], to[order]
        edge = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
        cuts = np.append(0, np.cumsum(size))
        z = [_deflate(int(k - j).to_bytes(4, "little") + size[j:k].astype(np.uint32).tobytes() + ids[cuts[j] : cuts[k]].astype(narrow).tobytes()) for j, k in zip(edge[:-1].tolist(), edge[1:].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(to[edge[:-1]]), pa.nulls(len(z), pa.int64()), pa.array(z, pa.binary()), pa.array([True] * len(z))], names=["b", "doc_id", "z", "is_path"])

    parts, n = [], 0
    for b in batches:
        lists = b.column(1)
        parts.append((b.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy()))
        n += len(lists)
        if n > held:
            yield send(parts)
            parts, n = [], 0
    if n:
        yield send(parts)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _ROLL.of(_ROLL.sums(BYTE_VALUE[1][data]), start, end)


def joints(pieces: Pieces) -> np.ndarray:
    """For two bytes a and b, at a * 256 + b: False if they can only meet between two characters that no piece holds together."""
    out = np.zeros((256, 256), bool)
    out[:, 0x80:0xC0] = True  # inside a character
    for t in pieces.table["piece"].to_pylist():
        raw = np.frombuffer(t.encode(), np.uint8)
        out[raw[:-1], raw[1:]] = True
    return out.ravel()


def stretches(texts: list[bytes], joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that begin with the added space: all bytes, and each stretch's text, start and end."""
    off = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    line, space = data == 10, data == 32
    begin = line | (space & ~np.append(False, space[:-1])) | np.append(False, line[:-1])
    begin[1:] |= ~joined[(data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]]
    begin[off[:-1][np.diff(off) > 0]] = True
    start = np.flatnonzero(begin)
    return data, np.searchsorted(off, start, "right") - 1, start, np.append(start[1:], len(data))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _heads(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span as a number, of shorter ones what there is."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    return np.ascontiguousarray(eight[start]).view(np.uint64)[:, 0] & _MASK[np.minimum(size, 8)]


@dataclass
class Known:
    """Stretches that are encoded already, sorted by hash; bucket: where each hash prefix begins. About 40 bytes each."""

    key: np.ndarray
    bucket: np.ndarray
    data: np.ndarray
    start: np.ndarray
    head: np.ndarray
    off: np.ndarray
    ids: np.ndarray

    @staticmethod
    def of(encoded: pa.Table) -> Known:
        """From columns word and ids, without a Python object per word."""
        data, off = text_bytes(encoded["word"])
        key = _hashes(data, off[:-1], off[1:])
        lists = encoded["ids"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        begin = lists.offsets.to_numpy()[:-1].astype(np.int64)
        order = np.argsort(key)
        which, place = spread(size[order])
        flat = lists.values.to_numpy(zero_copy_only=False)[begin[order][which] + place].astype(np.int32)
        length = np.diff(off)[order]
        head = _heads(data, off[:-1][order], length)
        bucket = np.searchsorted(key[order] >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)
        ends = lambda x: np.append(0, np.cumsum(x)).astype(np.int32)
        return Known((key[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), bucket, gather(data, off[:-1][order], length), ends(length), head, ends(size[order]), flat)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each span's place here, -1 if it isn't; all bytes are compared, the hash only speeds the search."""
        out = np.full(len(start), -1, np.int64)
        key = _hashes(data, start, end)
        where = (key >> np.uint64(44)).astype(np.int64)
        key = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at, upto = self.bucket[where], self.bucket[where + 1]
        live = np.flatnonzero(at < upto)
        while len(live):
            found = live[self.key[at[live]] == key[live]]
            place, size = at[found], (end - start)[found]
            same = (self.start[place + 1] - self.start[place] == size) & (self.head[place] == _heads(data, start[found], size))
            long = np.flatnonzero(same & (size > 8))
            if len(long):
                rest = size[long] - 8
                differ = gather(data, start[found[long]] + 8, rest) != gather(self.data, self.start[place[long]].astype(np.int64) + 8, rest)
                same[long] = ~np.logical_or.reduceat(differ, np.cumsum(rest) - rest)
            out[found[same]] = place[same]
            at[live] += 1
            live = live[(out[live] < 0) & (at[live] < upto[live])]
        return out


class Paths:
    """The paths of a bucket's stretches: by the bytes that they give, their number."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids, self.size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

    def put(self, words_: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        base = sum(map(len, self.size))
        self.number.update(zip(words_, range(base, base + len(words_))))
        self.ids.append(ids)
        self.size.append(size)

    def add(self, packed: bytes, narrow: np.dtype, data: np.ndarray, off: np.ndarray) -> None:
        raw = _inflate(packed)
        n = int.from_bytes(raw[:4], "little")
        size = np.frombuffer(raw, np.uint32, n, 4).astype(np.int64)
        ids = np.frombuffer(raw, narrow, -1, 4 + 4 * n).astype(np.int32)
        length = off[ids + 1] - off[ids]
        words_ = gather(data, off[ids], length).tobytes()
        cuts = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(size))].tolist()
        self.put([words_[a:b] for a, b in zip(cuts[:-1], cuts[1:])], ids, size)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each path's begin."""
        self.ids, self.size = [np.concatenate(self.ids)], [np.concatenate(self.size)]
        return self.ids[0], np.append(0, np.cumsum(self.size[0]))


def _slices(col: pa.Array, limit: int = 1 << 19):
    """Rows in runs of about limit bytes, with each text's bytes: a null or empty one has none, the others begin with the added space."""
    lo, raw, held = 0, [], 0
    for k, x in enumerate(col):
        t = b"" if not x.is_valid else x.as_py()
        t = t.encode() if isinstance(t, str) else _inflate(t) if t else t
        raw.append(b" " + t if t else t)
        held += len(t)
        if held > limit:
            yield lo, raw
            lo, raw, held = k + 1, [], 0
    if raw:
        yield lo, raw


def _common(docs: DataFrame, common: int, longest: int, meet) -> tuple[DataFrame, int]:
    """The commonest stretches, and how many bytes all texts have."""

    def run(batches):
        held, size, entries = [], 0, 0

        def send():
            key, n, data, length = map(np.concatenate, zip(*held))
            held.clear()
            order = np.argsort(key, kind="stable")
            head = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
            n, first = np.add.reduceat(n[order], head), order[head]
            first, n = first[n > 1], n[n > 1]
            words_ = gather(data, (np.cumsum(length) - length)[first], length[first])
            return pa.RecordBatch.from_arrays([strings(words_, np.append(0, np.cumsum(length[first]))), pa.array(n)], names=["word", "n"])

        for b in batches:
            for _, texts in _slices(b.column(0)):
                data, _, start, end = stretches(texts, meet.value)
                size += len(data)
                short = end - start <= longest
                start, end = start[short], end[short]
                key, first, n = np.unique(_hashes(data, start, end), return_index=True, return_counts=True)
                length = (end - start)[first]
                held.append((key, n, gather(data, start[first], length), length))
                entries += len(key)
                if entries > 400_000:
                    yield send()
                    entries = 0
        if entries:
            yield send()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([size])], names=["word", "n"])

    counts = cut(docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 2 or word is null"))
    size = counts.filter("word is null").agg(F.sum("n")).first()[0] or 0
    counts = counts.filter("word is not null")
    least, held = 0, 0
    for r in counts.groupBy(F.least("n", F.lit(1000)).alias("n")).count().orderBy(F.col("n").desc()).collect():  # at most 998 rows
        held += r["count"]
        if held > common:
            least = r["n"] + 1
            break
    if least > 1000:  # too many are that common: by their share, which bounds their number
        least = max(least, (counts.agg(F.sum("n")).first()[0] or 0) // common + 1)
    return counts.filter(F.col("n") >= least).select("word"), size


def encode(docs: DataFrame, pieces: Pieces | None = None, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON, longest: int = LONGEST, bucket: int = BUCKET) -> DataFrame:
    """Every row: doc_id, text, ids array<int>."""
    pieces = pieces or load()
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts, send = PARTS * shuffle_parts(spark), spark.sparkContext.broadcast
    meet = send(joints(pieces))
    often, size = _common(texts, common, longest, meet)
    known = send(Known.of(lattice(often.repartition(parts, "word"), pieces).toArrow()))
    scores = dict(zip(pieces.table["piece"].to_pylist(), zip(pieces.table["id"].to_pylist(), pieces.table["score"].to_pylist())))
    row, narrow = "b long, doc_id long, z binary, is_path boolean", np.min_scalar_type(len(pieces.raw))
    vocabulary = send(((scores, pieces.longest, _low(pieces), pieces.byte_ids), *_raw(pieces)))

    def packed(batches):
        for b in batches:
            z = [_deflate(t.as_py().encode()) if t.is_valid else b"" for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary()), pa.array([False] * len(z))], names=["b", "doc_id", "z", "is_path"])

    def others(batches):
        for b in batches:
            for lo, texts_ in _slices(b.column(1)):
                data, row, start, end = stretches(texts_, meet.value)
                to = b.column(0).slice(lo, len(texts_)).to_pylist()
                own: dict[int, set] = {k: set() for k in to}
                raw = data.tobytes()
                rare = np.flatnonzero((known.value.find(data, start, end) < 0) & (end - start <= longest))
                for d, s, e in zip(row[rare].tolist(), start[rare].tolist(), end[rare].tolist()):
                    own[to[d]].add(raw[s:e])
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([[w.decode() for w in x] for x in own.values()], pa.list_(pa.string()))], names=["b", "rare"])

    def joined(batches):
        have, (table_, *raw_pieces) = known.value, vocabulary.value
        at_bucket, paths = None, Paths()
        for b in batches:
            to, is_path = b.column(0).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, (to[1:] != to[:-1]) | (is_path[1:] != is_path[:-1]))).tolist()
            for first, last in zip(edges, [*edges[1:], len(to)]):
                if to[first] != at_bucket:
                    at_bucket, paths = to[first], Paths()
                if is_path[first]:
                    for z in b.column(2).slice(first, last - first).to_pylist():
                        paths.add(z, narrow, *raw_pieces)
                    continue
                for lo, texts_ in _slices(b.column(2).slice(first, last - first)):
                    data, row, start, end = stretches(texts_, meet.value)
                    at = have.find(data, start, end)
                    raw = data.tobytes()
                    usual, rare = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
                    numbers = []
                    for s, e in zip(start[rare].tolist(), end[rare].tolist()):
                        if e - s > longest and raw[s:e] not in paths.number:
                            paths.put([raw[s:e]], np.array(x := best_path(raw[s:e].decode(), *table_), np.int32), np.array([len(x)]))
                        numbers.append(paths.number[raw[s:e]])
                    size = np.zeros(len(start), np.int64)
                    size[usual] = have.off[at[usual] + 1] - have.off[at[usual]]
                    ids, off = paths.table()
                    numbers = np.array(numbers, np.int64)
                    size[rare] = off[numbers + 1] - off[numbers]
                    begin = np.cumsum(size) - size
                    flat = np.empty(int(size.sum()), np.int32)
                    for which, source, from_ in ((usual, have.ids, have.off[at[usual]]), (rare, ids, off[numbers])):
                        k, place = spread(size[which])
                        flat[begin[which][k] + place] = source[from_[k] + place]
                    cuts = np.append(begin, len(flat))[np.searchsorted(row, np.arange(len(texts_) + 1))]
                    null = [len(z.as_buffer()) == 0 for z in b.column(2).slice(first + lo, len(texts_))]
                    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat), mask=pa.array(null))
                    text = pa.array([None if no else t[1:].decode() for no, t in zip(null, texts_)], pa.string())
                    yield pa.RecordBatch.from_arrays([b.column(1).slice(first + lo, len(texts_)), text, lists], names=["doc_id", "text", "ids"])

    # the rare stretches are dealt once, both to be encoded (each once) and to meet their paths
    keyed = texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // bucket + 1)).alias("b"), "doc_id", "text")
    rare = keyed.select("b", "text").mapInArrow(others, "b long, rare array<string>").select("b", F.explode("rare").alias("word")).repartition(parts, "word")
    once = rare.groupBy("word").agg(F.min("b").alias("b")).filter("b >= 0").select("word")  # true of all; so both sides need the same columns and share the dealing
    paths = rare.join(lattice(once, pieces), "word").select("b", "ids").mapInArrow(lambda batches: _bundles(batches, narrow), row)
    dealt = paths.unionByName(keyed.mapInArrow(packed, row)).repartition(parts, "b").sortWithinPartitions("b", ~F.col("is_path"))  # a bucket's paths, then its texts
    return dealt.mapInArrow(joined, "doc_id long, text string, ids array<int>")


def _raw(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All pieces' bytes end to end, and where each id's begin."""
    return np.frombuffer(b"".join(pieces.raw), np.uint8), np.append(0, np.cumsum([len(r) for r in pieces.raw]))


def decode(rows: DataFrame, pieces: Pieces | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of their pieces. Null pieces give null. The table of pieces is a constant of the plan; no worker is needed."""
    raw = F.split(F.lit(",".join(r.hex() for r in (pieces or load()).raw)), ",")  # folded once, when the plan is made
    text = F.decode(F.unhex(F.array_join(F.transform(ids_col, lambda k: F.element_at(raw, k + 1)), "")), "utf-8")
    return rows.withColumn(out, F.substr(text, F.lit(2)))


def op8_piece_lattice(spark, sf_dir: str) -> DataFrame:
    pieces = load()
    return decode(encode(table(spark, sf_dir, "documents"), pieces), pieces).select("doc_id", F.size("ids").alias("n_pieces"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
