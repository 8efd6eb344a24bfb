"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is its distinct shingles of `n` lower-cased words (the whole sequence when shorter). Equal
sets form a class with its smallest id as representative. Then independent trees branch the representatives:
a node picks one or two of its T minwise coordinates (4/3 on average, the inverse of the threshold) by a
hash of its path, and each member goes to the child of the shingle that is its minimum there. A node of
at most `limit` members is compared exhaustively on full shingle sets. Nodes with the same members are compared once. Within a node a
breadth-first search compares a member with those not reached yet, so a clique costs one pass.

Two rounds keep large groups of near-duplicates cheap. The first gathers: of FIRST trees, small nodes are compared, and large ones are dealt to
blocks of about half the limit, each with the node's pivots in addition; what links becomes components. The second completes: of all trees, nodes
whose members are of one component already need no comparing; of the others, small ones are compared and large ones branch on, `depth` times at most. What has branched
once or more is compared as it is if its sets hold VOLUME tokens at most. What is larger in the end is compared completely: the members
outside its largest component, in blocks of half that volume, meet all members block by block, a task for each pair of blocks.
A pair at the threshold meets in one tree with probability 0.8 or so after one level, so ten trees find nearly all; more
similar pairs meet more often.

Links are confirmed on full sets, then joined to components. Texts that are null or
without words have empty sets and link with nothing; rows without id too (their component_id is null, and they are
kept). Rows that share an id are one document with several sets. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components, forest
from ._spark import cut, shuffle_parts, table
from ._text import LOWER, doc_chunks, grams, mix64, spread, stream64, words_of

SHINGLE, PER_CENT, COORDINATES, TREES, FIRST, LIMIT, DEPTH, VOLUME = 5, 75, 64, 10, 2, 250, 4, 2_000_000
_FACTOR = stream64(51, COORDINATES) | np.uint64(1)
_TERM = stream64(52, COORDINATES)
_PLACE = stream64(53, COORDINATES)
_ZSTD = pa.Codec("zstd", 3)
_BITS = 1 << 20
_RUN = 1 << 18  # bytes of text at once: hashing takes some forty times as much; a longer text comes alone


def _runs(packed: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Deflated texts in runs of about _RUN bytes, inflated."""
    lo, raw, held = 0, [], 0
    for k, z in enumerate(packed):
        raw.append(_inflate(z))
        held += len(raw[-1])
        if held > _RUN or k + 1 == len(packed):
            yield lo, raw
            lo, raw, held = k + 1, [], 0


def _deflate(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _inflate(z: bytes) -> bytes:
    return _ZSTD.decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct shingle hashes, sorted within each, and each document's first one."""
    w = words_of(LOWER[data], off)
    h = w.hashes()
    at, g = grams(h, w.first, n)
    doc = np.searchsorted(w.first, at, "right") - 1
    size = np.diff(w.first)
    for d in np.flatnonzero((size > 0) & (size < n)).tolist():
        a, b = w.first[d], w.first[d + 1]
        whole = grams(h[a:b], np.array([0, b - a]), int(b - a))[1] ^ np.uint64(0xA5A5A5A5A5A5A5A5 + int(b - a))
        doc, g = np.append(doc, d), np.append(g, whole)
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    return g[new], np.searchsorted(doc[new], np.arange(len(off)))


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int = SHINGLE) -> DataFrame:
    """(doc, n, f1, f2, sig): set size, a 128-bit fingerprint of the set, and its minima."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in doc_chunks(b.column(1), _RUN):
                g, first = shingle_sets(data, off, n)
                size = np.diff(first)
                some = np.flatnonzero(size)
                f = np.zeros((2, hi - lo), np.uint64)
                sig = np.zeros((hi - lo, COORDINATES), np.uint32)
                if len(some):
                    at = first[some]
                    f[0, some] = np.add.reduceat(mix64(g + np.uint64(77)), at)
                    f[1, some] = np.bitwise_xor.reduceat(mix64(g ^ np.uint64(0x5555)), at)
                    for t in range(COORDINATES):
                        sig[some, t] = np.minimum.reduceat(((g * _FACTOR[t] + _TERM[t]) >> np.uint64(32)).astype(np.uint32), at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(size), *(pa.array(x.view(np.int64)) for x in f), pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc", "n", "f1", "f2", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc long, n long, f1 long, f2 long, sig binary")


def _children(path: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Member and child path of each branch; one coordinate, or two in a third of the nodes."""
    u = mix64(path + np.uint64(0x9E37))
    first = (u % np.uint64(COORDINATES)).astype(int)
    second = (first + 1 + ((u >> np.uint64(16)) % np.uint64(COORDINATES - 1)).astype(int)) % COORDINATES
    two = np.flatnonzero((u >> np.uint64(32)) % np.uint64(3) == 0)
    who = np.concatenate([np.arange(len(path)), two])
    at = np.concatenate([first, second[two]])
    return who, mix64(mix64(path[who] ^ _PLACE[at]) + sig[who, at].astype(np.uint64) + np.uint64(1))


def _signatures(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _roots(reps: DataFrame, trees: list[int]) -> DataFrame:
    """(path, doc, c, n): the children of each tree's root; c is the component so far, n the size of the set."""

    def run(batches):
        for b in batches:
            sig = _signatures(b.column(3))
            for root in stream64(54, max(trees) + 1)[trees]:
                who, path = _children(np.full(len(sig), root), sig)
                yield _members(path, b, who)

    return reps.select("doc", "c", "n", "sig").mapInArrow(run, "path long, doc long, c long, n long")


def _members(path: np.ndarray, b: pa.RecordBatch, who: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), *(b.column(k).take(pa.array(who)) for k in ("doc", "c", "n"))], names=["path", "doc", "c", "n"])


def _branches(members: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            who, path = _children(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), _signatures(b.column(4)))
            yield _members(path, b, who)

    return members.select("path", "doc", "c", "n", "sig").mapInArrow(run, "path long, doc long, c long, n long")


def _nodes(members: DataFrame) -> DataFrame:
    """Nodes with members of more than one component."""
    by = F.xxhash64("doc", "path")
    nodes = members.groupBy("path").agg(F.count("*").alias("size"), F.sum("n").alias("volume"), F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.min_by("doc", by).alias("p1"), F.max_by("doc", by).alias("p2"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    return cut(nodes.filter("c0 <> c1").drop("c0", "c1"))


def _once(nodes: DataFrame) -> DataFrame:
    """One path of those with the same members."""
    return nodes.groupBy("size", "lo", "hi", "x").agg(F.min("path").alias("path")).select("path")


def _blocks(members: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """Members of nodes that stayed large, dealt to blocks; each block has the node's four pivots in addition."""
    n = F.ceil(F.col("size") * 2 / limit)
    block = F.pmod(F.xxhash64("path", "doc"), n)
    dealt = members.join(nodes, "path").select(F.xxhash64("path", block).alias("path"), "doc")
    pivots = nodes.select("path", n.alias("n"), F.explode(F.array_distinct(F.array("lo", "hi", "p1", "p2"))).alias("doc")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return dealt.unionByName(pivots.select(F.xxhash64("path", "block").alias("path"), "doc")).distinct()


def _pairs_of_blocks(members: DataFrame, links: DataFrame, block: int) -> DataFrame:
    """(path, doc): tasks that together compare all members of each node, but those that links put into its largest component, with each other. block: tokens."""
    tagged = cut(members.join(components(links).withColumnRenamed("id", "doc"), "doc", "left").select("path", "doc", "n", F.coalesce("component", "doc").alias("c")))
    sizes = tagged.groupBy("path", "c").agg(F.sum("n").alias("n")).groupBy("path").agg(F.sum("n").alias("all"), F.max(F.struct("n", "c")).alias("top"))
    sizes = sizes.select("path", F.col("top.c").alias("main"), F.ceil(F.col("top.n") / block).alias("mains"), F.ceil((F.col("all") - F.col("top.n")) / block).alias("rests")).filter("rests > 0")
    dealt = tagged.join(sizes, "path").withColumn("inner", F.col("c") == F.col("main"))
    mine = F.pmod(F.xxhash64("path", "doc"), F.when(F.col("inner"), F.col("mains")).otherwise(F.col("rests")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    # block i of the rest meets blocks j >= i of the rest, and each block of the largest component as j = -1, -2, ...
    with_rest = F.transform(upto("rests"), lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j")))
    with_main = F.transform(upto("mains"), lambda j: F.struct(F.col("mine").alias("i"), (-1 - j).alias("j")))
    from_main = F.transform(upto("rests"), lambda i: F.struct(i.alias("i"), (-1 - F.col("mine")).alias("j")))
    task = F.explode(F.when(F.col("inner"), from_main).otherwise(F.concat(with_rest, with_main)))
    return dealt.withColumn("mine", mine).select("path", "doc", task.alias("t")).select(F.xxhash64("path", "t.i", "t.j").alias("path"), "doc")


def first_nodes(reps: DataFrame, trees: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(path, doc) to compare in the first round, and the large nodes' members."""
    members = _roots(reps, list(range(trees)))
    nodes = _nodes(members)
    large = nodes.filter(F.col("size") > limit)
    kept = members.join(large.select("path"), "path").select("path", "doc")
    return members.join(_once(nodes.filter(F.col("size") <= limit)), "path").select("path", "doc").unionByName(_blocks(kept, large, limit)), kept


def next_nodes(reps: DataFrame, large: DataFrame, first: int, trees: int, limit: int, depth: int, volume: int) -> tuple[DataFrame, DataFrame | None]:
    """(path, doc) to compare in the second round, and (path, doc, n) of the nodes that stay large."""
    members = large.join(reps.select("doc", "c", "n"), "doc").select("path", "doc", "c", "n")
    if trees > first:
        members = members.unionByName(_roots(reps, list(range(first, trees))))
    out = []
    for level in range(depth):
        nodes = _nodes(members)
        small = (F.col("size") <= limit) | (F.lit(level > 0) & (F.col("volume") <= volume))
        out.append(members.join(_once(nodes.filter(small)), "path").select("path", "doc"))
        more = nodes.filter(~small)
        if not more.take(1):
            break
        if level == depth - 1:
            return _all(out), members.join(_once(more), "path").select("path", "doc", "n").distinct()
        members = cut(_branches(members.join(more.select("path"), "path").join(reps.select("doc", "sig"), "doc")))
    return _all(out), None


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def links_of(sets: list[np.ndarray], per_cent: int = PER_CENT, limit: int = LIMIT) -> Iterator[tuple[int, int]]:
    """Pairs that connect all sets of similarity per_cent or more."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        if 100 * both >= per_cent * (size.sum() - both):
            yield 0, 1
        return
    of = np.repeat(np.arange(len(sets)), size)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    holder, first = of[order], np.append(0, np.cumsum(np.bincount(token)))
    begin = np.append(0, np.cumsum(size))
    if len(sets) > limit:
        yield from _links_of_many(size, token, holder, first, begin, per_cent)
        return
    fresh = np.ones(len(sets), bool)
    while fresh.any():  # breadth first: what is reached is not compared again
        queue = [int(np.flatnonzero(fresh)[0])]
        fresh[queue[0]] = False
        while queue:
            a = queue.pop()
            mine = token[begin[a] : begin[a + 1]]
            group, place = spread(first[mine + 1] - first[mine])
            both = np.bincount(holder[first[mine][group] + place], minlength=len(sets))
            near = np.flatnonzero(fresh & (100 * both >= per_cent * (size[a] + size - both)))
            fresh[near] = False
            for b in near.tolist():
                yield a, b
            queue += near.tolist()
            if not fresh.any():
                return


def _links_of_many(size: np.ndarray, token: np.ndarray, holder: np.ndarray, first: np.ndarray, begin: np.ndarray, per_cent: int, held: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """All pairs, some rows at a time: tokens that many sets hold by a product of matrices, the others by the lists of their holders, of which about `held` are spread out at once."""
    n, many = len(size), np.diff(first)
    root = np.arange(n)
    common = np.flatnonzero(many > n // 8)
    column = np.full(len(many), -1)
    column[common] = np.arange(len(common))
    dense = np.zeros((n, len(common)), np.float32)
    of = np.repeat(np.arange(n), size)
    dense[of[column[token] >= 0], column[token][column[token] >= 0]] = 1
    spread_out = np.append(0, np.cumsum(np.where(column[token] < 0, many[token], 0)))[begin]  # up to each set
    lo = 0
    while lo < n:
        hi = min(n, lo + max(1, min(128, held // n, int(np.searchsorted(spread_out, spread_out[lo] + held, "right")) - 1 - lo)))
        both = dense[lo:hi] @ dense.T
        mine = np.arange(begin[lo], begin[hi])
        mine = mine[(column[token[mine]] < 0) & (many[token[mine]] > 1)]
        group, place = spread(many[token[mine]])
        at = (of[mine] - lo)[group] * n + holder[first[token[mine]][group] + place]
        both += np.bincount(at, minlength=(hi - lo) * n).reshape(hi - lo, n)
        a, b = np.nonzero(100 * both >= per_cent * (size[lo:hi, None] + size - both))
        root = forest(n, np.append(a + lo, np.arange(n)), np.append(b, root))
        lo = hi
    for k in np.flatnonzero(root != np.arange(n)).tolist():
        yield k, int(root[k])


def _bits(members: DataFrame) -> bytes:
    """A bit for each hash of _BITS that some member's doc has: 128 KB whatever the members."""
    bits = np.zeros(_BITS, bool)
    bits[members.select(F.pmod(F.xxhash64("doc"), F.lit(_BITS)).cast("int").alias("p")).distinct().toArrow()["p"].to_numpy()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _packed(members: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, z): deflated texts of the members; most others are left out before any shuffle, by _BITS bits that all tasks get."""
    sent = docs.sparkSession.sparkContext.broadcast(_bits(members))

    def pack(batches):
        bits = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            at = b.column(2).to_numpy()
            b = b.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            z = [_deflate((t.as_py() or "").encode()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary())], names=["doc", "z"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc is not null")
    return texts.withColumn("p", F.pmod(F.xxhash64("doc"), F.lit(_BITS)).cast("int")).mapInArrow(pack, "doc long, z binary")


def compare(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """Confirmed links (u, v) inside the nodes (path, doc)."""
    members = cut(members)
    packed = _packed(members, docs, id_col, text_col)

    def node(ids: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        some = [i for i, s in enumerate(sets) if len(s)]
        if len(some) > 1:
            for a, b in links_of([sets[i] for i in some], per_cent):
                if ids[some[a]] != ids[some[b]]:
                    yield ids[some[a]], ids[some[b]]

    def run(batches):
        at, ids, sets = None, [], []
        for b in batches:
            for lo, raw in _runs(b.column(2).to_pylist()):
                part = b.slice(lo, len(raw))
                off = np.append(0, np.cumsum([len(r) for r in raw]))
                g, first = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), off, n)
                found = []
                for k, (path, doc) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    if path != at:
                        found += node(ids, sets)
                        at, ids, sets = path, [], []
                    ids.append(doc)
                    sets.append(g[first[k] : first[k + 1]])
                if found:
                    u, v = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        if last := list(node(ids, sets)):
            u, v = zip(*last)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    dealt = members.join(packed, "doc").select("path", "doc", "z").repartition(shuffle_parts(docs.sparkSession), "path").sortWithinPartitions("path")
    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, per_cent: int = PER_CENT, trees: int = TREES, limit: int = LIMIT, depth: int = DEPTH, volume: int = VOLUME) -> DataFrame:
    """Every row: doc_id, n_shingles, component_id, kept."""
    all_ = cut(sketches(docs, id_col, text_col, n))
    classes = cut(all_.filter("n > 0 and doc is not null").groupBy("n", "f1", "f2").agg(F.min("doc").alias("rep"), F.first("sig").alias("sig")))
    reps = classes.select(F.col("rep").alias("doc"), F.col("rep").alias("c"), "n", "sig")
    first = min(FIRST, trees)
    nodes, large = first_nodes(reps, first, limit)
    links = cut(compare(nodes, docs, id_col, text_col, n, per_cent))
    so_far = components(links).withColumnRenamed("id", "doc")
    reps = cut(reps.drop("c").join(so_far, "doc", "left").select("doc", F.coalesce("component", "doc").alias("c"), "n", "sig"))
    nodes, stayed = next_nodes(reps, large, first, trees, limit, depth, volume)
    links = cut(links.unionByName(compare(nodes, docs, id_col, text_col, n, per_cent)))
    if stayed is not None:
        links = links.unionByName(compare(_pairs_of_blocks(stayed, links, volume // 2), docs, id_col, text_col, n, per_cent))
    found = components(links)
    group = classes.select("n", "f1", "f2", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = all_.drop("sig").join(group, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def op9_chosen_path(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near-duplicates: the one with the smallest id."""
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
