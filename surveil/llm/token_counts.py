"""Token counts per section by offset-mapped attribution.

A document is encoded once, whole. Byte-level tokens lie end to end, so their lengths give
each token's span; an interval join of token spans with section spans (both sorted, by
binary search) gives each section its tokens. A token that crosses a boundary goes by one
of three rules: ``first`` (default) to the section with its first byte, ``most`` to the
one with most of its bytes (the earlier of equals), ``share`` to each by its part of the bytes.
Bytes between sections belong to none; a token wholly there is in no section.

Sections are lines with their line feed, or the given columns of a row (fields),
joined by a separator that belongs to no field. Null and empty texts are one empty section
without tokens. Repeated rows give repeated rows; other columns are ignored. No row moves.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import table
from ._text import doc_chunks, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict = {}


def encoder(ranks_file: bytes):
    """The encoding and each token's length in bytes; one per worker."""
    key = hash(ranks_file)
    if key not in _LOADED:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, k in ranks.items():
            size[k] = len(piece)
        _LOADED[key] = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return _LOADED[key]


def attribute(tok: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section. tok: n + 1 token bounds, sorted; start, end: spans of sorted sections that do not overlap."""
    a, b = tok[:-1], tok[1:]
    lo = np.searchsorted(end, a, "right")  # the first section that ends after the token begins
    hi = np.searchsorted(start, b, "left")  # beyond the last one that begins before it ends
    if rule == "first":
        inside = lo < len(start)
        inside[inside] = start[lo[inside]] <= a[inside]
        return np.bincount(lo[inside], minlength=len(start)).astype(float)
    which, place = spread(np.maximum(hi - lo, 0))
    sec = lo[which] + place
    part = np.maximum(np.minimum(b[which], end[sec]) - np.maximum(a[which], start[sec]), 0)
    if rule == "share":
        return np.bincount(sec, part / (b - a)[which], len(start))
    if rule != "most":
        raise ValueError(f"no such rule: {rule}")
    order = np.lexsort((sec, -part, which))
    best = order[np.append(True, which[order][1:] != which[order][:-1])] if len(order) else order
    return np.bincount(sec[best][part[best] > 0], minlength=len(start)).astype(float)


def line_sections(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each line with its line feed; an empty text is one empty line."""
    cut = np.unique(np.concatenate([off[:-1], np.flatnonzero(data == 10) + 1]))
    cut = cut[cut < len(data)]
    start = np.concatenate([cut, off[:-1][np.diff(off) == 0]])
    row = np.concatenate([np.searchsorted(off, cut, "right") - 1, np.flatnonzero(np.diff(off) == 0)])
    stop = np.concatenate([np.append(cut[1:], len(data))[: len(cut)], off[:-1][np.diff(off) == 0]])
    order = np.lexsort((stop, start, row))
    return row[order], start[order], stop[order]


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per line: doc_id, section, start, end (code points), n_tokens, n_crossing (tokens begun here that end beyond), doc_tokens."""
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        enc, length = encoder(sent.value)
        for b in batches:
            for lo, hi, data, off in doc_chunks(b.column(1), 1 << 21):
                raw = data.tobytes()
                bounds, many = [np.zeros(1, np.int64)], np.zeros(hi - lo, np.int64)
                for d in range(hi - lo):
                    if off[d] < off[d + 1]:
                        size = length[enc.encode_to_numpy(raw[off[d] : off[d + 1]].decode(), disallowed_special=())]
                        many[d] = len(size)
                        bounds.append(off[d] + np.cumsum(size))
                tok = np.concatenate(bounds)
                row, start, end = line_sections(data, off)
                some = np.flatnonzero(end > start)
                n, crossing = np.zeros(len(row)), np.zeros(len(row), np.int64)
                n[some] = attribute(tok, start[some], end[some], rule)
                first = np.searchsorted(end[some], tok[:-1], "right")
                crossing[some] = np.bincount(first[tok[1:] > end[some][first]], minlength=len(some)) if len(some) else 0
                point = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=point[1:])
                base = point[off[:-1]][row]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + row)), pa.array(place), pa.array(point[start] - base), pa.array(point[end] - base), pa.array(n if rule == "share" else n.astype(np.int64)), pa.array(crossing), pa.array(many[row])], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    kind = "double" if rule == "share" else "long"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id long, section long, start long, end long, n_tokens {kind}, n_crossing long, doc_tokens long")


def field_tokens(rows: DataFrame, id_col: str, fields: list[str], separator: str = "\n", rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row and field, the fields encoded as one text: id, field, n_tokens, doc_tokens. A null field is empty."""
    with open(vocabulary, "rb") as f:
        sent = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        enc, length = encoder(sent.value)
        for b in batches:
            cols = [c.to_pylist() for c in b.columns[1:]]
            out, total = [], []
            for values in zip(*cols):
                parts = [(x or "").encode() for x in values]
                size = np.array([len(p) for p in parts])
                start = np.append(0, np.cumsum(size + len(separator.encode()))[:-1])
                text = separator.encode().join(parts)
                tok = np.append(0, np.cumsum(length[enc.encode_to_numpy(text.decode(), disallowed_special=())])) if text else np.zeros(1, np.int64)
                some = np.flatnonzero(size)
                n = np.zeros(len(parts))
                n[some] = attribute(tok, start[some], (start + size)[some], rule)
                out.append(n)
                total.append(len(tok) - 1)
            k = len(fields)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), k)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(fields * b.num_rows), pa.array(np.concatenate(out) if out else np.zeros(0)), pa.array(np.repeat(np.array(total, np.int64), k))], names=[id_col, "field", "n_tokens", "doc_tokens"])

    picked = rows.select(F.col(id_col).cast("long").alias(id_col), *(F.col(c).cast("string").alias(c) for c in fields))
    return picked.mapInArrow(run, f"{id_col} long, field string, n_tokens double, doc_tokens long")


def op6_section_tokens(spark, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))
