"""Fill-in-the-middle: texts cut at two places and put together in another order.

A unit is a word with the white space before it, or the white space at the end of a text.
The two places come from a hash of the document's id, so a document is cut alike in every
run and wherever it lies. The work on texts is one pipeline of `pyarrow.compute` calls per
batch: units as lists, flattened with the index of their row, their ordinals, one filter
per role, lists built again, and the pieces joined. Rows stay where they are; no shuffle.

A null text is empty, and an empty text is plain. A text that holds one of the marks is
plain, so that every output can be taken apart again. A null id is hashed as an empty one.
Repeated rows give repeated rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import table
from ._text import doc_chunks, strings

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
_CUT = b"\xff"  # no byte of UTF-8


def draws(id_col: str, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 that depend on the seed and the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _first(parent: pa.Array, rows: int) -> pa.Array:
    """Where each row's values begin, and the end; parent is sorted."""
    return pa.array(np.searchsorted(parent.to_numpy(), np.arange(rows + 1)))


def _joined(values: pa.Array, parent: pa.Array, rows: int) -> pa.Array:
    """The values of each row, which lie in order, as one string; rows without a value get an empty one."""
    return pc.binary_join(pa.ListArray.from_arrays(_first(parent, rows).cast(pa.int32()), values), b"")


def transform(text: pa.Array, h: list[pa.Array], fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text; text has no nulls."""
    rows = len(text)
    plain = pc.equal(pc.binary_length(text), 0)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(text, mark))
    raw = text.cast(pa.binary())

    # units: a cut behind each word; what is left is white space at the end, or nothing
    units = pc.split_pattern(pc.replace_substring_regex(raw, pattern=r"([^\x20\x09-\x0D]+)", replacement=rb"\1" + _CUT), pattern=_CUT)
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    some = pc.greater(pc.binary_length(flat), 0)
    flat, parent = pc.filter(flat, some), pc.filter(parent, some)
    first = _first(parent, rows)
    n = pc.subtract(first[1:], first[:-1])
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(first, parent))

    def below(x: pa.Array) -> pa.Array:  # x modulo n + 1
        m = pc.add(n, 1)
        return pc.subtract(x, pc.multiply(pc.divide(x, m), m))

    def percent(x: pa.Array) -> pa.Array:
        return pc.subtract(x, pc.multiply(pc.divide(x, 100), 100))

    a, b = below(h[0]), below(h[1])
    low, high = pc.take(pc.min_element_wise(a, b), parent), pc.take(pc.max_element_wise(a, b), parent)
    in_prefix, in_suffix = pc.less(ordinal, low), pc.greater_equal(ordinal, high)
    in_middle = pc.invert(pc.or_(in_prefix, in_suffix))
    prefix, middle, suffix = (_joined(pc.filter(flat, role), pc.filter(parent, role), rows) for role in (in_prefix, in_middle, in_suffix))

    plain = pc.or_(plain, pc.greater_equal(percent(h[2]), fim_percent))
    spm = pc.less(percent(h[3]), spm_percent)
    p, s, m = (pa.scalar(x.encode(), pa.binary()) for x in (PREFIX, SUFFIX, MIDDLE))
    none = pa.scalar(b"", pa.binary())
    whole = pc.if_else(
        plain, raw,
        pc.if_else(spm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none), pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)),
    )
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    gone = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, gone, pc.utf8_length(x.cast(pa.string())).cast(pa.int64())) for x in (prefix, middle)]
    return [n, form, *chars, whole.cast(pa.string())]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """Every row of docs: doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output.

    fim_percent of the texts are cut, of these spm_percent begin with the suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in doc_chunks(b.column(1)):
                h = [b.column(2 + k).slice(lo, hi - lo) for k in range(4)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *transform(strings(data, off), h, fim_percent, spm_percent)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(x.alias(f"h{k}") for k, x in enumerate(draws(id_col, seed), 1)))
    return picked.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text before the cuts, from an output and its form. No piece holds a mark, so each mark is the first of its kind."""
    body = output.substr(len(PREFIX) + 1, 2**31 - 1)
    psm = form == "psm"
    ahead = F.when(psm, F.split_part(body, F.lit(SUFFIX), F.lit(1))).otherwise(F.split_part(body, F.lit(PREFIX), F.lit(1)))
    behind = F.split_part(F.when(psm, F.split_part(body, F.lit(SUFFIX), F.lit(2))).otherwise(F.split_part(body, F.lit(PREFIX), F.lit(2))), F.lit(MIDDLE), F.lit(1))
    middle = F.split_part(body, F.lit(MIDDLE), F.lit(2))
    return F.when(form == "plain", output).when(psm, F.concat(ahead, middle, behind)).otherwise(F.concat(behind, middle, ahead))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x
    FROM documents
), drawn AS (
    SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || x[1:8])::UBIGINT::BIGINT AS h1, ('0x' || x[9:16])::UBIGINT::BIGINT AS h2, ('0x' || x[17:24])::UBIGINT::BIGINT AS h3, ('0x' || x[25:32])::UBIGINT::BIGINT AS h4
    FROM units
), placed AS (
    SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), cut AS (
    SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s
    FROM placed
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM cut
"""
