"""Conversation structure repair on a suffix-shared automaton.

A conversation is read as a signature: one byte a row, for what an edit can do with it (must
go; or its role's initial, and whether its text is cut short). Signatures are sorted from
their ends, so that those with a common ending lie side by side, and an automaton whose nodes
are the distinct endings grows along that order: a node's cheapest way to a lawful end, for
each state of the grammar ``(s?(ua)+)?``, is computed once and serves every conversation that
ends so. Nodes of equal relative costs are one node to what comes before them and share one
transition (`Automaton.steps`), so long conversations do not make it grow.

Letters: D delete, I insert, K keep, R rerole. From one state of one node each letter leads to
one place, so the least letter among the cheapest gives the least audit.

Order and ties: rows go by turn, nulls first; rows of one turn by role, then by the SHA-256
of their text. Null roles and texts are one space, as is a null id or turn in the key of the
damage. Rows of a null conv_id are one conversation. Roles other than system, user and
assistant count by their first letter; an empty role has none. Two rows repeat each other if
role and SHA-256 of the text are equal. Empty tables give no rows; other columns are ignored.

Scale: roles, turns and digests are shuffled once by conversation, signatures once by their
ends (conversations of one signature may lie in many tasks), and the texts once. A
conversation's rows pass through one task as a sorted stream, since its digest is computed in
order; what is held of it is its signature, its nodes and its audit, some 20 bytes a row.
Nothing goes through the driver.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, shuffle_parts, table

SPACES = " \t\n\x0b\f\r"
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
#: Initials that a grammar state can take, and the state after. 0: begin, 1: after s, 2: after u, 3: after a.
MOVES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
_NEVER = 1 << 40
_GONE = ord("x")  # a row that must be deleted; others are the initial, in capitals if the text is cut short
_ENDING = 64  # so much of a signature's end deals it to a task


# ------------------------------------------------------------------ the damaged rows


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped of every row after the damage; a dropped row stays, marked."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % F.lit(20)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    held = rows.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    return held.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
    ).drop("again")


def _runs(conv: pa.Array) -> tuple[np.ndarray, list]:
    """Where the runs of equal ids of a sorted column begin, with the end, and the id of each."""
    null = conv.is_null().to_numpy(zero_copy_only=False)
    value = conv.fill_null(0).to_numpy()
    new = np.append(True, (value[1:] != value[:-1]) | (null[1:] != null[:-1]))
    first = np.flatnonzero(new)
    return np.append(first, len(value)), [None if null[k] else int(value[k]) for k in first]


class _Marks:
    """What is known of the conversation that a stream is in."""

    def __init__(self, conv):
        self.conv, self.signature, self.last, self.turn = conv, [], None, None
        self.counts = np.zeros(4, np.int64)  # blank, duplicate, truncated, illegal
        self.low = self.high = None
        self.turns = 0

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, int(gaps), *map(int, self.counts), b"".join(self.signature)


_LAWFUL = np.zeros((256, 256), bool)
for _a, _b in ("su", "ua", "au"):
    _LAWFUL[ord(_a), ord(_b)] = True


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place -> one row for each conversation."""
    held: _Marks | None = None
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.binary()]
        cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"])

    for b in batches:
        if not b.num_rows:
            continue
        first, ids = _runs(b.column(0))
        turn_null = b.column(1).is_null().to_numpy(zero_copy_only=False)
        turn = b.column(1).fill_null(0).to_numpy()
        initial, fault, dropped = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
        initial = initial.astype(np.uint8)
        symbol = np.where(fault == 3, initial & 0xDF, initial)
        symbol = np.where((fault == 1) | (fault == 2), _GONE, symbol).astype(np.uint8)
        for a, z, conv in zip(first[:-1], first[1:], ids, strict=True):
            if held is None or held.conv != conv:
                if held is not None:
                    out.append(held.row())
                held = _Marks(conv)
            keep = ~dropped[a:z]
            if not keep.any():
                continue
            f, i = fault[a:z][keep], initial[a:z][keep]
            held.counts[:3] += np.bincount(f, minlength=4)[1:]
            pair = i if held.last is None else np.append(held.last, i)
            held.counts[3] += int((~_LAWFUL[pair[:-1], pair[1:]]).sum())
            held.last = i[-1]
            t = turn[a:z][keep & ~turn_null[a:z]]
            if len(t):
                held.turns += int((t[1:] != t[:-1]).sum()) + (held.high is None or held.high != t[0])
                held.low = int(t[0]) if held.low is None else held.low
                held.high = int(t[-1])
            held.signature.append(symbol[a:z][keep].tobytes())
        if len(out) >= 10_000:
            yield flush()
    if held is not None:
        out.append(held.row())
    if out:
        yield flush()


def signatures(rows: DataFrame) -> DataFrame:
    """One row for each conversation of damaged(): conv_id, gaps, blank, duplicate, truncated, illegal, signature."""
    tail = F.rtrim("text", F.lit(SPACES))
    light = rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "dropped",
        # an initial beyond Latin letters is like one that no grammar takes
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.ascii("role")).otherwise(ord("o")).alias("initial"),
        (tail == "").alias("blank"), (~F.substring(tail, -1, 1).isin(".", "!", "?")).alias("cut_short"),
    )
    seen = Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    dealt = light.repartition("conv_id").withColumn("before", F.row_number().over(seen) > 1)
    fault = F.when(F.col("dropped"), 0).when(F.col("blank"), 1).when(F.col("before"), 2).when(F.col("cut_short"), 3).otherwise(0)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "before"]
    stream = dealt.sortWithinPartitions(*order).select("conv_id", "turn", "initial", fault.cast("int").alias("fault"), "dropped")
    return stream.mapInArrow(_signatures, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature binary")


# ------------------------------------------------------------------ the automaton


class Automaton:
    """The distinct endings on the way to the end of the signature that is being read, and what is known of each."""

    def __init__(self):
        #: (symbol, relative costs of the node behind) -> (what all costs rise by, relative costs, letters)
        self.steps: dict[tuple[int, tuple[int, ...]], tuple[int, tuple[int, ...], str]] = {}
        base = [0 if q in ENDS else _NEVER for q in range(4)]
        cost, letters = self._with_inserts(base, ["-"] * 4)
        # of the endings of length 0, 1, ...: what all costs have in common, and the node: relative costs and letters
        self.total, self.nodes = array("q", [0]), [(0, cost, letters)]
        self.read = b""  # the ending that the nodes follow, its end first

    @staticmethod
    def _with_inserts(base: list[int], letters: list[str]) -> tuple[tuple[int, ...], str]:
        """Each state's least cost where rows may be inserted first: a state's insert leads to 2, that of 2 to 3."""
        cost = list(base)
        for q in (2, 3, 2, 0, 1):
            then = cost[3 if q == 2 else 2] + INSERT_COST
            if then < cost[q] or then == cost[q] and "I" < letters[q]:
                cost[q], letters[q] = then, "I"
        return tuple(cost), "".join(letters)

    def _step(self, symbol: int, behind: tuple[int, ...]) -> tuple[int, tuple[int, ...], str]:
        got = self.steps.get((symbol, behind))
        if got is None:
            base, letters = [], []
            late = TRUNCATED_COST if 65 <= symbol <= 90 else 0
            initial = chr(symbol | 0x20)
            for q in range(4):
                ways = [(behind[q] + DELETE_COST, "D")]
                if symbol != _GONE:
                    if initial in MOVES[q]:
                        ways.append((behind[MOVES[q][initial]] + KEEP_COST + late, "K"))
                    ways += [(behind[to] + REROLE_COST + late, "R") for role, to in MOVES[q].items() if role != "s"]
                c, letter = min(ways)
                base.append(c)
                letters.append(letter)
            cost, marks = self._with_inserts(base, letters)
            least = min(cost)
            got = self.steps[symbol, behind] = least, tuple(c - least for c in cost), marks
        return got

    def repair(self, signature: bytes) -> tuple[int, str]:
        """Cost and audit. Nodes of the ending that this signature shares with the one before are used again."""
        ending = signature[::-1]
        # the shared ending, found by halving: equal prefixes of the two reversed signatures
        lo, hi = 0, min(len(ending), len(self.read))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if ending[:mid] == self.read[:mid]:
                lo = mid
            else:
                hi = mid - 1
        del self.total[lo + 1 :], self.nodes[lo + 1 :]
        for symbol in ending[lo:]:
            node = self._step(symbol, self.nodes[-1][1])
            self.total.append(self.total[-1] + node[0])
            self.nodes.append(node)
        self.read = ending
        k = n = len(signature)
        q, audit = 0, bytearray()
        while True:
            letter = self.nodes[k][2][q]
            if letter == "-":
                return self.total[n] + self.nodes[n][1][0], audit.decode()
            audit.append(ord(letter))
            if letter == "I":
                q = 3 if q == 2 else 2
                continue
            if letter == "K":
                q = MOVES[q][chr(signature[n - k] | 0x20)]
            elif letter == "R":
                q = 3 if q == 2 else 2
            k -= 1


def audits(signed: DataFrame) -> DataFrame:
    """The rows of signatures() with cost and audit in the place of the signature."""
    names = [c for c in signed.columns if c != "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, before, found = Automaton(), None, (0, "")
        for b in batches:
            cost, audit = [], []
            for s in b.column("signature").to_pylist():
                if s != before:
                    before, found = s, automaton.repair(s)
                cost.append(found[0])
                audit.append(found[1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], names=[*names, "cost", "audit"])

    ending = F.reverse(F.col("signature").cast("string"))
    spread = signed.withColumn("ending", ending).repartitionByRange(shuffle_parts(signed.sparkSession), F.substring("ending", 1, _ENDING), "conv_id")
    return spread.sortWithinPartitions("ending").drop("ending").mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


# ------------------------------------------------------------------ the repaired rows


class _Repair:
    """Edits of one conversation, applied to its rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._next(), ""

    def _next(self) -> str:
        self.state = 3 if self.state == 2 else 2
        return "assistant" if self.state == 3 else "user"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = MOVES[self.state][role[0]]
            yield role, text
        elif letter == "R":
            yield self._next(), text

    def rest(self) -> Iterator[tuple[str, str]]:
        yield from self._inserts()


def _stream(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Each conversation's row of repairs, then its damaged rows in order; each task has whole conversations."""
    marks = [c for c in repairs.columns if c != "conv_id"]
    kinds = dict(repairs.dtypes)
    head = repairs.select("conv_id", F.lit(True).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *marks)
    body = rows.filter(~F.col("dropped")).select("conv_id", F.lit(False).alias("head"), "turn", "role", "text", *(F.lit(None).cast(kinds[c]).alias(c) for c in marks))
    order = [F.col("conv_id").asc_nulls_first(), F.col("head").desc(), F.col("turn").asc_nulls_first(), "role", F.sha2("text", 256)]
    return head.unionByName(body).repartition("conv_id").sortWithinPartitions(*order)


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id: the counts, cost, audit and repaired_sha256 of the rows that the audit leaves."""
    rows = damaged(conversations)
    repairs = audits(cut(signatures(rows)))
    names = repairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: list | None = None
        edits: _Repair = _Repair("")
        digest, some = hashlib.sha256(), False
        out: list[list] = []

        def put(pieces: Iterator[tuple[str, str]]) -> None:
            nonlocal some
            for role, text in pieces:
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True

        def close() -> None:
            if head is not None:
                put(edits.rest())
                out.append([*head, digest.hexdigest()])

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=[*names, "repaired_sha256"])

        for b in batches:
            is_head = b.column("head").to_pylist()
            roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
            for k, new in enumerate(is_head):
                if new:
                    close()
                    head = [b.column(c)[k].as_py() for c in names]
                    edits, digest, some = _Repair(head[-1]), hashlib.sha256(), False
                else:
                    put(edits.row(roles[k], texts[k]))
            if len(out) >= 1_000:
                yield flush()
        close()
        if out:
            yield flush()

    return _stream(rows, repairs).mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """The rows themselves: conv_id, place (0, 1, ...), role, text. The repair of a table, where repair() describes it."""
    rows = damaged(conversations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, edits, place = None, _Repair(""), 0
        for b in batches:
            out: list[tuple] = []

            def put(pieces: Iterator[tuple[str, str]]) -> None:
                nonlocal place
                for role, text in pieces:
                    out.append((conv, place, role, text))  # noqa: B023  used up within the batch
                    place += 1

            ids, is_head, roles, texts, letters = (b.column(c).to_pylist() for c in ("conv_id", "head", "role", "text", "audit"))
            for k, new in enumerate(is_head):
                if new:
                    put(edits.rest())
                    conv, edits, place = ids[k], _Repair(letters[k]), 0
                else:
                    put(edits.row(roles[k], texts[k]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "place", "role", "text"])
        last = [(conv, place + i, role, text) for i, (role, text) in enumerate(edits.rest())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in last], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "place", "role", "text"])

    return _stream(rows, audits(cut(signatures(rows))).select("conv_id", "audit")).mapInArrow(run, "conv_id long, place long, role string, text string")


def op13_suffix_automaton(spark, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
    FROM conversations
), hashed AS (
    SELECT conv_id, turn, role, text,
        xor(list_reduce([4294967295::UBIGINT] || list_transform(range(8 * length(key)), lambda i: CASE WHEN i % 8 = 0 THEN ord(key[i // 8 + 1])::UBIGINT ELSE 0::UBIGINT END),
            lambda c, b: CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) // 2, 3988292384::UBIGINT) ELSE xor(c, b) // 2 END), 4294967295::UBIGINT) % 20 AS kind
    FROM keyed
), rows AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
    FROM hashed, (SELECT unnest([0, 1]) AS copy) AS copies
    WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
    SELECT conv_id, turn, role, text, row_number() OVER w AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS before, rtrim(text, E' \t\n\x0b\f\r') AS tail,
        lag(role[1]) OVER w AS last
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), faults AS (
    SELECT conv_id, turn, role, text, k, last, role[1] AS i, CASE WHEN tail = '' THEN 1 WHEN before THEN 2 WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
    FROM placed
), told AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
        count_if(k > 1 AND last || i NOT IN ('su', 'ua', 'au')) AS illegal, list(role ORDER BY k) AS roles, list(text ORDER BY k) AS texts, list(i ORDER BY k) AS initials, list(fault ORDER BY k) AS faults
    FROM faults GROUP BY conv_id
), ways AS (  -- from row k on, for each state of the grammar: the least cost, and of these the least audit
    SELECT conv_id, n AS k, initials, faults, {'c': 0, 'a': ''} AS q0, {'c': 6, 'a': 'II'} AS q1, {'c': 3, 'a': 'I'} AS q2, {'c': 0, 'a': ''} AS q3 FROM told
    UNION ALL
    SELECT conv_id, k, initials, faults,
        list_min([b0, {'c': b2.c + 3, 'a': 'I' || b2.a}, {'c': b3.c + 6, 'a': 'II' || b3.a}]), list_min([b1, {'c': b2.c + 3, 'a': 'I' || b2.a}, {'c': b3.c + 6, 'a': 'II' || b3.a}]),
        list_min([b2, {'c': b3.c + 3, 'a': 'I' || b3.a}]), list_min([b3, {'c': b2.c + 3, 'a': 'I' || b2.a}])
    FROM (
        SELECT conv_id, k - 1 AS k, initials, faults,
            list_min([{'c': q0.c + 4, 'a': 'D' || q0.a}] || CASE WHEN free THEN [{'c': q2.c + 3 + late, 'a': 'R' || q2.a}] ELSE [] END
                || CASE WHEN free AND i = 's' THEN [{'c': q1.c + late, 'a': 'K' || q1.a}] WHEN free AND i = 'u' THEN [{'c': q2.c + late, 'a': 'K' || q2.a}] ELSE [] END) AS b0,
            list_min([{'c': q1.c + 4, 'a': 'D' || q1.a}] || CASE WHEN free THEN [{'c': q2.c + 3 + late, 'a': 'R' || q2.a}] ELSE [] END || CASE WHEN free AND i = 'u' THEN [{'c': q2.c + late, 'a': 'K' || q2.a}] ELSE [] END) AS b1,
            list_min([{'c': q2.c + 4, 'a': 'D' || q2.a}] || CASE WHEN free THEN [{'c': q3.c + 3 + late, 'a': 'R' || q3.a}] ELSE [] END || CASE WHEN free AND i = 'a' THEN [{'c': q3.c + late, 'a': 'K' || q3.a}] ELSE [] END) AS b2,
            list_min([{'c': q3.c + 4, 'a': 'D' || q3.a}] || CASE WHEN free THEN [{'c': q2.c + 3 + late, 'a': 'R' || q2.a}] ELSE [] END || CASE WHEN free AND i = 'u' THEN [{'c': q2.c + late, 'a': 'K' || q2.a}] ELSE [] END) AS b3
        FROM (SELECT *, initials[k] AS i, faults[k] NOT IN (1, 2) AS free, CASE WHEN faults[k] = 3 THEN 3 ELSE 0 END AS late FROM ways WHERE k > 0)
    )
), best AS (
    SELECT conv_id, q0.c AS cost, q0.a AS audit FROM ways WHERE k = 0
), edits AS (
    SELECT t.conv_id, b.cost, b.audit, roles, texts, unnest(range(1, length(b.audit) + 1)) AS e FROM told AS t JOIN best AS b ON t.conv_id IS NOT DISTINCT FROM b.conv_id
), kept AS (
    SELECT conv_id, e, audit[e] AS letter, e - length(replace(audit[1:e], 'I', '')) AS inserts, roles, texts FROM edits WHERE audit[e] <> 'D'
), lines AS (
    SELECT conv_id, e, letter, CASE WHEN letter = 'I' THEN '' ELSE texts[e - inserts] END AS text, roles[e - inserts] AS role,
        row_number() OVER (PARTITION BY conv_id ORDER BY e) - max(CASE WHEN letter = 'K' AND roles[e - inserts][1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS place
    FROM kept
), repaired AS (
    SELECT conv_id, sha256(string_agg((CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY e)) AS digest FROM lines GROUP BY conv_id
)
SELECT c.conv_id, coalesce(t.gaps, 0)::BIGINT AS gaps, coalesce(t.blank, 0)::BIGINT AS blank, coalesce(t.duplicate, 0)::BIGINT AS duplicate, coalesce(t.truncated, 0)::BIGINT AS truncated,
    coalesce(t.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, coalesce(r.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN told AS t ON c.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN best AS b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired AS r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""
