"""Repair of conversations by the cheapest edits that give them the structure (s?(ua)+)?

A conversation is its rows in order of turn (null first; rows of one turn by role, then text, then
copy). Its first row may be a system's, then user and assistant alternate, the assistant speaks last;
it may also be empty.

Faults. A row's first fault counts: blank (nothing but white space), duplicate (its role and text
stood earlier), truncated (its last character that is no white space is none of .!?).

Repair. A Viterbi pass runs forward over the rows with four grammar states: nothing yet, after the
system, after a user, after an assistant. A row is kept (0), given the role that the state asks for
(2) or deleted (3; blank and duplicate rows must be); a truncated row that stays costs 1. Before each
row, and at the end, up to two empty rows may be inserted (2 each): more would pass a state twice.
Of equal costs the least string of edits (K, R, D, I) wins. Strings need not be kept for that: after a
row's layer all of them hold as many edits of rows and end in one, so none begins another, and the
order of two follows from the order of those they extend and from at most three letters. A row
leaves four bytes, from which the edits are read backwards.

Rows are sorted by Spark and streamed through the tasks, a conversation never being held whole: the
first pass gives counts, cost and edits, the second meets the edits before the rows and replays them.
A conversation of very many rows is the work of one task, as the digest of its text must be.

Nulls count as one space in role and text (such a role fits nowhere, such a text is blank) and in the
key that damaged() hashes; a null conv_id is a conversation like any other; rows of several turns
that are equal are told apart by turn. Very long texts are streamed. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import ragged
from tessera.llm.shared import written

START, SYSTEM, USER, ASSISTANT = range(4)
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
SUFFIXES = [i + e for i in ("", "I", "II") for e in "KRD"]
MOST = 2**63 - 1

_INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_CODES = [(c, f) for c in ("s", "u", "a", "") for f in (0, BLANK, DUPLICATE, TRUNCATED)]


def _moves(initial: str, fault: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of a row: for each pair of states the cheapest, then the least, edits."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for p in range(4):
        q = p
        for k in range(3):
            after = [(q, DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                cut = CUT_OFF if fault == TRUNCATED else 0
                to = ASSISTANT if q == USER else USER
                after.append((to, REROLE + cut, "R"))
                if initial == ("a" if q == USER else "u"):
                    after.append((to, KEEP + cut, "K"))
                if initial == "s" and q == START:
                    after.append((SYSTEM, KEEP + cut, "K"))
            for to, cost, edit in after:
                found = (INSERT * k + cost, "I" * k + edit)
                best[p, to] = min(best.get((p, to), found), found)
            q = _INSERTED[q]
    return [(p, to, cost, edits) for (p, to), (cost, edits) in best.items()]


MOVES = {code: _moves(*code) for code in _CODES}


class Viterbi:
    """The forward pass over one conversation: costs and order of the four states, back pointers."""

    def __init__(self) -> None:
        self.cost: list[int | None] = [0, None, None, None]
        self.rank = [0, 1, 2, 3]
        self.back = bytearray()

    def row(self, initial: str, fault: int) -> None:
        new: list[tuple[int, int, str, int] | None] = [None] * 4
        cost, rank = self.cost, self.rank
        for p, q, more, edits in MOVES[initial, fault]:
            if cost[p] is not None:
                found = (cost[p] + more, rank[p], edits, p)
                if new[q] is None or found < new[q]:
                    new[q] = found
        order = sorted((q for q in range(4) if new[q]), key=lambda q: new[q][1:3])
        self.cost = [n and n[0] for n in new]
        for r, q in enumerate(order):
            self.rank[q] = r
        self.back += bytes(n[3] + 4 * SUFFIXES.index(n[2]) if n else 255 for n in new)

    def end(self) -> tuple[int, str]:
        """(cost, edits) of the cheapest way to a whole conversation."""
        closing = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
        cost, _, q = min((self.cost[p] + INSERT * k, self.rank[p], p) for p, k in closing.items() if self.cost[p] is not None)
        edits = ["I" * closing[q]]
        for at in range(len(self.back) - 4, -1, -4):
            code = self.back[at + q]
            edits.append(SUFFIXES[code >> 2])
            q = code & 3
        return cost, "".join(reversed(edits))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after damage by crc32("conv_id:turn") mod 20: 0 drops the row, 1
    empties its text, 2 takes .!? out of it, 3 repeats the row, 4 makes it the user's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def in_order(rows: DataFrame, *before: str) -> DataFrame:
    """Rows dealt by conversation and sorted within it."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *before, F.col("turn").asc_nulls_first(), "role", "text", "copy")


def flagged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, copy) with fault: 0, BLANK, DUPLICATE or TRUNCATED."""
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.row_number().over(same) > 1, DUPLICATE).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(0)
    return rows.repartition("conv_id").withColumn("fault", fault)


def _streamed(make: Callable[[], object], names: list[str], kinds: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over sorted rows whose first column is conv_id: make() gives an object for each
    conversation, whose add(*columns) takes a row and returns rows, and whose end() returns its last ones."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, out = None, None, []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

        for b in it:
            for first, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or first != key:
                    if now is not None:
                        out += [(key, *r) for r in now.end()]
                    now, key = make(), first
                out += [(key, *r) for r in now.add(*rest)]
            if out:
                yield packed()
                out = []
        if now is not None:
            out += [(key, *r) for r in now.end()]
        yield packed()

    return ragged.tidy(batches)


class _Assessment:
    def __init__(self) -> None:
        self.path, self.last, self.turn, self.low = Viterbi(), None, None, None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def add(self, turn: int | None, initial: str, fault: int) -> list[tuple]:
        if turn is not None and turn != self.turn:
            self.turns, self.turn, self.low = self.turns + 1, turn, turn if self.low is None else self.low
        self.illegal += self.last is not None and (self.last, initial) not in LEGAL
        self.last = initial
        self.faults[fault] += 1
        self.path.row(initial if initial in ("s", "u", "a") else "", fault)
        return []

    def end(self) -> list[tuple]:
        cost, audit = self.path.end()
        gaps = self.turn - self.low + 1 - self.turns if self.turns else 0
        return [(min(gaps, MOST), *self.faults[1:], self.illegal, cost, audit)]


def assessed(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    flags = flagged(rows).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy").select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    kind = rows.schema["conv_id"].dataType
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    types = [_arrow(kind), *[pa.int64()] * 6, pa.string()]
    schema = f"conv_id {kind.simpleString()}, " + ", ".join(f"{n} bigint" for n in names[1:-1]) + ", audit string"
    return flags.mapInArrow(_streamed(_Assessment, names, types), schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class _Replay:
    """The rows of a repaired conversation, from its edits and then its rows."""

    def __init__(self) -> None:
        self.audit, self.at, self.place, self.shift = "", 0, 0, 0

    def add(self, audit: str | None, role: str | None, text: str | None) -> list[tuple]:
        if audit is not None:
            self.audit, self.shift = audit, (len(audit) - audit.count("D")) % 2
            return []
        out = self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            out.append(self._row(role if edit == "K" else self._role(), text, edit))
        return out

    def _role(self) -> str:
        return ("user", "assistant")[(self.place - self.shift) % 2]

    def _row(self, role: str, text: str, edit: str) -> tuple:
        self.place += 1
        return self.place - 1, role, text, edit

    def _inserted(self) -> list[tuple]:
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            out.append(self._row(self._role(), "", "I"))
        return out

    def end(self) -> list[tuple]:
        return self._inserted()


class _Digest(_Replay):
    def __init__(self) -> None:
        super().__init__()
        self.sha = hashlib.sha256()

    def _fed(self, rows: list[tuple]) -> None:
        for place, role, text, _ in rows:
            self.sha.update((("\n" if place else "") + f"{role}:{text}").encode())

    def add(self, audit: str | None, role: str | None, text: str | None) -> list[tuple]:
        self._fed(super().add(audit, role, text))
        return []

    def end(self) -> list[tuple]:
        self._fed(super().end())
        return [(self.sha.hexdigest(),)]


def _with_edits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's edits, then its rows in order."""
    none = F.lit(None).cast("string")
    heads = audits.select("conv_id", F.lit(0).alias("is_row"), F.lit(None).cast("bigint").alias("turn"), none.alias("role"), none.alias("text"), F.lit(0).alias("copy"), "audit")
    return in_order(heads.unionByName(rows.select("conv_id", F.lit(1).alias("is_row"), "turn", "role", "text", "copy", none.alias("audit"))), "is_row").select("conv_id", "audit", "role", "text")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the repaired conversations' rows."""
    kind = rows.schema["conv_id"].dataType
    names, types = ["conv_id", "place", "role", "text", "edit"], [_arrow(kind), pa.int64(), pa.string(), pa.string(), pa.string()]
    return _with_edits(rows, audits).mapInArrow(_streamed(_Replay, names, types), f"conv_id {kind.simpleString()}, place bigint, role string, text string, edit string")


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the repaired rows as role:text, joined by newlines."""
    kind = rows.schema["conv_id"].dataType
    return _with_edits(rows, audits).mapInArrow(_streamed(_Digest, ["conv_id", "repaired_sha256"], [_arrow(kind), pa.string()]), f"conv_id {kind.simpleString()}, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Counts, cost, edits and digest of every original conversation after damage and repair. One that
    has no rows left has zeros, no edits and the digest of nothing."""
    rows = damaged(conversations)
    found = written(assessed(rows), "assessed")
    both = found.unionByName(digests(rows, found), allowMissingColumns=True).unionByName(conversations.select("conv_id").distinct(), allowMissingColumns=True)
    numbers = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    texts = [F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")]
    return both.groupBy("conv_id").agg(*numbers, *texts)


def duckdb_sql() -> str:
    """The same over the view conversations: a recursive query carries, for each state, the least (cost,
    edits) with the repaired text."""
    far = "{'c': 1000000000, 'a': '', 'o': ''}"
    more = lambda s, c, a, o: f"{{'c': {s}.c + {c}, 'a': {s}.a || '{a}', 'o': {s}.o || {o}}}"
    stays = "CASE WHEN fault IN (1, 2) THEN 1000000000 WHEN fault = 3 THEN 1 ELSE 0 END"
    own, line = "role || ':' || text || chr(10)", lambda r: f"'{r}:' || text || chr(10)"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS bytes FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0),
n AS (SELECT *, role[1:1] AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen FROM d),
f AS (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM n),
v AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': ''}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM (SELECT DISTINCT conv_id FROM f)
UNION ALL (
WITH e2 AS (SELECT *, {least("s2", more("s0", 2, "I", "'user:' || chr(10)"), more("s1", 2, "I", "'user:' || chr(10)"), more("s3", 2, "I", "'user:' || chr(10)"))} AS t2 FROM v),
e3 AS (SELECT *, {least("s3", more("t2", 2, "I", "'assistant:' || chr(10)"))} AS t3 FROM e2),
e AS (SELECT e3.*, f.i AS j, c, fault, role, text, {least("s0", "s1", "t3")} AS t FROM e3 JOIN f ON f.conv_id IS NOT DISTINCT FROM e3.conv_id AND f.i = e3.i + 1)
SELECT conv_id, j, {more("s0", 3, "D", "''")}, {least(more("s1", 3, "D", "''"), f"CASE WHEN c = 's' THEN {more('s0', stays, 'K', own)} ELSE {far} END")},
 {least(more("t2", 3, "D", "''"), f"CASE WHEN c = 'u' THEN {more('t', stays, 'K', own)} ELSE {far} END", more("t", f"2 + {stays}", "R", line("user")))},
 {least(more("t3", 3, "D", "''"), f"CASE WHEN c = 'a' THEN {more('t2', stays, 'K', own)} ELSE {far} END", more("t2", f"2 + {stays}", "R", line("assistant")))} FROM e)),
z AS (SELECT conv_id, {least("s0", "s3", more("s2", 2, "I", "'assistant:' || chr(10)"), more("s1", 4, "II", "'user:' || chr(10) || 'assistant:' || chr(10)"))} AS b FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
 coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(CASE WHEN b.o <> '' THEN b.o[1:-2] ELSE '' END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM q.conv_id"""
