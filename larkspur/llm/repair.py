"""Repair of the structure of conversations: faults found, and the cheapest edits to a legal order of roles.

A legal conversation's role initials are ``(s?(ua)+)?``. Its grammar has four states: nothing written, after the system turn, after a user's
turn and after an assistant's; the first and the last may end a conversation. A forward Viterbi pass goes over each conversation's
turns in order and carries, for each state, the least (cost, audit string) with which it is reached, together with a running digest of
the repaired turns. A layer takes a turn (kept, given another role, or deleted) and is then closed by insertions. A second insertion of the same role
leads back to a state at a higher cost, so two in a row are the most that can pay, and closing takes two steps.

Of two audits of equal cost over the same turns neither is the beginning of the other, as every edit that is more costs more; so the lesser
stays the lesser whatever follows, and a state needs no other. What all four audits begin with is set aside as soon as it is long.

Conversations are sorted within partitions and read as a stream, a batch at a time; turns seen earlier are found by a window. So no task
holds a whole conversation's texts. A conversation's turns are one chain (its digest is of all of them in order), hence read by one task.

Defined cases: null roles and texts count as one space, and so do null ids and turn numbers in what the damage is chosen by; turns are
ordered by number (nulls first), then role, text and whether they are a repeat; repeated rows are turns of their own, and duplicates of
one another; rows with a null conversation id form one conversation; empty roles have an empty initial, which nothing follows legally; other columns are
not used; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: what an edit costs, and what an undeleted truncated turn adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Neighbours that are legal.
LEGAL = ("su", "ua", "au")
#: States, and those that a conversation may end in.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (EMPTY, ASSISTANT)
#: From a state, the state after a turn of this initial.
STEPS = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {"u": "user", "a": "assistant"}
#: Audits are cut at what they share once they are this long.
LONG = 256


class Path:
    """A way to a state: its cost, the end of its audit, and the digest of what it writes."""

    __slots__ = ("audit", "cost", "digest", "written")

    def __init__(self, cost: int, audit: str, digest, written: bool):
        self.cost, self.audit, self.digest, self.written = cost, audit, digest, written

    def before(self, other: Path | None) -> bool:
        return other is None or (self.cost, self.audit) < (other.cost, other.audit)

    def then(self, cost: int, edit: str, line: bytes | None) -> Path:
        """This way and one more edit, which writes line; digests are shared until written to."""
        out = Path(self.cost + cost, self.audit + edit, self.digest, self.written)
        if line is not None:
            out.digest = self.digest.copy()
            out.digest.update(b"\n" + line if self.written else line)
            out.written = True
        return out


def closed(layer: list[Path | None]) -> list[Path | None]:
    """The layer with insertions, two in a row at most."""
    for _ in range(2):
        new = list(layer)
        for state, path in enumerate(layer):
            for initial, role in NAMES.items():
                to = STEPS[initial].get(state)
                if path is None or to is None or (new[to] is not None and path.cost + INSERT > new[to].cost):
                    continue
                more = path.then(INSERT, "I", None)
                if more.before(new[to]):
                    new[to] = path.then(INSERT, "I", f"{role}:".encode())
        layer = new
    return layer


class Conversation:
    """Counts and the four ways of one conversation, turn by turn."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.initial = None
        self.done: list[str] = []
        self.layer = closed([Path(0, "", hashlib.sha256(), False), None, None, None])

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        new: list[Path | None] = [None] * 4
        extra = TRUNCATED if fault == "truncated" else 0
        for state, path in enumerate(self.layer):
            if path is None:
                continue
            ways = [(state, DELETE, "D", None)]
            if fault not in ("blank", "duplicate"):
                if state in STEPS.get(initial, {}):
                    ways.append((STEPS[initial][state], KEEP + extra, "K", role))
                ways += [(STEPS[i][state], REROLE + extra, "R", r) for i, r in NAMES.items() if state in STEPS[i]]
            for to, cost, edit, written in ways:
                if new[to] is None or path.then(cost, edit, None).before(new[to]):
                    new[to] = path.then(cost, edit, None if written is None else f"{written}:{text}".encode("utf-8", "replace"))
        self.layer = closed(new)
        self._set_aside()

    def _set_aside(self) -> None:
        alive = [p for p in self.layer if p]
        least, greatest = min(p.audit for p in alive), max(p.audit for p in alive)
        if len(least) < LONG:
            return
        # the least and the greatest in order share what all share
        n = next((i for i, (x, y) in enumerate(zip(least, greatest)) if x != y), min(len(least), len(greatest)))
        if n:
            self.done.append(least[:n])
            for p in alive:
                p.audit = p.audit[n:]

    def result(self) -> tuple:
        best = min((self.layer[s] for s in ENDS if self.layer[s]), key=lambda p: (p.cost, p.audit))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, "".join(self.done) + best.audit, best.digest.hexdigest()


def _text(x: str) -> Column:
    return F.coalesce(F.col(x).cast("string"), F.lit(" "))


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, again, dropped): every turn as the damage leaves it, by crc32 of ``conv_id:turn`` mod 20.

    0 drops it (it stays as a row that says so, without text), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's.
    """
    kind = F.crc32(F.concat(_text(conv), F.lit(":"), _text(turn))) % 20
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), _text(role).alias("role"), _text(text).alias("text"), kind.alias("kind"))
    k = F.col("kind")
    written = F.when(k.isin(0, 1), "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    shaped = rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), written.alias("text"), (k == 0).alias("dropped"), F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return shaped.select("conv_id", "turn", "role", "text", "dropped", F.explode("copies").alias("again"))


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, dropped, again) with earlier (whether a turn before has its role and text) and the first fault.

    Rows are dealt by conversation once; the window over a conversation's equal turns and the later order both use this dealing.
    """
    order = [F.asc_nulls_first("turn"), F.col("again")]
    dealt = rows.withColumn("digest", F.when(~F.col("dropped"), F.unhex(F.substring(F.sha2("text", 256), 1, 32)))).repartition("conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(*order)) > 1
    ended = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(F.col("dropped"), None).when(ended == "", "blank").when(F.col("earlier"), "duplicate").when(~ended.isin(".", "!", "?"), "truncated")
    return dealt.withColumn("earlier", earlier).withColumn("fault", fault)


def repair(turns: DataFrame, damage: bool = True, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation id of turns: gaps in the turn numbers, numbers of faults and of illegal neighbours, and the cheapest repair.

    Its cost, its audit (initials of the edits: keep, rerole, delete, insert) and the digest of the repaired ``role:text`` lines.
    """
    if damage:
        rows = damaged(turns, conv, turn, role, text)
    else:
        rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), _text(role).alias("role"), _text(text).alias("text"), F.lit(False).alias("dropped"), F.lit(0).alias("again"))
    found = with_faults(rows).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "again", "earlier")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = ", ".join([f"conv_id {rows.schema['conv_id'].dataType.simpleString()}", *(f"{c} bigint" for c in counts), "audit string", "repaired_sha256 string"])

    def finished(out: list, kind: pa.DataType) -> pa.RecordBatch:
        results = [c.result() for _, c in out]
        columns = [pa.array([r[i] for r in results], pa.int64() if i < len(counts) else pa.string()) for i in range(len(counts) + 2)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], kind), *columns], names=["conv_id", *counts, "audit", "repaired_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, kind = None, None, None
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for key, n, who, what, dropped, fault in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if own is None or key != last:
                    out += [(last, own)] if own else []
                    last, own = key, Conversation()
                if not dropped:
                    own.add(n, who, what, fault)
            yield finished(out, kind)
        if own:
            yield finished([(last, own)], kind)

    return found.select("conv_id", "turn", "role", "text", "dropped", "fault").mapInArrow(run, schema)


def _oracle() -> str:
    """The same rows in DuckDB's SQL: the states' (cost, audit, text) go from turn to turn in a recursive query."""
    add = lambda s, cost, edit, line=None: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 't': {f'concat_ws(chr(10), {s}.t, {line})' if line else f'{s}.t'}}} END"  # noqa: E731
    least = lambda *ways: f"list_min([{', '.join(ways)}])"  # noqa: E731
    live = "coalesce(fault, '') NOT IN ('blank', 'duplicate')"
    keep = lambda s, i: f"CASE WHEN {live} AND left(role, 1) = '{i}' THEN {add(s, 'extra', 'K', 'role || chr(58) || text')} END"  # noqa: E731
    rerole = lambda s, r: f"CASE WHEN {live} THEN {add(s, '2 + extra', 'R', f'{chr(39)}{r}:{chr(39)} || text')} END"  # noqa: E731
    insert = lambda s, r: add(s, 2, "I", f"'{r}:'")  # noqa: E731
    closing = f"e, s, {least('u', *(insert(x, 'user') for x in 'esa'))} AS u, {least('a', insert('u', 'assistant'))} AS a"
    start = "{'c': 0::BIGINT, 'a': '', 't': NULL::VARCHAR}"
    none = f"CASE WHEN false THEN {start} END"
    return rf"""
WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
keyed AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (
  SELECT keyed.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, y: xor(x >> 8, t[CAST((xor(x, y) & 255) + 1 AS BIGINT)])), 4294967295) % 20 AS kind
  FROM keyed, tbl
),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM kinds WHERE kind <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS n FROM hurt),
ended AS (SELECT *, regexp_extract(text, '(?s)([^ 	-])[ 	-]*$', 1) AS z, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS earlier, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
turns AS (SELECT *, CASE WHEN z = '' THEN 'blank' WHEN earlier THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM ended),
steps AS (SELECT *, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra FROM turns),
layers AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, {start} AS e, {none} AS s, {{'c': 2::BIGINT, 'a': 'I', 't': 'user:'}} AS u, {{'c': 4::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS a FROM conversations
  UNION ALL
  SELECT conv_id, n, {closing} FROM (SELECT conv_id, n, {closing} FROM (
    SELECT l.conv_id, t.n, {add("e", 3, "D")} AS e, {least(add("s", 3, "D"), keep("e", "s"))} AS s,
           {least(add("u", 3, "D"), *(keep(x, "u") for x in "esa"), *(rerole(x, "user") for x in "esa"))} AS u, {least(add("a", 3, "D"), keep("u", "a"), rerole("u", "assistant"))} AS a
    FROM layers l JOIN steps t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.n = l.n + 1))
),
ends AS (SELECT conv_id, arg_max({least("e", "a")}, n) AS x FROM layers GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       x.c AS cost, x.a AS audit, sha256(coalesce(x.t, '')) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE = _oracle()
