"""Chat formatting as a forest of prefixes: turns that conversations share from the start are written once.

A node is a turn together with all turns before it. Conversations with the same initial turns meet in the same
nodes, so shared text is stored once. A node is stored with its parent. The forest is laid out depth-first, siblings by
their digest: sums over subtrees and over siblings give each node its interval in the stream. Nodes without a choice are contracted first: a chain of only
children is walked as a sorted stream along the longest conversation through it, and becomes one node. Sums are then carried down and up the chains by
doubling, in as many rounds as the branchings on a way have bits, however long a conversation is. Each node also has the position of its first
unit within its own conversations, and can be given the intervals of its ancestors, which are what its units may
attend to besides earlier units of the node itself. Units are code points, or tokens (``token_forest``).

A conversation is read by one task, sorted and in batches; neither a task nor the driver holds a whole conversation or
the whole stream, however many conversations share a turn.

The template writes a turn as ``### role: text </turn>`` and a line feed. A backslash goes before every backslash,
``###`` and ``</turn>`` inside a text; roles have ``%``, ``#``, ``:`` and ``<`` percent-encoded. Both are reversible.

Defined cases: null roles and texts count as empty; rows of a conversation with equal turn numbers go by role and
digest of the text, repeated rows are repeated turns, null turn numbers come first; rows with a null conversation id form one
conversation; other columns are not used; an empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import checkpoint

#: Fixed values of the template.
BEGIN, AFTER_ROLE, END = "### ", ": ", " </turn>\n"
#: The role whose texts are under the loss mask.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|###|</turn>)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


_ROLE_CODES = [("%", "%25"), ("#", "%23"), (":", "%3A"), ("<", "%3C")]


def escape_role(role: Column) -> Column:
    for plain, code in _ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def segment(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), escape_role(role), F.lit(AFTER_ROLE), escape(text), F.lit(END))


def conversation_paths(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", with_text: bool = True) -> DataFrame:
    """(conv_id, length, depth, role, text, node, parent): one row per turn; node digests the turn and all before it (128 bits), length is the conversation's.

    Conversations are sorted within partitions and read once, so a task holds a batch of turns, however long one is.
    Without text only digests are shuffled, and there is no length.
    """
    whole_text = F.coalesce(text, F.lit(""))
    kept = ["length", "text"] if with_text else []
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), _digest(whole_text).alias("digest"), *([whole_text.alias("text")] if with_text else []))
    dealt = rows.repartition("conv_id")
    if with_text:
        dealt = dealt.withColumn("length", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    placed = dealt.sortWithinPartitions("conv_id", "turn", "role", "digest").select("conv_id", "role", "digest", *kept)
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, role string, {'length bigint, text string, ' if with_text else ''}depth int, node binary, parent binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, node, depth = object(), None, 0
        for batch in batches:
            depths, nodes, parents = [], [], []
            for own, r, d in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if own != last:
                    last, node, depth = own, None, 0
                parents.append(node)
                node = hashlib.sha256((node or b"") + hashlib.sha256(r.encode()).digest()[:16] + d).digest()[:16]
                depth += 1
                depths.append(depth)
                nodes.append(node)
            passed = [batch.column(i) for i in (0, 1, *range(3, 3 + len(kept)))]
            yield pa.RecordBatch.from_arrays([*passed, pa.array(depths, pa.int32()), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary())], names=["conv_id", "role", *kept, "depth", "node", "parent"])

    return placed.mapInArrow(run, schema)


def _digest(x: Column) -> Column:
    return F.unhex(F.substring(F.sha2(x, 256), 1, 32))


def stored_nodes(paths: DataFrame) -> DataFrame:
    """The nodes with their parents and segments, written; all that layout() and forest() add follows from these. along: the longest conversation through a node."""
    longest = F.max(F.struct("length", "conv_id"))["conv_id"].alias("along")
    nodes = paths.groupBy("node").agg(*(F.first(c).alias(c) for c in ("parent", "depth", "role", "text")), longest, F.count(F.lit(1)).alias("n_conversations"))
    head = F.length(F.concat(F.lit(BEGIN), escape_role(F.col("role")), F.lit(AFTER_ROLE)))
    shaped = nodes.select("node", "parent", "depth", "along", "n_conversations", segment(F.col("role"), F.col("text")).alias("segment"), F.when(F.col("role") == LEARNED, head).alias("head"))
    return checkpoint(shaped.withColumn("units", F.length("segment").cast("bigint")))


def _key(up: Column) -> Column:
    """up, or where there is none a key that no node has, so that roots don't meet in one task."""
    return F.coalesce(up, F.concat("node", F.lit(b"-")))


def _climb(rows: DataFrame, add) -> DataFrame:
    """(node, x) with the x of all ancestors added, root first, in as many rounds as the depth has bits; rows: (node, up, x)."""
    rows = checkpoint(rows)
    while not rows.filter("up is not null").isEmpty():
        above = rows.select(F.col("node").alias("_key"), F.col("up").alias("_up"), F.col("x").alias("_x"))
        joined = rows.withColumn("_key", _key(F.col("up"))).join(above, "_key", "left")
        rows = checkpoint(joined.select("node", F.col("_up").alias("up"), F.when(F.col("_x").isNull(), F.col("x")).otherwise(add(F.col("_x"), F.col("x"))).alias("x")))
    return rows.select("node", "x")


def _subtrees(placed: DataFrame) -> DataFrame:
    """(node, total): the units of each node and all below it. After k rounds those less than 2^k turns below are counted."""
    rows = checkpoint(placed.select("node", F.col("parent").alias("up"), F.col("units").alias("total")))
    while not rows.filter("up is not null").isEmpty():
        below = rows.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("total").alias("_more"))
        above = rows.select(F.col("node").alias("_key"), F.col("up").alias("_up"))
        joined = rows.withColumn("_key", _key(F.col("up"))).join(above, "_key", "left").join(below, "node", "left")
        rows = checkpoint(joined.select("node", F.col("_up").alias("up"), (F.col("total") + F.coalesce("_more", F.lit(0))).alias("total")))
    return rows.select("node", "total")


def chains(placed: DataFrame) -> DataFrame:
    """(node, top, before, parent, units): the first node of each node's chain, and the units of the chain before it; only a chain's last node has several children.

    The longest conversation through a chain's first node goes along all of it, so a chain lies together when nodes are sorted by it and by depth; a task holds
    the chain that it is in, however many nodes it has.
    """
    children = placed.filter("parent is not null").groupBy(F.col("parent").alias("_key")).agg(F.count(F.lit(1)).alias("_children"))
    flagged = placed.select("node", "parent", "depth", "along", "units", _key(F.col("parent")).alias("_key")).join(children, "_key", "left")
    rows = flagged.select("node", "parent", "units", "along", "depth", (F.coalesce("_children", F.lit(2)) > 1).alias("first"))
    sorted_ = rows.repartition("along").sortWithinPartitions("along", "depth").select("node", "parent", "units", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, total = None, 0
        for batch in batches:
            tops, before = [], []
            for node, units, first in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if first:
                    top, total = node, 0
                tops.append(top)
                before.append(total)
                total += units
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tops, pa.binary()), pa.array(before, pa.int64()), batch.column(1), batch.column(2)], names=["node", "top", "before", "parent", "units"])

    return checkpoint(sorted_.mapInArrow(run, "node binary, top binary, before bigint, parent binary, units bigint"))


def layout(placed: DataFrame) -> DataFrame:
    """(node, start, end, position) of the stored nodes in the depth-first stream, where siblings go by digest."""
    own = chains(placed)
    sums = own.groupBy("top").agg(F.sum("units").alias("units"))
    above = own.filter("node = top").select("top", _key(F.col("parent")).alias("_key")).join(own.select(F.col("node").alias("_key"), F.col("top").alias("parent")), "_key", "left")
    laid = _laid(checkpoint(sums.join(above, "top").select(F.col("top").alias("node"), "parent", "units")))
    joined = own.join(laid.select(F.col("node").alias("top"), F.col("start").alias("_start"), F.col("position").alias("_position")), "top")
    start = F.col("_start") + F.col("before")
    return checkpoint(joined.select("node", start.alias("start"), (start + F.col("units")).alias("end"), (F.col("_position") + F.col("before")).alias("position")))


def _laid(placed: DataFrame) -> DataFrame:
    """(node, start, end, position) of nodes (node, parent, units).

    A node starts after its parent's units and its earlier siblings' subtrees. All siblings are in one range sort, and
    a table of one row per partition is added to sums within partitions, so however many siblings there are, no task sees all.
    """
    sizes = placed.select("node", "parent", "units")
    family = sizes.join(_subtrees(placed), "node").withColumn("family", F.coalesce("parent", F.lit(b"")))
    # written once, so that the partition numbers below are the same in every use
    sorted_ = checkpoint(family.orderBy("family", "node").withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    totals = sorted_.groupBy("part").agg(F.sum("total").alias("whole"))
    offsets = totals.select("part", (F.sum("whole").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole")).alias("offset"))
    running = F.sum("total").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    summed = checkpoint(sorted_.withColumn("running", running).join(offsets, "part").select("node", "parent", "family", "units", (F.col("offset") + F.col("running") - F.col("total")).alias("before")))
    firsts = summed.groupBy("family").agg(F.min("before").alias("first"))
    parents = sizes.select(F.col("node").alias("family"), F.col("units").alias("parent_units"))
    own = summed.join(firsts, "family").join(parents, "family", "left").withColumn("parent_units", F.coalesce("parent_units", F.lit(0)))
    step = own.select("node", F.col("parent").alias("up"), F.struct((F.col("before") - F.col("first") + F.col("parent_units")).alias("start"), F.col("parent_units").alias("position")).alias("x"))
    added = _climb(step, lambda a, b: F.struct((a["start"] + b["start"]).alias("start"), (a["position"] + b["position"]).alias("position")))
    return checkpoint(added.join(sizes, "node").select("node", F.col("x.start").alias("start"), (F.col("x.start") + F.col("units")).alias("end"), F.col("x.position").alias("position")))


def _shaped(placed: DataFrame) -> DataFrame:
    loss_start, loss_end = F.col("start") + F.col("head"), F.when(F.col("head").isNotNull(), F.col("end") - len(END))
    return placed.join(layout(placed), "node").select("node", "parent", "depth", "segment", "start", "end", "position", loss_start.alias("loss_start"), loss_end.alias("loss_end"), "n_conversations")


def forest(placed: DataFrame) -> DataFrame:
    """One row per stored node, with its place in the depth-first stream.

    node, path (the digests down to it), depth, segment (formatted text), start and end (interval in the stream), position (of its
    first unit in its conversations), ancestors (their intervals, root first), loss_start and loss_end (what of the stream
    is learned: the text of an assistant's turn, else null), n_conversations (that pass through it). Paths and ancestors
    grow with the square of a conversation's turns, which digests() does without.
    """
    laid = checkpoint(_shaped(placed))
    spans = _climb(laid.select("node", F.col("parent").alias("up"), F.array(F.struct("node", "start", "end")).alias("x")), lambda a, b: F.concat(a, b))
    return laid.join(spans, "node").select(
        "node", F.transform("x", lambda s: s["node"]).alias("path"), "depth", "segment", "start", "end", "position",
        F.transform(F.slice("x", F.lit(1), F.size("x") - 1), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("ancestors"),
        "loss_start", "loss_end", "n_conversations",
    )


def token_forest(turns: DataFrame, path: str) -> DataFrame:
    """The forest in tokens of the vocabulary file at path: one row per node, each node's tokens once, depth-first.

    node, parent, depth, ids (its tokens), positions (the position id of each, within its conversations), start and end (its interval in the
    stream of tokens), ancestors (their intervals, root first: what its tokens attend to besides earlier ones of the node itself),
    loss (whether its text is learned). Segments end in a line feed, which no token crosses, so the ids down to a node are those of the whole text.
    """
    from larkspur.llm import bpe

    stored = stored_nodes(conversation_paths(turns))
    encoded = bpe.encode_decode(stored.select("node", "parent", "depth", "along", "head", "segment"), path, text="segment", outputs=("ids",))
    placed = checkpoint(encoded.withColumn("units", F.size("ids").cast("bigint")))
    laid = checkpoint(layout(placed).join(placed.select("node", "parent"), "node"))
    spans = _climb(laid.select("node", F.col("parent").alias("up"), F.array(F.struct("start", "end")).alias("x")), lambda a, b: F.concat(a, b))
    positions = F.when(F.col("units") > 0, F.sequence(F.col("position"), F.col("position") + F.col("units") - 1)).otherwise(F.array().cast("array<bigint>"))
    return placed.join(laid.drop("parent"), "node").join(spans, "node").select(
        "node", "parent", "depth", "ids", positions.alias("positions"), "start", "end", F.slice("x", F.lit(1), F.size("x") - 1).alias("ancestors"), F.col("head").isNotNull().alias("loss")
    )


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, role, text, learned, units): turns as the stored segments give them; members: (conv_id, depth, node) of each turn."""
    got = members.join(nodes.select("node", "segment", "start", "loss_start", "loss_end"), "node")
    body = F.substring("segment", len(BEGIN) + 1, F.length("segment") - len(BEGIN) - len(END))
    split_at = F.locate(AFTER_ROLE, body)
    role = F.substring(body, F.lit(1), split_at - 1)
    text = F.substring(body, split_at + len(AFTER_ROLE), F.length(body))
    masked = F.substring("segment", (F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return got.select("conv_id", members["depth"], unescape_role(role).alias("role"), unescape(text).alias("text"), unescape(masked).alias("learned"), F.length("segment").alias("units"))


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, from the stored forest: number of turns, digest of the turns and of what is learned, and lengths.

    Turns come sorted and are added to running digests, so no list of a conversation's turns is made.
    """
    nodes = _shaped(stored_nodes(conversation_paths(turns)))
    members = conversation_paths(turns, with_text=False).select("conv_id", "depth", "node")
    back = read_back(nodes, members)
    placed = back.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = f"conv_id {back.schema['conv_id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums, kind = None, None, None
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for conv, role, text, learned, units in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if sums is None or conv != last:
                    out += [(last, sums)] if sums else []
                    last, sums = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                sums[0] += 1
                sums[1].update(f"{role}\n{text}\n".encode())
                if learned is not None:
                    sums[2] += len(learned)
                    sums[3].update(learned.encode())
                sums[4] += units
            yield finished(out, kind)
        if sums:
            yield finished([(last, sums)], kind)

    def finished(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        columns = [[n, a.hexdigest(), chars, b.hexdigest(), units] for _, (n, a, chars, b, units) in rows]
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], kind), *(pa.array([r[i] for r in columns], t) for i, t in enumerate(types))], names=names)

    return placed.mapInArrow(run, schema)


#: The same digests in DuckDB's SQL. No role of the table needs encoding here.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
f AS (
  SELECT *, replace(replace(replace(replace(role, '%', '%25'), '#', '%23'), ':', '%3A'), '<', '%3C') AS r,
         regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') AS e
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + length(r) + length(e)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
