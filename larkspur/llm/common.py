"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.session import without_vast_estimate


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, cutting its lineage.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (tests, a single
    machine) a folder of this machine is taken; with any other master that is an error.
    """
    context = df.sparkSession.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir=os.environ.get("TMPDIR")))
    return without_vast_estimate(df.checkpoint(eager=True))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def output_schema(df: DataFrame, drop: tuple[str, ...], added: str) -> str:
    """DDL of df's columns without those in drop, followed by added."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in drop]
    return ", ".join([*kept, added])


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of an operator's own that df has in no spelling."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys, as tables; rows must be sorted by keys, whose values aren't null.

    Only one run is held at a time, so callers see to it that runs are bounded.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [column(batch, k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def number_rows(df: DataFrame, *order: str) -> DataFrame:
    """df sorted by order, written, with part (its partition) and seq: consecutive numbers from 0 in that order."""
    at = F.monotonically_increasing_id()
    placed = checkpoint(df.orderBy(*order).withColumn("_at", at)).withColumn("part", F.shiftright("_at", 33)).withColumn("_within", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("part", (F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_offset"))
    return placed.join(offsets, "part").withColumn("seq", F.col("_offset") + F.col("_within")).drop("_at", "_within", "_offset")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) lead to, for each node of an edge.

    Each round points every node to its smallest neighbour, follows these pointers to their ends by doubling, and
    contracts the edges to those ends, which leaves at most half of the nodes. Everything stays in tables that are
    written as checkpoints; a node with very many edges is a skewed key of a join, which adaptive execution splits,
    or of a sum with partial sums before the shuffle.
    """
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = checkpoint(edges.filter(F.col("a") != F.col("b")).select(*pair).distinct())
    labels = None
    while labels is None or not e.isEmpty():
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")))
        while True:
            ends = up.select(F.col("node").alias("up"), F.col("up").alias("end"))
            up = checkpoint(up.select("node", "up").join(ends, "up").select("node", F.col("end").alias("up"), (F.col("end") != F.col("up")).alias("moved")))
            if up.filter("moved").isEmpty():
                break
        up = up.select("node", "up")
        if labels is None:
            labels = up
        else:
            labels = checkpoint(labels.join(up.select(F.col("node").alias("up"), F.col("up").alias("end")), "up", "left").select("node", F.coalesce("end", "up").alias("up")))
        first = e.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").select("x", "b")
        both = first.join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        e = checkpoint(both.filter(F.col("a") != F.col("b")).select(*pair).distinct())
    return labels.select("node", F.col("up").alias("component"))


def summarise_links(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, copies_a: np.ndarray, copies_b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a matrix of links tells of each linked member: its id, the copies that it is linked to, and the id of one
    member that its links lead to. Rows and columns of ``same`` blocks are the same members; a member isn't linked to itself.

    However many links there are, there is a row for each member at most, and those rows connect what the links connect.
    """
    if same:
        linked = linked.copy()
        np.fill_diagonal(linked, False)
    sums_a = linked @ copies_b.astype(np.float64)
    sums_b = sums_a[:0] if same else linked.T @ copies_a.astype(np.float64)
    rows, cols = np.nonzero(linked)
    n = len(ids_a)
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    label = np.arange(len(ids))
    cols = cols if same else cols + n
    while rows.size:
        low = np.minimum(label[rows], label[cols])
        new = label.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, cols, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    sums = np.concatenate([sums_a, sums_b])
    hit = np.flatnonzero(sums)
    return ids[hit], sums[hit].astype(np.int64), ids[label[hit]]


def linked_members(reps: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, n_links, component) of representatives (rep, copies) with at least one link or copy, from links (rep, links, root)."""
    links = checkpoint(links)
    found = links.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    return checkpoint(
        reps.select("rep", "copies").join(found, "rep", "left").join(components, "rep", "left")
        .select("rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )


def least_of_each(found: DataFrame, reps: DataFrame) -> DataFrame:
    """found (rep, n_links, component) with the columns of reps (rep, least: the smallest id of each), where least is the smallest of the component's members."""
    own = found.join(reps, "rep")
    smallest = own.groupBy("component").agg(F.min("least").alias("least"))
    return own.drop("least").join(smallest, "component")
