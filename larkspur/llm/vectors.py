"""Embedding near-dedup by an epsilon grid order join.

Vectors are scaled to length one, so that cosine >= c means a distance of at most epsilon = sqrt(2 - 2c). They are
rotated to principal dimensions and sorted by their grid cells of side epsilon on the leading ones (the epsilon grid
order), within groups of equal label and length. The sequence is cut into blocks of BLOCK vectors and
these into a tree of intervals; pairs of intervals are joined from the root down, and a pair whose bounding boxes lie
further apart than epsilon is skipped. Pairs of blocks that remain are compared in double precision, again interval by interval.

The rotation is fitted on a bounded sample and decides only the order and the boxes, so results do not depend on it. Equal vectors
are joined once, as one representative with a number of copies. A pair of blocks gives at most one row per vector (its number of
links, and a member of its local component), so a dense group of n vectors gives n * n / BLOCK rows, never its n * n pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or id,
link with nothing: n_links 0, component their own id, kept. Repeated rows are vectors of their own, and so are different vectors of one id,
each with its own row and links. Vectors of different lengths never link. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import checkpoint, least_of_each, linked_members, number_rows, output_schema, summarise_links

THRESHOLD = 0.93
#: Vectors of a block, of an interval that is compared at once, and children of an interval of the tree.
BLOCK, LEAF, FAN = 2048, 256, 8
#: Right blocks that one left block is sent with at most, and runs that are made at least, if there are so many pairs.
RUN, PARALLEL = 16, 64
#: Documented bound of the sample that the rotation is fitted on.
SAMPLE = 10_000
#: Leading principal dimensions: those of the grid order, and those of the tree's boxes.
GRID, BOX = 4, 12

_SLACK = 1e-6


def usable(vector: str, label: str, key: str):
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(F.col(label).isNotNull() & F.col(key).isNotNull() & finite & F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))


def rotation(reps: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Principal dimensions, most variance first, of the most frequent length among a sample of bounded size."""
    rows = reps.select("vec", F.xxhash64("rep").alias("_order")).orderBy("_order").limit(sample).select("vec").toArrow().column("vec").to_pylist()
    if not rows:
        return np.eye(1)
    sizes = [len(r) for r in rows]
    size = max(set(sizes), key=sizes.count)
    x = unit(np.array([r for r in rows if len(r) == size], np.float64))
    _, vectors = np.linalg.eigh(np.cov(x, rowvar=False).reshape(size, size))
    return np.ascontiguousarray(vectors[:, ::-1])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares from overflowing
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotate(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return x @ basis if x.shape[1] == len(basis) else x


def grid_cells(reps: DataFrame, basis: np.ndarray, epsilon: float) -> DataFrame:
    cells = [f"c{i}" for i in range(GRID)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, GRID), np.int32)
            sizes = batch.column("size").to_numpy()
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                p = rotate(unit(flat[starts[own][:, None] + np.arange(size)]), basis)[:, :GRID]
                out[own, : p.shape[1]] = np.floor(p / epsilon)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[:, i]) for i in range(GRID))], names=[*batch.schema.names, *cells])

    return reps.mapInArrow(run, output_schema(reps, (), ", ".join(f"{c} int" for c in cells)))


def blocks_of(numbered: DataFrame, basis: np.ndarray) -> DataFrame:
    """One row per block: ids, copies and vectors packed as bytes, and its box."""
    own = numbered.withColumn("block", F.expr(f"seq div {BLOCK}")).groupBy("grp", "size", "block").agg(F.collect_list(F.struct("seq", "rep", "copies", "vec")).alias("rows"))
    added = "ids binary, counts binary, vectors binary, " + ", ".join(f"lo{i} double, hi{i} double" for i in range(BOX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                rows = row.column("rows").flatten()
                order = np.argsort(rows.field("seq").to_numpy(zero_copy_only=False))
                ids, copies = (rows.field(k).to_numpy(zero_copy_only=False)[order].astype(np.int64) for k in ("rep", "copies"))
                vectors = rows.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
                p = rotate(unit(vectors.astype(np.float64)), basis)
                lo, hi = np.zeros(BOX), np.zeros(BOX)
                k = min(BOX, p.shape[1])
                lo[:k], hi[:k] = p.min(axis=0)[:k], p.max(axis=0)[:k]
                packed = [pa.array([x.tobytes()], pa.binary()) for x in (ids, copies, vectors)]
                yield pa.RecordBatch.from_arrays([row.column(c) for c in ("grp", "size", "block")] + packed + [pa.array([v]) for pair in zip(lo, hi) for v in pair], names=names)

    schema = output_schema(own, ("rows",), added)
    names = ["grp", "size", "block", "ids", "counts", "vectors", *(f"{e}{i}" for i in range(BOX) for e in ("lo", "hi"))]
    return own.mapInArrow(run, schema)


def near_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(grp, size, a, b): pairs of blocks whose boxes are within epsilon, found from the root of the interval tree down."""
    edges = [f"{e}{i}" for i in range(BOX) for e in ("lo", "hi")]
    base = blocks.groupBy("grp", "size").agg(F.min("block").alias("first"))
    level = blocks.select("grp", "size", "block", *edges).join(base, ["grp", "size"]).withColumn("node", F.col("block") - F.col("first")).drop("block", "first")
    levels = [checkpoint(level)]
    while levels[-1].filter("node > 0").limit(1).count():
        up = levels[-1].withColumn("node", F.expr(f"node div {FAN}"))
        levels.append(checkpoint(up.groupBy("grp", "size", "node").agg(*(F.min(c).alias(c) if c[0] == "l" else F.max(c).alias(c) for c in edges))))
    pairs = levels[-1].select("grp", "size", F.col("node").alias("a"), F.col("node").alias("b"))
    for boxes in levels[-2::-1]:
        side = lambda s: boxes.select("grp", "size", F.expr(f"node div {FAN}").alias(s), F.col("node").alias(f"{s}_child"), *(F.col(c).alias(f"{s}_{c}") for c in edges))  # noqa: B023, E731
        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}")), 2) for i in range(BOX)), F.lit(0.0))
        joined = pairs.join(side("a"), ["grp", "size", "a"]).join(side("b"), ["grp", "size", "b"])
        pairs = checkpoint(joined.filter((F.col("a_child") <= F.col("b_child")) & (gap <= epsilon * epsilon + _SLACK)).select("grp", "size", F.col("a_child").alias("a"), F.col("b_child").alias("b")))
    return pairs.join(base, ["grp", "size"]).select("grp", "size", (F.col("a") + F.col("first")).alias("a"), (F.col("b") + F.col("first")).alias("b"))


def join_intervals(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, threshold: float, epsilon: float, out: np.ndarray) -> None:
    """Sets out where rows of x and y link; px and py are their rotated places, whose boxes decide what is skipped."""
    gap = np.maximum(0, np.maximum(px.min(axis=0) - py.max(axis=0), py.min(axis=0) - px.max(axis=0)))
    if (gap * gap).sum() > epsilon * epsilon + _SLACK:
        return
    if len(x) <= LEAF and len(y) <= LEAF:
        out[:] = x @ y.T >= threshold
        return
    cuts = [(0, len(z)) if len(z) <= LEAF else (0, len(z) // 2, len(z)) for z in (x, y)]
    for a, b in zip(cuts[0], cuts[0][1:]):
        for c, d in zip(cuts[1], cuts[1][1:]):
            join_intervals(x[a:b], y[c:d], px[a:b], py[c:d], threshold, epsilon, out[a:b, c:d])


def compare(pairs: DataFrame, blocks: DataFrame, basis: np.ndarray, threshold: float, epsilon: float, kind: type = np.float32) -> DataFrame:
    """(rep, links, root) of each linked vector of each pair of blocks; kind: the type of the packed components.

    The blocks that a block meets are dealt into runs. A run is sorted into its left block and then its right ones, so the left one is sent
    once a run, and a task holds two blocks at a time.
    """
    n = pairs.count()
    length = min(max(n // PARALLEL, 1), RUN)
    runs = pairs.withColumn("run", F.expr(f"(b - a) div {length}"))
    left = runs.select("grp", "size", "a", "run").distinct().withColumns({"side": F.lit(0), "block": F.col("a")})
    sides = left.unionByName(runs.select("grp", "size", "a", "run", F.lit(1).alias("side"), F.col("b").alias("block")))
    packed = blocks.select("grp", "size", "block", "ids", "counts", "vectors")
    keys = ["grp", "size", "a", "run"]
    rows = sides.join(packed, ["grp", "size", "block"]).repartition(max(8, n // length // 2), *keys).sortWithinPartitions(*keys, "side", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            for i in range(batch.num_rows):
                side, block, ids, counts, vectors = (batch.column(c)[i] for c in range(2, 7))
                x = unit(np.frombuffer(vectors.as_buffer(), kind).reshape(-1, batch.column(0)[i].as_py()).astype(np.float64))
                own = (block.as_py(), x, rotate(x, basis), np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.int64))
                if side.as_py() == 0:
                    # the batch goes, and its buffers with it
                    first = (*own[:3], own[3].copy(), own[4].copy())
                    continue
                linked = np.zeros((len(first[1]), len(x)), bool)
                join_intervals(first[1], x, first[2], own[2], threshold, epsilon, linked)
                found = summarise_links(linked, first[3], own[3], first[4], own[4], first[0] == own[0])
                yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["rep", "links", "root"])

    return rows.select("size", "a", "side", "block", "ids", "counts", "vectors").mapInArrow(run, "rep bigint, links bigint, root bigint")


def near_dedup(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """key, n_links, component_id and kept of each row of df: links are pairs of equal label with at least this cosine."""
    epsilon = float(np.sqrt(2 - 2 * threshold))
    # components keep the precision that they have
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    rows = checkpoint(df.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("grp"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vec"), usable(vector, label, key).alias("good")))
    good = rows.filter("good").withColumn("size", F.size("vec"))
    # vectors go by numbers of their own, as ids may repeat
    grouped = good.groupBy("grp", "size", "vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    reps = checkpoint(grouped.withColumn("rep", F.monotonically_increasing_id()))
    basis = rotation(reps)
    numbered = number_rows(grid_cells(reps, basis, epsilon), "grp", "size", *(f"c{i}" for i in range(GRID)), "rep")
    blocks = checkpoint(blocks_of(numbered, basis))
    found = linked_members(reps, compare(near_pairs(blocks, epsilon), blocks, basis, threshold, epsilon, np.float32 if single else np.float64))
    known = checkpoint(least_of_each(found, reps.select("rep", "least", "grp", "size", "vec")))
    joined = good.select("id", "grp", "size", "vec").join(known, ["grp", "size", "vec"]).select("id", "n_links", F.col("least").alias("component"))
    alone = rows.filter("not good").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return joined.unionAll(alone).select(F.col("id").alias(key), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


#: The same rows in DuckDB's SQL: every pair of a label is compared.
ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.node = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""
