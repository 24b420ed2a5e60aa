"""An inverted-file index of vectors: lists by nearest centroid, probed in order of the query's distance, with exact distances.

Centroids come from k-means on unit vectors, fitted on a sample of bounded size; every vector with a direction is then put into the list of its nearest
centroid. Lists are stored partitioned by centroid, so a search reads the folders of the lists that it probes and no others. A list of
more than LIST_ROWS vectors is cut into pieces, which are searched by tasks of their own. How many lists are probed is measured when the index
is built: so many that the nearest vectors of sampled queries, found by comparing all vectors, are in them with the target recall.

Defined cases: null vectors, those with null or non-finite components, of another length than the centroids or without direction are in no list
and are never found, and queries of that kind find nothing; equal vectors are all found, in order of id; with fewer vectors than lists some lists are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.vectors import norm
from larkspur.operators.search import SLICE, Nearest, top_k_each

#: Documented bounds: of the sample that centroids are fitted on, of the queries that probes are measured with, and of lists.
SAMPLE, CALIBRATION, MOST_LISTS = 50_000, 200, 4096
#: Rows of a piece of a list, and queries that a task holds at once.
LIST_ROWS, QUERIES = 50_000, 2_000
RECALL = 0.95


def searchable(vector: str) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and one that is not zero."""
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & (norm(F.col(vector)) > 0), F.lit(False))


def fit(chunks: DataFrame, lists: int | None = None, embedding: str = "embedding", sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Centroids of unit length: as many as lists, or about the root of the number of vectors, MOST_LISTS at most."""
    sound = chunks.filter(searchable(embedding)).select(F.col(embedding).cast("array<double>").alias("v"))
    sizes = sound.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    if not sizes:
        return np.zeros((0, 0))
    own = sound.filter(F.size("v") == sizes[0]["n"])
    wanted = min(lists or max(1, round(sizes[0]["rows"] ** 0.5)), MOST_LISTS)
    # the vectors of lowest hash, so that the sample does not depend on how the table is cut
    drawn = own.withColumn("_h", F.xxhash64("v", F.lit(seed))).orderBy("_h").limit(sample)
    drawn = drawn.select(array_to_vector("v").alias("features")).persist()
    try:
        model = KMeans(k=wanted, seed=seed, maxIter=10, distanceMeasure="cosine", initSteps=1).fit(drawn) if wanted > 1 else None
        found = np.array(model.clusterCenters()) if model else np.array([r["features"].toArray() for r in drawn.limit(1).collect()])
    finally:
        drawn.unpersist()
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def unit(vectors: pa.Array, size: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def assign(rows: DataFrame, centroids: np.ndarray, vector: str, probes: int = 1, into: str = "list") -> DataFrame:
    """rows with into: the numbers of the nearest centroids, nearest first; rows whose vector is not searchable or has another length go."""
    size = centroids.shape[1]
    own = rows.filter(searchable(vector) & (F.size(vector) == size))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields) + f", {into} array<int>"
    at = own.columns.index(vector)
    n = min(probes, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a slice at a time, so that memory does not grow with the number of centroids
            x = unit(batch.column(at), size)
            parts = [np.argsort(-(x[a : a + SLICE] @ centroids.T), axis=1, kind="stable")[:, :n].astype(np.int32) for a in range(0, len(x), SLICE)]
            order = np.concatenate([np.zeros((0, n), np.int32), *parts])
            found = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, n), pa.int32()), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, into])

    return own.mapInArrow(run, schema)


def nearest_in_groups(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, distance): the k nearest chunks of each query within each group that it is in.

    queries: grp, query_id, query; chunks: grp, vec_id, embedding; vectors of one length that have a direction. A group's queries come
    first in its sorted stream and are held, QUERIES at most by how groups are made; its chunks pass by in batches, which are compared in slices, so that memory
    depends neither on the batches nor on the lists.
    """
    key, query = queries.schema["query_id"].dataType.simpleString(), chunks.schema["vec_id"].dataType.simpleString()
    none = lambda kind: F.lit(None).cast(kind)
    asked = queries.select("grp", F.lit(0).alias("side"), "query_id", none(query).alias("vec_id"), F.col("query").cast("array<double>").alias("v"))
    given = chunks.select("grp", F.lit(1).alias("side"), none(key).alias("query_id"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = asked.unionByName(given).repartition("grp").sortWithinPartitions("grp", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, held, kept = None, [], [], None
        for batch in batches:
            groups, sides = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            change = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]) | (sides[1:] != sides[:-1])])
            for a, b in zip(change, [*change[1:], batch.num_rows]):
                part = batch.slice(a, b - a)
                if groups[a] != last:
                    yield from packed(kept, ids)
                    last, ids, held, kept = groups[a], [], [], None
                if sides[a] == 0:
                    ids.append(part.column(2))
                    held.append(rows_of(part.column(4)))
                elif ids:
                    if kept is None:
                        kept = Nearest(np.concatenate(held), k)
                    kept.add(part.column(3).to_numpy(zero_copy_only=False), rows_of(part.column(4)))
        yield from packed(kept, ids)

    def rows_of(vectors: pa.Array) -> np.ndarray:
        return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)

    def packed(kept: Nearest | None, ids: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids).take(pa.array(kept.rows)), pa.array(kept.ids), pa.array(kept.distances)], names=["query_id", "vec_id", "distance"])

    return rows.select("grp", "side", "query_id", "vec_id", "v").mapInArrow(run, f"query_id {key}, vec_id {query}, distance double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """found (query_id, vec_id, distance) with rank, the k nearest of each query."""
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, distance, rank) by comparing every chunk with every query; vectors are searchable and of one length."""
    return top_k_each(queries, chunks, k)


@dataclass
class VectorIndex:
    """A stored index: the folder of its lists, its centroids, and how many lists a search probes."""

    path: str
    centroids: np.ndarray
    probes: int
    pieces: dict[int, int]  # of the lists that have more than one

    def lists(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lists")


def build(chunks: DataFrame, path: str, lists: int | None = None, recall: float = RECALL, k: int = 10, key: str = "vec_id", embedding: str = "embedding", list_rows: int = LIST_ROWS, **options) -> VectorIndex:
    """The index of chunks (key, embedding), written to path; k and recall: what the number of probes is measured for."""
    spark = chunks.sparkSession
    named = chunks.select(F.col(key).alias("vec_id"), F.col(embedding).alias("embedding"))
    centroids = fit(named, lists, **options)
    if not len(centroids):
        return VectorIndex(path, centroids, 0, {})
    placed = assign(named, centroids, "embedding").withColumn("list", F.element_at("list", 1))
    counts = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > list_rows)
    pieces = {r["list"]: -(-r["n"] // list_rows) for r in counts.collect()}  # MOST_LISTS rows at most
    # a hot list is dealt to as many tasks and files as it has pieces
    placed.repartition("list", F.pmod(F.xxhash64("vec_id"), pieces_of(pieces))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    index = VectorIndex(path, centroids, len(centroids), pieces)
    index.probes = measured_probes(index, spark, recall, k)
    rows = [(i, [float(x) for x in c], pieces.get(i, 1), index.probes) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>, pieces int, probes int").write.mode("overwrite").parquet(f"{path}/centroids")
    return index


def pieces_of(pieces: dict[int, int]) -> Column:
    """The number of pieces of a row's list."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in pieces.items() for x in p)), F.col("list")), F.lit(1)) if pieces else F.lit(1)


def load(spark: SparkSession, path: str) -> VectorIndex:
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["list"])
    return VectorIndex(path, np.array([r["centroid"] for r in rows]), rows[0]["probes"], {r["list"]: r["pieces"] for r in rows if r["pieces"] > 1})


def measured_probes(index: VectorIndex, spark: SparkSession, recall: float, k: int, sample: int = CALIBRATION) -> int:
    """The fewest lists that hold this share of the k nearest others of sampled vectors, which are found by comparing all."""
    stored = index.lists(spark)
    drawn = stored.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).orderBy(F.xxhash64("query_id", F.lit(7)), "query_id").limit(sample)
    asked = assign(drawn, index.centroids, "query", len(index.centroids), "order").persist()
    try:
        near = exact(asked.select("query_id", "query"), stored.select("vec_id", "embedding"), k + 1).filter("query_id <> vec_id")
        where = near.join(stored.select("vec_id", "list"), "vec_id").join(asked.select("query_id", "order"), "query_id")
        # which probe finds each: a number of lists, so the counts are few
        counts = where.select(F.array_position("order", F.col("list")).alias("probe")).groupBy("probe").agg(F.count(F.lit(1)).alias("n")).orderBy("probe").collect()
    finally:
        asked.unpersist()
    total, seen = sum(r["n"] for r in counts), 0
    for r in counts:
        seen += r["n"]
        if seen >= recall * total:
            return int(r["probe"])
    return len(index.centroids)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, query_groups: int | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest of what the probed lists hold, for each of queries (query_id, query); their ids are distinct.

    A query goes to its lists, to each piece of a hot one, and meets their vectors there; queries of a list are dealt into groups of about QUERIES.
    """
    spark = queries.sparkSession
    if not index.probes:
        return queries.select("query_id", F.lit(None).cast("bigint").alias("vec_id"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("rank")).limit(0)
    groups = query_groups or max(1, -(-queries.count() // QUERIES))
    asked = assign(queries.select("query_id", "query"), index.centroids, "query", probes or index.probes, "order")
    split = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")
    pieces = pieces_of(index.pieces)
    sides = asked.select("query_id", "query", split.alias("part"), F.explode("order").alias("list"))
    probed = [r["list"] for r in sides.select("list").distinct().collect()]  # of a bounded number of lists
    stored = index.lists(spark).filter(F.col("list").isin(probed))
    own = sides.select("query_id", "query", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), "list", "part")
    left = own.select(F.xxhash64("list", "piece", "part").alias("grp"), "query_id", "query")
    spread = stored.withColumn("piece", F.pmod(F.xxhash64("vec_id"), pieces).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = spread.select(F.xxhash64("list", "piece", "part").alias("grp"), "vec_id", "embedding")
    return ranked(nearest_in_groups(left, right, k), k)


def recall_of(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each query's true results (query_id, vec_id) that were found."""
    hit = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1.0).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
