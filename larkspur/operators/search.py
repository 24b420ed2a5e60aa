"""Exact top-K vector search with metadata filters, ranking by several signals, and enrichment of results."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from larkspur.functions.variants import Json
from larkspur.functions.vectors import DISTANCES
from larkspur.operators.metadata import holds
from larkspur.session import checkpoint

#: Metadata that a result may show, weights of the signals, and the constant of reciprocal ranks.
SHOWN = ["externalId", "externalType", "externalSource", "categoryPath", "name", "description", "salePriceKopecks", "rangForApp"]
VECTOR_WEIGHT, RANK_WEIGHT, CATEGORY_WEIGHT, RECIPROCAL = 0.7, 0.2, 0.1, 60
DEFAULT_K, MOST_K = 10, 50


def checked_k(k: int) -> int:
    if not isinstance(k, int) or not 1 <= k <= MOST_K:
        raise ValueError(f"k must be a whole number from 1 to {MOST_K}")
    return k


def vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def top_k(chunks: DataFrame, query: Sequence[float] | DataFrame, k: int = DEFAULT_K, strategy: str = "cosine", embedding: str = "embedding", key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The k nearest chunks with their distance; ties go by key. The filter is applied before any distance is computed.

    The query is a list of numbers, or a table of one row with the vector in ``query``, which stays within the plan.
    """
    found = chunks if where is None else chunks.filter(where)
    given = isinstance(query, DataFrame)
    found = found.crossJoin(F.broadcast(query.select("query").limit(1))) if given else found.withColumn("query", vector(query))
    scored = found.withColumn("distance", DISTANCES[strategy](F.col(embedding), F.col("query"))).drop("query").filter("distance is not null")
    return scored.orderBy("distance", key).limit(checked_k(k))


def top_k_each(queries: DataFrame, chunks: DataFrame, k: int, strategy: str = "cosine", most_queries: int = 10_000) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest chunks of each query; query ids are distinct.

    The queries are counted and dealt by id into blocks of about most_queries, so that what goes to the tasks stays bounded. The chunks are spread by id and
    pass by in batches: matrix products tell which may be among a query's k nearest of the task, and only of those the distance is worked out term by
    term, as in DISTANCES, so equal vectors have equal distances. What is shuffled further is k rows per query and task.
    """
    asked = checkpoint(queries.select("query_id", F.col("query").cast("array<double>").alias("query")).filter(_whole("query")))
    blocks = max(1, -(-asked.count() // most_queries))
    spread = chunks.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(_whole("embedding")).repartition("vec_id")
    if blocks > 1:
        spread = checkpoint(spread)
    at = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = [_nearest(asked.filter(at == b), spread, k, strategy) for b in range(blocks)]
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _whole(vector: str) -> Column:
    """Whether a vector is one and has no null component: others have no distance."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())


def _nearest(queries: DataFrame, chunks: DataFrame, k: int, strategy: str) -> DataFrame:
    """(query_id, vec_id, distance): each task's k nearest chunks of each query of a bounded block."""
    block = queries.toArrow().combine_chunks()  # one block of the counted queries
    key, kind = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (chunks, "vec_id")))
    if not block.num_rows:
        return chunks.sparkSession.createDataFrame([], f"query_id {key}, vec_id {kind}, distance double")
    ids = block.column("query_id").combine_chunks()
    sizes = pc.list_value_length(block.column("query").combine_chunks()).to_numpy()
    # queries by the length of their vectors: chunks of another length have no distance
    asked = {int(n): (np.flatnonzero(sizes == n), pc.list_flatten(block.column("query").combine_chunks().filter(pa.array(sizes == n))).to_numpy().reshape(-1, int(n))) for n in np.unique(sizes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {n: Nearest(x, k, strategy) for n, (_, x) in asked.items()}
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy()
            for n in np.unique(lengths):
                if n in kept:
                    own = batch.filter(pa.array(lengths == n))
                    kept[n].add(own.column(0).to_numpy(zero_copy_only=False), pc.list_flatten(own.column(1)).to_numpy().reshape(-1, n))
        for n, nearest in kept.items():
            if nearest.ids is not None:
                rows = pa.array(asked[n][0][nearest.rows])
                yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array(nearest.ids, block_type), pa.array(nearest.distances)], names=["query_id", "vec_id", "distance"])

    block_type = to_arrow_type(chunks.schema["vec_id"].dataType)
    return chunks.mapInArrow(run, f"query_id {key}, vec_id {kind}, distance double")


#: Chunks and queries that are compared by one matrix product.
SLICE, TOGETHER = 1024, 1024
#: How much the matrix product may be off, as a share of the lengths; what is that near to a query's k-th distance is worked out.
OFF = 1e-9


class Nearest:
    """The k nearest vectors so far of each of some queries of one length: rows (numbers of queries), ids and distances, in order."""

    def __init__(self, x: np.ndarray, k: int, strategy: str = "cosine"):
        self.x, self.k, self.strategy = x, k, strategy
        self.squares, self.norms = squares(x), np.sqrt(squares(x))
        self.edge = np.full(len(x), np.inf)
        self.rows, self.ids, self.distances = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, ids: np.ndarray, y: np.ndarray) -> None:
        for a in range(0, len(y), SLICE):
            part = slice(a, a + SLICE)
            found = [self.near(b, y[part]) for b in range(0, len(self.x), TOGETHER)]
            rows, cols, distances = (np.concatenate([f[i] for f in found]) for i in range(3))
            rows, distances = np.concatenate([self.rows, rows]), np.concatenate([self.distances, distances])
            names = ids[part][cols] if self.ids is None else np.concatenate([self.ids, ids[part][cols]])
            order = np.lexsort((names, distances, rows))  # NaN is last, as in Spark
            rows, names, distances = rows[order], names[order], distances[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            last = place == self.k - 1
            self.edge[rows[last]] = np.where(np.isnan(distances[last]), np.inf, distances[last])
            self.rows, self.ids, self.distances = rows[place < self.k], names[place < self.k], distances[place < self.k]

    def near(self, b: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, columns, distances) of what may be among the k nearest of queries b to b + TOGETHER."""
        x, norms = self.x[b : b + TOGETHER], self.norms[b : b + TOGETHER]
        with np.errstate(all="ignore"):
            y_squares = squares(y)
            lengths = norms[:, None] * np.sqrt(y_squares)
            about = x @ y.T
            if self.strategy == "cosine":
                about, off = 1 - about / lengths, OFF
            elif self.strategy == "innerProduct":
                about, off = -about, OFF * lengths
            else:
                # compared as squares, where the error is in proportion to the lengths
                sums = self.squares[b : b + TOGETHER, None] + y_squares
                about, off = sums - 2 * about, OFF * sums
            least = np.where(np.isnan(about), np.inf, about) - off
            most = np.where(np.isnan(about), np.inf, about) + off
            edge = self.edge[b : b + TOGETHER]
            edge = edge**2 * (1 + OFF) if self.strategy == "euclidean" else edge
            if y.shape[0] > self.k:
                edge = np.minimum(edge, np.partition(np.where(np.isnan(most), np.inf, most), self.k - 1, axis=1)[:, self.k - 1])
            rows, cols = np.nonzero(~(least > edge[:, None]))
            distances, sound = np.zeros(len(rows)), np.ones(len(rows), bool)
            for a in range(0, len(rows), 1 << 16):
                p, q = rows[a : a + (1 << 16)], cols[a : a + (1 << 16)]
                own, other = x[p], y[q]
                if self.strategy == "euclidean":
                    distances[a : a + len(p)] = np.sqrt(summed((own - other) ** 2))
                    continue
                product = summed(own * other)
                if self.strategy == "cosine":
                    sound[a : a + len(p)] = lengths[p, q] != 0
                    product = product / lengths[p, q]
                distances[a : a + len(p)] = 1 - product if self.strategy == "cosine" else -product
        return rows[sound] + b, cols[sound], distances[sound]


def summed(terms: np.ndarray) -> np.ndarray:
    """Sums of rows in order of their terms, as F.aggregate adds them."""
    return np.cumsum(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


def squares(x: np.ndarray) -> np.ndarray:
    return summed(x * x)


def of_sources(chunks: DataFrame, sources: DataFrame, source: str = "source_id") -> DataFrame:
    """The chunks of a list of sources (source_id), as a table of any length; without sources all chunks."""
    none = sources.isEmpty()
    return chunks if none else chunks.join(sources.select(F.col("source_id").alias("_source")).distinct(), F.col(source) == F.col("_source"), "left_semi")


def metadata_filter(metadata: Column, contains: Mapping[str, Json], also: Mapping[str, Json] | None = None, absent: str | None = None) -> Column:
    """JSON metadata (text) contain ``contains`` and do not have the key ``absent``, or contain ``also``."""
    return holds(F.try_parse_json(metadata), contains, also, absent)


def shown(metadata: Column) -> Column:
    """Only the keys of a metadata map that a result may show."""
    return F.map_filter(metadata, lambda k, _: k.isin(*SHOWN))


def hybrid(found: DataFrame, rank: str, category: str, wanted: str | None, k: int) -> DataFrame:
    """Results (with distance), a bounded number of them, ranked again by similarity, an item's own rank and its category."""
    # one window over a top-k, so that its plan is worked out once
    found = found.withColumn("_top", F.max(rank).over(Window.partitionBy(F.lit(0))))
    top = F.col("_top")
    vector_score = 1 - F.col("distance")
    rank_score = F.coalesce(F.try_divide(F.col(rank).cast("double"), top.cast("double")), F.lit(0.0))
    category_score = F.when(F.contains(F.col(category), F.lit(wanted)), 1.0).otherwise(0.0) if wanted is not None else F.lit(0.0)
    score = VECTOR_WEIGHT * vector_score + RANK_WEIGHT * rank_score + CATEGORY_WEIGHT * category_score
    return found.withColumn("score", score).orderBy(F.desc("score"), "vec_id").limit(k).drop("_top")


def fuse(ranked: Sequence[DataFrame], key: str, k: int) -> DataFrame:
    """Reciprocal rank fusion of results (key, rank)."""
    all_ranks = ranked[0]
    for r in ranked[1:]:
        all_ranks = all_ranks.unionByName(r)
    return all_ranks.groupBy(key).agg(F.sum((F.lit(1) / (RECIPROCAL + F.col("rank"))).cast("decimal(18,12)")).cast("double").alias("score")).orderBy(F.desc("score"), key).limit(k)


def fuse_each(ranked: Sequence[DataFrame], query: str, key: str, k: int) -> DataFrame:
    """(query, rank, key, score): reciprocal rank fusion of results (query, key, rank), for each query."""
    summed = reduce(DataFrame.unionByName, ranked).groupBy(query, key).agg(F.sum((F.lit(1) / (RECIPROCAL + F.col("rank"))).cast("decimal(18,12)")).cast("double").alias("score"))
    order = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return summed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(query, "rank", key, "score")


def attach_urls(docs: DataFrame, urls: DataFrame, key: str, keys: str) -> DataFrame:
    """docs with the URLs of their keys, in the keys' order; each distinct key is looked up once, misses are left out."""
    asked = docs.select(key, F.posexplode(keys).alias("pos", "object_key"))
    known = asked.select("object_key").distinct().join(urls, "object_key")
    found = asked.join(known, "object_key").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "url"))).alias("found"))
    return docs.join(found, key, "left").withColumn("urls", F.coalesce(F.transform("found", lambda x: x["url"]), F.array().cast("array<string>"))).drop("found")
