"""Exact top-k search over posting lists by MaxScore.

Components are whole numbers, floor(SCALE * x). Candidates are dealt into shards of SHARD rows, and each shard becomes an inverted index: for
each dimension the rows with a component other than zero, and the components, in row order, with the least and the greatest of them.

A query's terms are its dimensions other than zero. In a shard a term gives at most its bound, the larger product of its weight with the
two extremes (0 where that is less, as a row may lack the term). Terms are ordered by bound. Those of the smallest bounds, as
many as together stay below the score of the query's k-th best row so far, are non-essential: a row in none of the essential terms'
lists cannot come in. The essential lists are traversed, and rows that they hold are probed for the other terms, largest bound first, while
what they have and may still get reaches that score. It carries over from shard to shard.

Queries are dealt into blocks, and a task takes one block and a run of shards one after another, holding one shard's lists and k rows per query.
A query gives k rows per run, which are merged by a window. The stated queries meet all rows in blocks, as an exact search has to; of a pair of a
query and a row nothing is written.

Defined cases: vectors that are null or hold null or non-finite components take no part; a component that a shorter vector lacks counts as
0, so empty vectors score 0; rows are told apart by their place and not by their id, so repeated ids are candidates of each other, and each is a query of its own;
null ids are candidates that come last among equal scores, and no queries; numbers beyond 64-bit arithmetic are worked out exactly, and a score
beyond a long counts as the last long; a query with fewer than k candidates gets all, with none nothing; other columns are not used; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.codes import LONGEST, finite, whole
from larkspur.llm.common import checkpoint

SCALE, EVERY, K = 64, 20, 20
#: Rows of a shard, and queries of a block: about a PARALLELth of them, between these bounds.
SHARD, LEAST_BLOCK, BLOCK, PARALLEL = 4096, 64, 4096, 16
#: Shards that one task takes at most, and runs that are made at least, if there are so many pairs.
RUN, RUNS = 64, 32


#: A list of more than this share of a shard's rows is kept as a column of all rows.
DENSE = 0.25


@dataclass
class Postings:
    """The inverted index of a shard: for each dimension the rows (docs) with a component other than zero, in order, and these components.

    A long list has no docs (None) but a component for every row.
    """

    rows: np.ndarray  # the row numbers of the table
    ids: np.ndarray
    null: np.ndarray  # whether the id is null
    lists: list[tuple[np.ndarray | None, np.ndarray]]
    low: np.ndarray  # the least and the greatest component of each dimension, 0 among them
    high: np.ndarray


def padded(vectors: pa.Array) -> np.ndarray:
    """Rows of whole numbers, as long as the longest, in as few bytes as they need."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = whole(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), SCALE)
    out = np.zeros((len(sizes), sizes.max(initial=0)), flat.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    if out.dtype == object:
        return out
    return out.astype(np.int16 if np.abs(out).max(initial=0) < 1 << 15 else np.int32)


def invert(rows: np.ndarray, ids: np.ndarray, null: np.ndarray, x: np.ndarray) -> Postings:
    lists = []
    for column in x.T:
        docs = np.flatnonzero(column)
        lists.append((None, column.copy()) if len(docs) > DENSE * len(column) else (docs, column[docs]))
    return Postings(rows, ids, null, lists, x.min(axis=0, initial=0), x.max(axis=0, initial=0))


def best(scores: np.ndarray, null: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id (nulls last), then row."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], null[i], ids[i], rows[i]))[:k], np.int64)
    if len(scores) > 4 * k:
        # ties with the k-th stay
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[best(scores[near], null[near], ids[near], rows[near], k)] if len(near) < len(scores) else np.lexsort((rows, ids, null, -scores))[:k]
    return np.lexsort((rows, ids, null, -scores))[:k]


class Query:
    """One query's terms, and the best rows that it has seen so far."""

    def __init__(self, row: int, weights: np.ndarray, k: int):
        self.row, self.k = row, k
        self.terms = np.flatnonzero(weights)
        # products and sums are longs
        self.weights = weights[self.terms].astype(object if weights.dtype == object else np.int64)
        self.scores = np.zeros(0, np.int64)
        self.rows = self.ids = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def search(self, shard: Postings) -> None:
        within = self.terms < len(shard.lists)
        terms, weights = self.terms[within], self.weights[within]
        bounds = np.maximum(np.maximum(weights * shard.low[terms], weights * shard.high[terms]), 0)
        order = np.argsort(-bounds, kind="stable")
        terms, weights, bounds = terms[order], weights[order], bounds[order]
        # after[i]: what the terms from i on give at most
        after = np.r_[np.cumsum(bounds[::-1])[::-1], 0] if len(bounds) else np.zeros(1, np.int64)
        n = len(shard.rows)
        least = self.scores[-1] if len(self.scores) == self.k else None
        essential = len(terms) if least is None or after[-1] >= least else int(np.argmax(after < least))
        # without a k-th score, or with one that a row without any term reaches, all rows may come in
        everything = least is None or after[essential] >= least
        total, met = np.zeros(n, np.result_type(bounds, np.int64)), np.full(n, everything)
        lists = shard.lists if total.dtype != object else [(d, v.astype(object)) for d, v in shard.lists]
        for i in range(essential):
            docs, values = lists[terms[i]]
            if docs is None:
                total += values * weights[i]
            else:
                total[docs] += values * weights[i]
            if not everything:
                if docs is None:
                    met |= values != 0
                else:
                    met[docs] = True
                everything = bool(met.all())
        found = np.flatnonzero(met)
        total = total[found]
        for i in range(essential, len(terms) + 1):
            if least is not None:
                stay = total + after[i] >= least
                if not stay.all():
                    found, total = found[stay], total[stay]
            if i == len(terms) or not found.size:
                break
            docs, values = lists[terms[i]]
            if docs is None:
                total = total + values[found] * weights[i]
            elif len(docs):
                at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                total = total + np.where(docs[at] == found, values[at], 0) * weights[i]
        other = shard.rows[found] != self.row
        found, total = found[other], total[other]
        if found.size:
            own = best(total, shard.null[found], shard.ids[found], shard.rows[found], self.k)
            found, total = found[own], total[own]
            scores, null = np.concatenate([self.scores, total]), np.concatenate([self.null, shard.null[found]])
            ids, rows = np.concatenate([self.ids, shard.ids[found]]), np.concatenate([self.rows, shard.rows[found]])
            own = best(scores, null, ids, rows, self.k)
            self.scores, self.null, self.ids, self.rows = scores[own], null[own], ids[own], rows[own]


def dealt(rows: DataFrame, parts: int, size: int, pack) -> DataFrame:
    """(part, at, data): rows (row, id, vec) dealt evenly into parts, in pieces of size at most, each packed by pack(rows, ids, null, components); at numbers the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition's batches are put together up to size rows
        held: list[pa.RecordBatch] = []
        have = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, size - have)
                held.append(piece)
                have, at = have + piece.num_rows, at + piece.num_rows
                if have == size:
                    yield packed(held)
                    held, have = [], 0
        if held:
            yield packed(held)

    def packed(held: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        row, key, vec = (table.column(c).chunk(0) for c in ("row", "id", "vec"))
        null = key.is_null().to_numpy(zero_copy_only=False)
        data = pickle.dumps(pack(row.to_numpy(), key.fill_null(0).to_numpy(), null, padded(vec)), protocol=5)
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

    pieces = rows.select("row", "id", "vec").repartition(parts).mapInArrow(run, "data binary").withColumn("at", F.monotonically_increasing_id())
    return checkpoint(pieces.select(F.shiftright("at", 33).cast("int").alias("part"), "at", "data"))


def top_scores(rows: DataFrame, asked: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each row (id, vec) for which asked holds, among all other rows."""
    numbered = checkpoint(rows.filter(finite(F.col("vec"))).select(F.col("id").cast("bigint").alias("id"), "vec", F.coalesce(asked, F.lit(False)).alias("asked")).withColumn("row", F.monotonically_increasing_id()))
    counts = numbered.agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("q")).first()
    size = min(max(-(-counts["q"] // PARALLEL), LEAST_BLOCK), BLOCK)
    n_blocks, n_shards = max(1, -(-counts["q"] // size)), max(1, -(-counts["n"] // SHARD))
    shards = dealt(numbered, n_shards, SHARD, invert)
    blocks = dealt(numbered.filter("asked"), n_blocks, size, lambda row, key, null, x: (row, x))
    runs = -(-n_shards // min(max(n_shards * n_blocks // RUNS, 1), RUN))
    # a block goes to each run of shards, and a shard to each block
    left = blocks.select(F.col("part").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), F.lit(-1).cast("bigint").alias("shard"), "data")
    right = shards.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.pmod(F.xxhash64("at"), F.lit(runs)).cast("int").alias("run"), F.col("at").alias("shard"), "data")
    work = left.unionByName(right).repartition(max(8, runs * n_blocks), "block", "run").sortWithinPartitions("block", "run", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, queries = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                own, data = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), pickle.loads(batch.column(3)[i].as_buffer())
                if own != last:
                    yield from found(queries)
                    last, queries = own, []
                if batch.column(2)[i].as_py() < 0:
                    queries += [Query(int(r), x, k) for r, x in zip(*data)]
                    continue
                for q in queries:
                    q.search(data)
        yield from found(queries)

    def found(queries: list[Query]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(queries), 512):
            some = queries[a : a + 512]
            ids, null = np.concatenate([q.ids for q in some]), np.concatenate([q.null for q in some])
            scores = [max(min(int(s), LONGEST), -LONGEST - 1) for q in some for s in q.scores]
            row = np.repeat([q.row for q in some], [len(q.scores) for q in some])
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(scores, pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(np.concatenate([q.rows for q in some]), pa.int64())], names=["query", "score", "vec_id", "row"])

    some = work.select("block", "run", "shard", "data").mapInArrow(run, "query bigint, score bigint, vec_id bigint, row bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = numbered.filter("asked").select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return ranked.join(named, "query").select("query_id", "rank", "vec_id", "score")


def search_multiples(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    """top_scores of the rows whose id is divisible by every."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    return top_scores(rows, F.col("id") % every == 0, k)


#: The same rows in DuckDB's SQL.
ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (SELECT a.r AS q, a.vec_id AS query_id, b.r, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % {EVERY} = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, r) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM o WHERE rank <= {K}
"""
