"""Compression of vectors to codes: a codebook for each part of a vector, refined over all rows.

Vectors are turned into whole numbers, floor(SCALE * x), and packed into columnar blocks, one row of numbers per dimension.
A round assigns every part to the nearest entry of its codebook, where distances to all entries accumulate dimension by dimension,
and adds what falls on an entry to tensors of sums and counts with ``np.add.at``. These tensors are merged by the RDD's treeAggregate, so
the driver gets one pair of them, whose size is that of the codebooks and not of the data. Entries become floored means; unused ones stay.

Sums are whole numbers, so the result depends on neither the order nor the dealing of rows, and a lost executor's part is made again alike.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped. The vectors' length is that of the smallest
kept id whose vector's length is a positive multiple of the parts; vectors of other lengths have no code and no error, and teach nothing; a label of such alone has no error.
With fewer rows than entries a codebook has as many entries as there are rows. Rows of equal ids are ordered by their vectors; null ids come last, and are
coded. Repeated rows count each. Numbers of more than 64-bit arithmetic can hold safely are worked out in whole numbers of any size, and an error
beyond a long is the largest long. Other columns are not used. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import checkpoint

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows of a block, and the largest number that 64-bit squares and sums are safe with.
BLOCK, SAFE = 4096, 1 << 24
LONGEST = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector is not null and has no null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly; as Python's whole numbers where some are too large for safe sums of longs."""
    if not x.size or np.abs(x).max() < SAFE / scale:
        return np.floor(x * scale).astype(np.int64)
    # from 2 ** 52 on a double is a whole number itself
    out = [int(v) * scale if abs(v) >= 2.0**52 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(out, object).reshape(x.shape)


def packed(x: np.ndarray) -> bytes:
    return pickle.dumps(x) if x.dtype == object else x.tobytes()


def unpacked(data: bytes, exact: bool, rows: int) -> np.ndarray:
    return pickle.loads(data) if exact else np.frombuffer(data, np.int64).reshape(rows, -1)


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def columnar_blocks(kept: DataFrame, size: int) -> DataFrame:
    """(exact, block): BLOCK vectors at most, packed dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                x = whole(matrix(batch.column(0).slice(a, BLOCK), size), SCALE).T.copy()
                yield pa.RecordBatch.from_arrays([pa.array([x.dtype == object]), pa.array([packed(x)], pa.binary())], names=["exact", "block"])

    return kept.select("vec").mapInArrow(run, "exact boolean, block binary")


def assign(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part's codebook (parts, entries, width) for the columns of a block, and the squared distances to them."""
    parts, entries, width = book.shape
    n = block.shape[1]
    codes, errors = np.zeros((parts, n), np.int64), np.zeros((parts, n), np.result_type(block, book))
    for p in range(parts):
        distances = np.zeros((entries, n), errors.dtype)
        for w in range(width):
            apart = block[p * width + w][None, :] - book[p, :, w][:, None]
            distances += apart * apart
        codes[p] = distances.argmin(axis=0)  # the first of equal ones
        errors[p] = distances[codes[p], np.arange(n)]
    return codes, errors


def tally(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (parts, entries, width) and counts (parts, entries) of what a block assigns."""
    parts, entries, width = book.shape
    codes, _ = assign(block, book)
    sums, counts = np.zeros(book.shape, np.result_type(block, book)), np.zeros((parts, entries), np.int64)
    for p in range(parts):
        np.add.at(sums[p], codes[p], block[p * width : (p + 1) * width].T)
        np.add.at(counts[p], codes[p], 1)
    return sums, counts


def refined(blocks: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all blocks."""
    dims = book.shape[0] * book.shape[2]

    def add(total, row):
        found = tally(unpacked(bytes(row["block"]), row["exact"], dims), book)
        return found if total is None else merge(total, found)

    def merge(a, b):
        if a is None or b is None:
            return b if a is None else a
        return a[0] + b[0], a[1] + b[1]

    total = blocks.rdd.treeAggregate(None, add, merge, depth=3)
    if total is None:
        return book
    sums, counts = total
    used = counts > 0
    out = book.astype(sums.dtype)
    out[used] = sums[used] // counts[used][:, None]
    # back to longs where all are safe again
    return out.astype(np.int64) if out.dtype == object and all(abs(v) <= SAFE for v in out.ravel()) else out


def first_codebooks(kept: DataFrame, size: int, parts: int, entries: int) -> np.ndarray:
    """Each part of the vectors with the smallest ids: entries rows at most."""
    rows = kept.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).select("vec").toArrow().column("vec").to_pylist()
    x = whole(np.array(rows, np.float64).reshape(-1, size), SCALE)
    return np.ascontiguousarray(x.reshape(len(rows), parts, size // parts).transpose(1, 0, 2))


def codebooks(kept: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (parts, entries, width) of vectors (id, vec) of one length."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    book = first_codebooks(kept, size, parts, entries)
    blocks = checkpoint(columnar_blocks(kept, size))
    for _ in range(rounds):
        book = refined(blocks, book)
    return book


def coded(rows: DataFrame, book: np.ndarray | None) -> DataFrame:
    """rows (..., vec) with code and error in place of the vector; null where the length is another."""
    names = [c for c in rows.columns if c != "vec"]
    size = 0 if book is None else book.shape[0] * book.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                vectors = part.column(part.schema.get_field_index("vec"))
                lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
                codes, errors = [None] * part.num_rows, [None] * part.num_rows
                own = np.flatnonzero(lengths == size) if size else np.zeros(0, np.int64)
                if own.size:
                    found, off = assign(whole(matrix(vectors.take(pa.array(own)), size), SCALE).T, book)
                    for i, c, e in zip(own.tolist(), found.T.astype(np.uint8), off.sum(axis=0).tolist()):
                        codes[i], errors[i] = c.tobytes().hex(), min(e, LONGEST)
                columns = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*names, "code", "error"])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, "vec").mapInArrow(run, f"{kept}, code string, error bigint")


def code_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 of each row of df whose vector is sound."""
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vec")).filter(finite(F.col("vec")))
    sized = rows.withColumn("size", F.size("vec")).filter((F.col("size") > 0) & (F.col("size") % parts == 0))
    first = sized.orderBy(F.asc_nulls_last("id"), "vec").select("size").limit(1).collect()
    book = codebooks(sized.filter(F.col("size") == first[0]["size"]).select("id", "vec"), first[0]["size"], parts, entries, rounds) if first else None
    written = "" if book is None else ",".join(str(v) for v in book.ravel().tolist())
    found = checkpoint(coded(rows, book))
    # a label of very many rows is one row here; sums may be larger than a long
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = found.groupBy(F.col("label").alias("_label")).agg(F.when(total.isNotNull(), F.least(total, F.lit(LONGEST).cast("decimal(38,0)"))).cast("bigint").alias("label_error"))
    joined = found.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(hashlib.sha256(written.encode()).hexdigest()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same rows in DuckDB's SQL."""
    assigned = lambda book: f"""
  SELECT v.r, v.part, arg_min(b.entry, {{'d': list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.entry}}) AS entry, min(list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
  FROM v JOIN {book} b ON b.part = v.part GROUP BY v.r, v.part"""  # noqa: E731
    mean = lambda book, a: f"""
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (
    SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x FROM (
      SELECT {a}.part, {a}.entry, i, sum(v.x[i]) AS s, count(*) AS n FROM {a} JOIN v ON v.r = {a}.r AND v.part = {a}.part, range(1, len(v.x) + 1) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2
  ) m ON m.part = b.part AND m.entry = b.entry"""  # noqa: E731
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
v AS (SELECT r, part, e[CAST(part * len(e) // {PARTS} + 1 AS BIGINT):CAST((part + 1) * len(e) // {PARTS} AS BIGINT)] AS x FROM kept, range({PARTS}) t(part)),
b0 AS (SELECT part, r AS entry, x FROM v WHERE r < {ENTRIES}),
a0 AS ({assigned("b0")}), b1 AS ({mean("b0", "a0")}), a1 AS ({assigned("b1")}), b2 AS ({mean("b1", "a1")}), a2 AS ({assigned("b2")}),
codes AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN codes USING (r), digest
"""


ORACLE = _oracle()
