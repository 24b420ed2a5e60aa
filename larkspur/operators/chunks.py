"""Splitting texts into chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.cost import CHARS_PER_TOKEN

SIZE, OVERLAP, MOST_PREVIEW = 1000, 200, 100
#: Separators that are tried in turn.
SEPARATORS = ("\n\n", "\n", " ", "")


def fixed_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_no, chunk): windows of size characters, each starting size - overlap after the one before; from 1."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.greatest(F.length(text) - overlap, F.lit(1)) - 1) / step).cast("int")))
    found = docs.filter(F.length(text) > 0).select(key, F.col(text).alias("_text"), F.explode(starts).alias("i"))
    return found.select(key, (F.col("i") + 1).alias("chunk_no"), F.substring(F.col("_text"), F.col("i") * step + 1, F.lit(size)).alias("chunk"))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces at the first separator that occurs, joined up to size with overlap; longer pieces are split by the next ones."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    sep, rest = separators[at], separators[at + 1 :]
    pieces = [p for p in (text.split(sep) if sep else list(text)) if p]
    out: list[str] = []
    run: list[str] = []
    length = 0

    def emit() -> None:
        joined = sep.join(run).strip()
        if joined:
            out.append(joined)

    for piece in pieces:
        if len(piece) > size and rest:
            if run:
                emit()
                run, length = [], 0
            out += split_text(piece, size, overlap, rest)
            continue
        if run and length + len(sep) + len(piece) > size:
            emit()
            while run and (length > overlap or length + len(sep) + len(piece) > size):
                length -= len(run.pop(0)) + (len(sep) if run else 0)
        length += len(piece) + (len(sep) if run else 0)
        run.append(piece)
    if run:
        emit()
    return out


def recursive_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_no, chunk) by split_text, in Arrow batches."""
    source = docs.select(F.col(key), F.col(text)).filter(F.length(text) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = batch.slice(a, 64)
                split = [split_text(t, size, overlap) for t in rows.column(1).to_pylist()]
                at = [i for i, s in enumerate(split) for _ in s]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at, pa.int64())), pa.array([n for s in split for n in range(1, len(s) + 1)], pa.int32()), pa.array([c for s in split for c in s], pa.string())], names=[key, "chunk_no", "chunk"])

    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, chunk_no int, chunk string")


_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def sentence_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """First and last + 1 character of each window: whole sentences up to size characters, of which the last ones up to overlap begin the next window.

    A sentence that is longer than size is a window of its own, cut at every size characters.
    """
    cuts = [0, *(m.end() for m in _SENTENCE_END.finditer(text)), len(text)]
    sentences = [(a, b) for a, b in zip(cuts, cuts[1:]) if text[a:b].strip()]
    pieces = [(c, min(c + size, b)) for a, b in sentences for c in range(a, b, size)]
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(pieces):
        first, j = pieces[i][0], i + 1
        while j < len(pieces) and pieces[j][1] - first <= size:
            j += 1
        out.append((first, pieces[j - 1][1]))
        if j == len(pieces):
            break
        # the next window begins with what the overlap holds of this one's last pieces, as far as its next piece fits after them
        k = j
        while k - 1 > i and pieces[j - 1][1] - pieces[k - 1][0] <= overlap and pieces[j][1] - pieces[k - 1][0] <= size:
            k -= 1
        i = k
    return out


def sentence_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """(key, chunk_no, start, chunk): windows over the text's sentences of size approximate tokens; a chunk is what stands in the text from start on."""
    source = docs.select(F.col(key), F.col(text)).filter(F.length(text) > 0)
    most, repeated = size * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = batch.slice(a, 64)
                found = [(i, n, s, t[s:e]) for i, t in enumerate(rows.column(1).to_pylist()) for n, (s, e) in enumerate(sentence_spans(t, most, repeated), 1)]
                at, numbers, starts, parts = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(parts, pa.string())], names=[key, "chunk_no", "start", "chunk"])

    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, chunk_no int, start int, chunk string")


def page(chunks: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """The page of this number of every document's chunks, which are numbered from 1."""
    if number < 1 or not 1 <= size <= MOST_PREVIEW:
        raise ValueError(f"pages start at 1 and have 1 to {MOST_PREVIEW} chunks")
    return chunks.filter(F.col("chunk_no").between((number - 1) * size + 1, number * size))


def preview(chunks: DataFrame, n: int = 20) -> DataFrame:
    """The first n chunks of every document."""
    return page(chunks, 1, n)


def totals(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("total_chunks"), F.sum(F.length("chunk")).alias("total_chars"))
