"""Quality by compression: how much better a text packs with a dictionary of good texts than with one of bad texts.

Two zstandard dictionaries are trained on labelled texts, one on good and one on bad ones. A text is compressed
whole with either, in pieces of PIECE bytes, each on its own, so that a dictionary tells as much about the end of
a long text as about its beginning. The difference of the two compressed sizes, over the text's bytes, is the text's
only measure. A logistic curve over it, fitted to labelled texts that are in neither dictionary and weighted to the
shares that the labels have among all labelled documents, turns it into the score, the probability of a good label.

What is learned from is a bounded sample: per class the SAMPLE labelled documents of lowest hash, of any length. Half
of them give at most PIECES pieces of CUT bytes each, one after the other or spread over a longer text, to their dictionary; the other half are measured
whole, within the tasks, for the curve. Only those pieces and one number a text come to the driver. Every whole text is scored, in one
pass without a shuffle.

Defined cases: null and empty texts have difference 0; labels that are null or contradict each other are not learned
from; of labelled rows that share an id the smallest text is learned from; without labels of both classes every score is 0.5 and
keep_good keeps everything; other columns pass through, whatever their names (but for score and predicted, which are replaced);
rows with equal texts have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import checkpoint, output_schema

#: Documented bounds of the sample: documents of each class, and pieces of a text, of so many bytes, that a dictionary learns from.
SAMPLE = 1000
PIECES, CUT = 16, 1024
#: Bytes of each dictionary, of a piece that is compressed, and the compression level.
DICTIONARY = 112_640
PIECE = 1024
LEVEL = 3
#: Segment and matched substring of the dictionaries' training, in bytes.
SEGMENT, MATCH = 64, 6
#: The score from which a document counts as good.
ACCEPT = 0.7


def dictionary(pieces: list[bytes], size: int = DICTIONARY) -> bytes:
    """Trained on the pieces; too few to train on are themselves the dictionary."""
    import zstandard as z

    if not pieces:
        return b""
    try:
        return z.train_dictionary(size, pieces, k=SEGMENT, d=MATCH).as_bytes()
    except z.ZstdError:
        return b"".join(pieces)[:size]


@dataclass
class Model:
    """The dictionaries, and the curve: score = 1 / (1 + exp(-(slope * difference + offset)))."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0

    @property
    def learned(self) -> bool:
        return bool(self.good and self.bad)

    def packers(self):
        import zstandard as z

        out = []
        for d in (self.good, self.bad):
            packed = z.ZstdCompressionDict(d)
            packed.precompute_compress(level=LEVEL)
            out.append(z.ZstdCompressor(level=LEVEL, dict_data=packed, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def differences(self, texts: list[str | None]) -> np.ndarray:
        """For each text: bytes that the bad dictionary takes more than the good one, per byte of the text."""
        out = np.zeros(len(texts))
        if not self.learned:
            return out
        good, bad = self.packers()
        for i, t in enumerate(texts):
            data = memoryview((t or "").encode("utf-8", "replace"))
            if data.nbytes:
                more = sum(len(bad.compress(p)) - len(good.compress(p)) for p in (data[a : a + PIECE] for a in range(0, data.nbytes, PIECE)))
                out[i] = more / data.nbytes
        return out

    def scores(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * differences + self.offset, -60, 60)))

    def fit_curve(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> None:
        """Newton's method on the standardised difference; a small penalty keeps the slope finite for separable data."""
        center, scale = x.mean(), max(float(x.std()), 1e-9)
        a = np.c_[(x - center) / scale, np.ones(len(x))]
        w, penalty = np.zeros(2), np.diag([1e-1, 1e-6])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
            step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (weight * (p - y)) + penalty @ w)
            w = w - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.offset = float(w[0] / scale), float(w[1] - w[0] * center / scale)


def learning_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(id, text, label, fold) of the sample that is learned from, and how many labelled documents each label has; labels holds only rows that may be learned from."""
    known = labels.select(F.col(key).alias("id"), F.col(label).alias("label")).filter("label in (0, 1) and id is not null")
    clear = known.groupBy("id").agg(F.min("label").cast("int").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    # ids are chosen by hash, without their texts; those of the chosen ones, a bounded number, are looked up afterwards
    usable = checkpoint(clear.join(texts.select("id"), "id", "left_semi").withColumn("hash", F.xxhash64("id", F.lit(17))))
    shares = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [usable.filter(F.col("label") == v).orderBy("hash", "id").limit(sample) for v in (0, 1)]
    chosen = checkpoint(parts[0].unionAll(parts[1]))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label", "hash").agg(F.min("text").alias("text"))
    return found.select("id", "text", "label", (F.pmod("hash", F.lit(2)) == 0).alias("fold")), shares


def _pieces(rows: DataFrame) -> DataFrame:
    """(label, id, at, piece) of rows (id, text, label): PIECES pieces at most, from the first to the last byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, ids, at, pieces = [], [], [], []
            for i, (t, y) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                data = t.encode("utf-8", "replace")
                step = max(CUT, (len(data) - CUT) / (PIECES - 1))
                for a in sorted({int(k * step) for k in range(PIECES) if k * step < len(data)}):
                    labels.append(y)
                    ids.append(i)
                    at.append(a)
                    pieces.append(data[a : a + CUT])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), batch.column(0).take(pa.array(ids, pa.int64())), pa.array(at, pa.int64()), pa.array(pieces, pa.binary())], names=["label", "id", "at", "piece"])

    return rows.select("id", "text", "label").mapInArrow(run, f"label int, id {rows.schema['id'].dataType.simpleString()}, at bigint, piece binary")


def _measured(rows: DataFrame, model: Model) -> DataFrame:
    """(id, label, difference) of rows (id, text, label), measured whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(model.differences(batch.column(1).to_pylist()))], names=["id", "label", "difference"])

    return rows.select("id", "text", "label").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label int, difference double")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    found, shares = learning_sample(docs, labels, key, text, label, sample)
    if len(shares) < 2:
        return Model(b"", b"")
    rows = checkpoint(found)
    counts = {(r["label"], r["fold"]): r["n"] for r in rows.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    # of a label with no document in one of the halves, all are taken for both
    part = lambda fold: F.coalesce(*(F.when(F.col("label") == v, F.col("fold") == fold if (v, fold) in counts else F.lit(True)) for v in (0, 1)))
    pieces = sorted((r["label"], r["id"], r["at"], bytes(r["piece"])) for r in _pieces(rows.filter(part(True))).collect())
    model = Model(*(dictionary([p for y, _, _, p in pieces if y == v]) for v in (1, 0)))
    measured = sorted((r["id"], r["label"], r["difference"]) for r in _measured(rows.filter(part(False)), model).collect())
    x, y = np.array([d for _, _, d in measured]), np.array([v for _, v, _ in measured], float)
    weight = np.where(y == 1, shares[1] / max(y.sum(), 1), shares[0] / max((1 - y).sum(), 1))
    model.fit_curve(x, y, weight * len(y) / weight.sum())
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with score and predicted."""
    kept = [c for c in docs.columns if c not in (text, "score", "predicted")]
    source = docs.select(*kept, text)
    schema = output_schema(source, (text,), "score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(model.differences(batch.column(len(kept)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(scores), pa.array((scores >= ACCEPT).astype(np.int32))], names=[*kept, "score", "predicted"])

    return source.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """docs whose text the model accepts, with the same columns; a model that has learned nothing accepts all."""
    if not model.learned:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(model.differences(batch.column(batch.schema.get_field_index(text)).to_pylist()))
            yield batch.filter(pa.array(scores >= accept))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str) -> Column:
    """True for rows that nothing may be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))
