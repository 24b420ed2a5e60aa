"""Models and embedders that are given by the caller, run in batches within tasks; deterministic ones for tests."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that are given to an embedder or a model at once.
BATCH = 256


class Embedder(Protocol):
    """Vectors of texts, one row each."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Model(Protocol):
    """Answers to questions, in order; an exception fails the whole batch, None one question."""

    def __call__(self, questions: list[str]) -> list[str | None]: ...


class HashingEmbedder:
    """Words counted in hashed dimensions, scaled to length one; a text without words has no direction."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % self.dimensions] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class ScriptedModel:
    """Answers by the first of its keys that a question contains."""

    def __init__(self, answers: dict[str, str | None], otherwise: str | None = None):
        self.answers, self.otherwise = answers, otherwise

    def __call__(self, questions: list[str]) -> list[str | None]:
        return [next((a for k, a in self.answers.items() if k in q), self.otherwise) for q in questions]


def _asked(df: DataFrame, text: str, out: str, kind: str, answer) -> DataFrame:
    """df with what answer gives for each text; equal texts are asked once, and null ones not at all."""
    asked = df.select(F.col(text).alias("text")).filter("text is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                yield pa.RecordBatch.from_arrays([part.column(0), answer(part.column(0).to_pylist())], names=["text", "answer"])

    found = asked.mapInArrow(run, f"text string, answer {kind}")
    return df.join(found.select(F.col("text").alias("_asked"), F.col("answer").alias(out)), F.col(text) == F.col("_asked"), "left").drop("_asked")


def embed(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """df with a vector for each text."""
    return _asked(df, text, out, "array<float>", lambda texts: pa.array([v.tolist() for v in np.asarray(embedder(texts), np.float32)], pa.list_(pa.float32())))


def predict(df: DataFrame, question: str, model: Model, out: str = "answer") -> DataFrame:
    """df with the model's answer to each question; what fails is null."""

    def answers(questions: list[str]) -> pa.Array:
        try:
            return pa.array(model(questions), pa.string())
        except Exception:  # noqa: BLE001  a failed call leaves its questions without an answer, as a failed request does
            return pa.nulls(len(questions), pa.string())

    return _asked(df, question, out, "string", answers)


def described_stores(stores: DataFrame, chunks: DataFrame, model: Model, samples: int = 3) -> DataFrame:
    """stores (id, name) with description: what a model says of a store's name and its first chunks (store_id, chunk_no, chunk); null if it fails."""
    few = chunks.filter(F.col("chunk_no") <= samples).groupBy(F.col("store_id").alias("id")).agg(F.slice(F.array_sort(F.collect_set(F.struct("chunk_no", F.substring("chunk", 1, 200).alias("chunk")))), 1, samples).alias("_few"))
    asked = stores.join(few, "id", "left").withColumn("_question", F.to_json(F.struct(F.col("name"), F.transform(F.coalesce("_few", F.array()), lambda c: c["chunk"]).alias("samples"))))
    return predict(asked, "_question", model, "description").drop("_question", "_few")


def question(form: dict[str, object]) -> str:
    """One question from a form of named values, as text that does not depend on their order."""
    return json.dumps(form, sort_keys=True, ensure_ascii=False)
