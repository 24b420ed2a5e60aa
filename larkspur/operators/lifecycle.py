"""The life of registered rows and of stores: created, patched, loaded, split, embedded, cloned and removed, as versions of state tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import chunks, registry
from larkspur.operators.models import Embedder, embed
from larkspur.sources.state import StateTable

#: Tables of a catalog. Every one has an id; a deleted row leaves the next version.
TABLES = {
    "stores": "id string, name string, description string, status string, vector_store_config string, embedding_config string, record_manager_config string",
    "loaders": "id string, store_id string, loader string, splitter string, status string, total_chunks bigint, total_chars bigint",
    "chunks": "id string, store_id string, loader_id string, chunk_no int, page_content string, metadata string",
    "vectors": "id string, store_id string, embedding array<float>",
    "flows": "id string, name string, type string, deployed boolean, is_public boolean, category string, api_key string, flow_data string",
    "tools": "id string, name string, description string, schema string, source string",
    "assistants": "id string, name string, type string, details string",
    "variables": "id string, name string, type string, value string",
    "attachments": "id string, chat_id string, name string, mime string, content string",
    "messages": "id string, chatflow_id string, chat_id string, chat_type string, role string, content string, created_date timestamp",
}


class Catalog:
    """Named tables in a folder. A change reads the current version and writes the next one; there is one writer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def state(self, kind: str) -> StateTable:
        return StateTable(self.spark, f"{self.path}/{registry.allowed(kind, list(TABLES))}", TABLES[kind])

    def table(self, kind: str, **wanted) -> DataFrame:
        return self.state(kind).read().filter(registry.conjunction(**wanted))

    def get(self, kind: str, id_: str) -> DataFrame:
        found = self.table(kind, id=id_).limit(1)
        if found.isEmpty():
            raise LookupError(f"{kind}: no {id_}")
        return found

    def add(self, kind: str, rows: DataFrame) -> int:
        """Append rows; columns that they lack are null. An id that is taken is an error."""
        state = self.state(kind)
        names = {f.split()[0] for f in TABLES[kind].split(", ")}
        now = state.read()
        if not rows.select("id").join(now.select("id"), "id", "left_semi").isEmpty():
            raise ValueError(f"{kind}: an id is taken")
        return state.write(now.unionByName(rows.select(*(c for c in rows.columns if c in names)), allowMissingColumns=True))

    def create(self, kind: str, **values) -> int:
        types = dict(f.split(" ", 1) for f in TABLES[kind].split(", "))
        return self.add(kind, self.spark.range(1).select(*(F.lit(v).cast(types[c]).alias(c) for c, v in values.items())))

    def update(self, kind: str, id_: str, **new) -> int:
        self.get(kind, id_)
        return self.state(kind).write(registry.patch(self.table(kind), "id", id_, **new))

    def delete(self, kind: str, id_: str | None = None, **wanted) -> int:
        """Remove the row of this id, which must be there, or all rows that match; the number of rows removed."""
        rows = self.table(kind)
        match = registry.conjunction(**({"id": id_} if id_ is not None else wanted))
        n = rows.filter(match).count()
        if id_ is not None and not n:
            raise LookupError(f"{kind}: no {id_}")
        if n:
            self.state(kind).write(registry.remove(rows, match))
        return n

    # stores

    def process_loader(self, loader_id: str, docs: DataFrame, split: Callable[[DataFrame], DataFrame] = chunks.recursive_chunks) -> int:
        """Split docs (doc_id, text) into the loader's chunks, which replace those that it had; the loader gets its totals."""
        store = self.get("loaders", loader_id).select("store_id").first()["store_id"]
        parts = split(docs)
        name = F.concat_ws("-", F.lit(loader_id), F.col("doc_id").cast("string"), F.col("chunk_no").cast("string"))
        made = parts.select(name.alias("id"), F.lit(store).alias("store_id"), F.lit(loader_id).alias("loader_id"), "chunk_no", F.col("chunk").alias("page_content"), F.to_json(F.struct(F.col("doc_id").alias("source_id"))).alias("metadata"))
        self.state("chunks").write(self.table("chunks").filter(F.col("loader_id") != loader_id).unionByName(made))
        total = self.table("chunks", loader_id=loader_id).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("page_content")), F.lit(0)).alias("c")).first()
        return self.update("loaders", loader_id, status="SYNC", total_chunks=total["n"], total_chars=total["c"])

    def delete_loader(self, loader_id: str) -> int:
        """The loader and its chunks; the number of chunks removed."""
        self.delete("loaders", loader_id)
        return self.delete("chunks", loader_id=loader_id)

    def insert_vectors(self, store_id: str, embedder: Embedder) -> int:
        """Embed all chunks of a store; their vectors replace those that it had. The number of vectors."""
        self.get("stores", store_id)
        made = embed(self.table("chunks", store_id=store_id).select("id", "store_id", "page_content"), "page_content", embedder).drop("page_content")
        self.state("vectors").write(self.table("vectors").filter(F.col("store_id") != store_id).unionByName(made))
        return self.table("vectors", store_id=store_id).count()

    def delete_store(self, store_id: str) -> int:
        self.delete("vectors", store_id=store_id)
        self.delete("chunks", store_id=store_id)
        self.delete("loaders", store_id=store_id)
        return self.delete("stores", store_id)

    def refresh_store(self, store_id: str, docs: Callable[[str], DataFrame], embedder: Embedder) -> int:
        """Run all loaders of a store again, each over the documents that docs gives for it, and embed their chunks."""
        for r in self.table("loaders", store_id=store_id).select("id").orderBy("id").collect():
            self.process_loader(r["id"], docs(r["id"]))
        return self.insert_vectors(store_id, embedder)

    def clone_store(self, store_id: str, new_id: str, name: str) -> int:
        return self.add("stores", registry.clone_store(self.get("stores", store_id), new_id, name))

    def clone_flow(self, flow_id: str, new_id: str, name: str, types: list[str]) -> int:
        return self.add("flows", registry.clone_flow(self.get("flows", flow_id), new_id, name, types))

    def full_setup(self, store_id: str, name: str, loader_id: str, docs: DataFrame, embedder: Embedder) -> list[dict]:
        """Create, save the loader, split and embed. Stops at the first step that fails; what was done before stays. Each step with its success and time."""
        steps = {
            "create": lambda: self.create("stores", id=store_id, name=name, status="EMPTY"),
            "save": lambda: self.create("loaders", id=loader_id, store_id=store_id, loader="plainText", splitter="recursive", status="NEW"),
            "process": lambda: self.process_loader(loader_id, docs),
            "insert": lambda: self.insert_vectors(store_id, embedder),
        }
        return probes(steps, stop=True)


def probes(steps: dict[str, Callable[[], object]], stop: bool = False) -> list[dict]:
    """(step, success, problem, elapsed_ms) of each step, in order; with stop none after the first failure."""
    out = []
    for name, step in steps.items():
        began, problem = time.perf_counter(), None
        try:
            step()
        except Exception as e:  # noqa: BLE001  the failure is the step's result
            problem = f"{type(e).__name__}: {e}"[:200]
        out.append({"step": name, "success": problem is None, "problem": problem, "elapsed_ms": round(1000 * (time.perf_counter() - began))})
        if stop and problem:
            break
    return out


def write_by_tenant(vectors: DataFrame, tenant: str, path: str) -> None:
    """One folder for each tenant, so that a search with a tenant reads that folder alone."""
    vectors.repartition(tenant).sortWithinPartitions(tenant).write.mode("overwrite").partitionBy(tenant).parquet(path)
