"""Registries of sources, stores, flows and messages: filters, pages, summaries and versioned edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_PAGE, MOST_PAGE, MOST_LISTED = 20, 100, 500


def conjunction(**wanted) -> Column:
    """All given equalities; None is no condition."""
    return reduce(lambda a, b: a & b, (F.col(k) == v for k, v in wanted.items() if v is not None), F.lit(True))


def allowed(name: str, tables: list[str]) -> str:
    """A table's name, if it is one of those that may be read."""
    if name not in tables:
        raise ValueError(f"table {name} is not allowed")
    return name


def config_problem(config: Column) -> Column:
    """Why a stored configuration (JSON text of a name and an object) cannot be used, or null."""
    whole = F.try_parse_json(config)
    name = F.try_variant_get(whole, "$.name", "string")
    inner = F.schema_of_variant(F.try_variant_get(whole, "$.config", "variant"))
    return (
        F.when(whole.isNull(), "not JSON").when(~F.startswith(F.schema_of_variant(whole), F.lit("OBJECT")), "not an object")
        .when(F.coalesce(name, F.lit("")) == "", "no name").when(~F.coalesce(F.startswith(inner, F.lit("OBJECT")), F.lit(False)), "no config")
    )


def find_by_name(rows: DataFrame, name: str, wanted: str, key: str) -> DataFrame:
    """The row of this name, of smallest key if there are several. None is an error."""
    found = rows.filter(F.col(name) == wanted).orderBy(key).limit(1)
    if found.isEmpty():
        raise LookupError(f"nothing is named {wanted}")
    return found


def owned_by(owner: str, user: str | None) -> Column:
    """An anonymous user sees only rows without an owner."""
    return F.col(owner).eqNullSafe(F.lit(user))


def page(rows: DataFrame, newest: str, key: str, number: int = 1, size: int = DEFAULT_PAGE) -> DataFrame:
    """A page of the newest rows first; ties go by key."""
    if number < 1 or not 1 <= size <= MOST_PAGE:
        raise ValueError(f"pages start at 1 and have 1 to {MOST_PAGE} rows")
    return rows.orderBy(F.desc(newest), key).offset((number - 1) * size).limit(size)


def page_with_total(rows: DataFrame, newest: str, key: str, number: int = 1, size: int = DEFAULT_PAGE) -> DataFrame:
    """A page with the number of all rows in ``total``, counted by a scan of its own that reads only the columns of the filter."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return page(rows, newest, key, number, size).crossJoin(F.broadcast(total))  # one row


def text_source(rows: DataFrame, now: Column) -> DataFrame:
    """Rows (id, user_id, title, raw_text) as new sources of the registry: ready, done and timed, with the text as it is."""
    times = {c: now for c in ("created_at", "updated_at", "started_at", "completed_at")}
    none = F.lit(None).cast("string")
    return rows.withColumns({"source_type": F.lit("text"), "status": F.lit("ready"), "progress": F.lit(100), "storage_key": none, "source_url": none, "extracted_text": F.col("raw_text"), "metadata": none, "error": none} | times)


#: Columns of a source that a response shows.
RESPONSE = ["id", "source_type", "status", "progress", "title", "source_url", "created_at", "updated_at", "started_at", "completed_at"]


def source_response(sources: DataFrame) -> DataFrame:
    return sources.select(*RESPONSE)


def flow_detail(flows: DataFrame, id_: str, with_data: bool = False) -> DataFrame:
    """One flow; its graph, the heavy column, is read only if asked for."""
    return flows.filter(F.col("id") == id_).select(*(c for c in flows.columns if with_data or c != "flow_data"))


def component_summary(components: DataFrame) -> DataFrame:
    """name, label, category, class_line and inputs as (name, label, type, optional), which a missing flag makes false."""
    slim = F.transform("inputs", lambda i: F.struct(i["name"].alias("name"), i["label"].alias("label"), i["type"].alias("type"), F.coalesce(i["optional"], F.lit(False)).alias("optional")))
    return components.select("name", "label", "category", F.array_join("base_classes", " | ").alias("class_line"), F.coalesce(slim, F.array().cast("array<struct<name:string,label:string,type:string,optional:boolean>>")).alias("inputs"))


def picked(rows: DataFrame, columns: list[str], **wanted) -> DataFrame:
    """A narrow listing: the rows that match, with these columns only."""
    return rows.filter(conjunction(**wanted)).select(*columns)


#: Narrow listings of nodes, tools, assistants, messages and retrieved chunks.
NODE, TOOL, ASSISTANT = ["name", "label", "category"], ["id", "name", "description"], ["id", "name", "type"]
MESSAGE, RETRIEVED = ["id", "role", "content", "created_date"], ["id", "chunk_no", "page_content", "metadata"]


def orphans(chunks: DataFrame, sources: DataFrame, source: str = "source_id", key: str = "id") -> DataFrame:
    """Chunks whose source is not there (any more)."""
    return chunks.join(sources.select(F.col(key).alias(source)), source, "left_anti")


def error_message(payload: Column) -> Column:
    """The message of a JSON error: a text payload itself, else its message, else its error; text that is no JSON stands for itself."""
    whole = F.try_parse_json(payload)
    of = lambda path: F.try_variant_get(whole, path, "string")
    is_text = F.schema_of_variant(whole) == "STRING"
    return F.when(whole.isNull(), payload).when(is_text, of("$")).otherwise(F.coalesce(of("$.message"), of("$.error")))


def clone_flow(flow: DataFrame, new_id: str, name: str, types: list[str]) -> DataFrame:
    """A copy under a new name: neither deployed nor public, and without a type that is not known."""
    return flow.withColumns({"id": F.lit(new_id), "name": F.lit(name), "deployed": F.lit(False), "is_public": F.lit(False), "type": F.when(F.col("type").isin(types), F.col("type"))})


def clone_store(store: DataFrame, new_id: str, name: str) -> DataFrame:
    """A copy with the configurations that can be read, and without loaders."""
    configs = {c: F.when(config_problem(F.col(c)).isNull(), F.col(c)) for c in ("vector_store_config", "embedding_config", "record_manager_config")}
    return store.withColumns({"id": F.lit(new_id), "name": F.lit(name), "loaders": F.array().cast("array<string>")} | configs)


def listing(rows: DataFrame, order: str, key: str, descending: bool = False, limit: int = MOST_LISTED) -> DataFrame:
    if not 1 <= limit <= MOST_LISTED:
        raise ValueError(f"a listing has 1 to {MOST_LISTED} rows")
    return rows.orderBy(F.desc(order) if descending else F.asc(order), key).limit(limit)


def last_each(rows: DataFrame, session: str, order: str, k: int) -> DataFrame:
    """The last k rows of each session; of rows of equal order those whose whole content is greatest."""
    own = Window.partitionBy(session).orderBy(F.desc(order), F.desc(F.struct(*(c for c in sorted(rows.columns) if c not in (session, order)))))
    return rows.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= k).drop("_r")


def by_name(rows: DataFrame, name: str, wanted: str, exact: bool = False) -> DataFrame:
    return rows.filter(F.col(name) == wanted if exact else F.contains(F.lower(name), F.lit(wanted.lower())))


def store_summary(stores: DataFrame, loaders: DataFrame | None = None) -> DataFrame:
    """Stores with the number of their loaders: of the list in each row, or of a table of loaders (store_id), which is counted before it is joined."""
    if loaders is not None:
        counted = loaders.groupBy(F.col("store_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
        stores = stores.join(counted, "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    number = F.col("_n") if loaders is not None else F.coalesce(F.size("loaders"), F.lit(0)).cast("bigint")
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return stores.select("id", "name", "status", number.alias("loaders_count"), has("embedding_config").alias("has_embedding"), has("vector_store_config").alias("has_vector_store"))


def flow_summary(flows: DataFrame, kind: str | None = None) -> DataFrame:
    """A kind is matched against the stored value, before the default is filled in."""
    found = flows if kind is None else flows.filter(F.col("type") == kind)
    return found.select("id", "name", F.coalesce("type", F.lit("CHATFLOW")).alias("type"), F.coalesce("deployed", F.lit(False)).alias("deployed"), F.coalesce("is_public", F.lit(False)).alias("is_public"), "category")


def patch(rows: DataFrame, key: str, id_, **new) -> DataFrame:
    """rows with new values (None: as before) in the row of this key."""
    hit = F.col(key) == id_
    return rows.withColumns({c: F.when(hit, F.coalesce(F.lit(v), F.col(c))).otherwise(F.col(c)) for c, v in new.items() if v is not None})


def remove(rows: DataFrame, condition: Column) -> DataFrame:
    """rows without those of which the condition is true."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def soft_delete(rows: DataFrame, key: str, ids: list[int]) -> DataFrame:
    return rows.withColumn("is_deleted", F.coalesce(F.col("is_deleted"), F.lit(False)) | F.col(key).isin(ids))


def probed_counts(readers: dict) -> DataFrame:
    """(entity, n, problem): rows of the table that each reader gives; one that cannot be read has -1 and the reason."""
    parts = []
    for name, reader in readers.items():
        try:
            parts.append(reader().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n", F.lit(None).cast("string").alias("problem")))
        except Exception as e:  # noqa: BLE001  whatever keeps a table from being read is its row's reason
            spark = SparkSession.active()
            parts.append(spark.range(1).select(F.lit(name).alias("entity"), F.lit(-1).cast("bigint").alias("n"), F.lit(type(e).__name__).alias("problem")))
    return reduce(DataFrame.unionByName, parts)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, n) of each table, as one plan."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def source_violations(rows: DataFrame) -> DataFrame:
    """Rows that break the checks of the source registry: exactly one payload, progress from 0 to 100. As in a CHECK, a null progress breaks none."""
    payloads = sum((F.col(c).isNotNull().cast("int") for c in ("storage_key", "source_url", "raw_text")), F.lit(0))
    return rows.filter((payloads != 1) | ~F.col("progress").between(0, 100))
