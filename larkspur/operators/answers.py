"""Search requests, answered in batch: caps, budgets, the relevance gate, the nearest chunks and what it cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import cost
from larkspur.functions.text import decoded_size, effective_query, valid_keys
from larkspur.operators import search, vision
from larkspur.operators.budget import blocked
from larkspur.operators.models import Model, predict

#: The longest query, and images of a request.
LONGEST_QUERY, MOST_IMAGES, MOST_IMAGE_BYTES = 500, 5, 5 * 1024 * 1024
#: Rows of a task that sorts or gathers them.
TASK_ROWS = 1_000_000
UPLOAD_TYPES = ["image/jpeg", "image/png", "image/webp"]


def request_problem(query: Column, n_images: Column, k: Column) -> Column:
    """Why a request is not let in, or null."""
    images = F.coalesce(n_images, F.lit(0))
    return (
        F.when(query.isNull() & (images == 0), "no input").when(query.isNotNull() & ~F.length(query).between(1, LONGEST_QUERY), "query length")
        .when(images > MOST_IMAGES, "too many images").when(k.isNotNull() & ~k.between(1, search.MOST_K), "k")
    )


def upload_problem(mime: Column, encoded: Column) -> Column:
    """Why an uploaded image is not let in, or null."""
    size = decoded_size(encoded)
    return F.when(~F.coalesce(mime.isin(UPLOAD_TYPES), F.lit(False)), "type").when(size.isNull(), "not base64").when(size > MOST_IMAGE_BYTES, "size")


@dataclass
class Answered:
    results: DataFrame  # request_id, rank, vec_id, distance and the chunk's shown columns
    rejected: DataFrame  # request_id, problem
    spend: DataFrame  # request_id, category, usd


def answer(requests: DataFrame, chunks: DataFrame, seen_images: DataFrame, spent: DataFrame, caps: dict[str, float], k: int, show: tuple[str, ...] = ()) -> Answered:
    """requests: request_id, query, n_images, image_hash, vector (of the effective query); seen_images: image_hash, is_relevant, description,
    cached; spent: category, spent (as text, of today); chunks: vec_id, embedding and what is shown.

    Rejected requests are kept with their reason. A description from the cache is free; one that is not is paid for, also where
    the image turns out to be irrelevant, but not where no sound answer came (no row of seen_images, or a null is_relevant). The query's vector is paid
    for only when it is searched with.
    """
    # one row of budgets by category, a bounded number of them
    budgets = spent.agg(*(F.coalesce(F.bool_or((F.col("category") == c) & blocked(F.col("spent"), cap)), F.lit(False)).alias(f"no_{c}") for c, cap in caps.items()))
    has_images = F.coalesce(F.col("n_images"), F.lit(0)) > 0
    seen = requests.join(seen_images, "image_hash", "left").crossJoin(F.broadcast(budgets))
    fresh = has_images & ~F.coalesce(F.col("cached"), F.lit(False))
    problem = (
        F.when(request_problem(F.col("query"), F.col("n_images"), F.lit(k)).isNotNull(), request_problem(F.col("query"), F.col("n_images"), F.lit(k)))
        .when(F.col("no_embedding"), "embedding budget").when(fresh & F.col("no_vision"), "vision budget").when(has_images & F.col("is_relevant").isNull(), "not understood").when(has_images & ~F.col("is_relevant"), "not relevant")
    )
    judged = seen.withColumns({"problem": problem, "fresh": fresh, "asked": effective_query(F.col("query"), F.when(has_images, F.col("description")))})
    accepted = judged.filter("problem is null")
    found = search.top_k_each(accepted.select(F.col("request_id").alias("query_id"), F.col("vector").alias("query")).filter("query is not null"), chunks, k)
    results = found.withColumnRenamed("query_id", "request_id").join(chunks.select("vec_id", *show), "vec_id").select("request_id", "rank", "vec_id", "distance", *show)
    paid = judged.filter(F.col("fresh") & (F.col("problem").isNull() | (F.col("problem") == "not relevant")))
    vision_spend = paid.select("request_id", F.lit("vision").alias("category"), cost.image_cost(F.col("n_images")).alias("usd"))
    embedding_spend = accepted.select("request_id", F.lit("embedding").alias("category"), cost.embedding_cost(cost.approx_tokens(F.col("asked"))).alias("usd"))
    return Answered(results, judged.filter("problem is not null").select("request_id", "problem"), vision_spend.unionByName(embedding_spend))


def uploads(images: Column) -> Column:
    """Images (mime, base64) as the uploads of a model's request: numbered names with the type's ending, and data URLs."""
    ending = lambda i: F.coalesce(F.get(F.split(i["mime"], "/"), F.lit(1)), F.lit("bin"))
    return F.transform(images, lambda i, n: F.struct(F.concat(F.lit("image-"), n.cast("string"), F.lit("."), ending(i)).alias("name"), i["mime"].alias("mime"), F.concat(F.lit("data:"), i["mime"], F.lit(";base64,"), i["base64"]).alias("data")))


def understood(requests: DataFrame, cache: DataFrame, model: Model) -> DataFrame:
    """(image_hash, is_relevant, description, cached) of the images of requests (images: mime, base64), for answer(): from the cache (image_hash, answer),
    or else from the model, which is asked once for equal images. What cannot be parsed has a null is_relevant.
    """
    shown = requests.filter(F.size("images") > 0).withColumn("_question", F.to_json(F.struct(F.lit("").alias("question"), uploads(F.col("images")).alias("uploads"))))
    distinct = shown.groupBy("image_hash").agg(F.min("_question").alias("_question"))
    known = distinct.join(cache.groupBy("image_hash").agg(F.max("answer").alias("_known")), "image_hash", "left").withColumn("cached", F.col("_known").isNotNull())
    asked = predict(known.withColumn("_question", F.when(~F.col("cached"), F.col("_question"))), "_question", model, "_answer")
    parsed = vision.parse(asked.withColumn("_text", F.coalesce("_known", "_answer")), "_text")
    sound = F.col("problem").isNull()
    return parsed.select("image_hash", F.when(sound, F.col("is_relevant")).alias("is_relevant"), F.when(sound, F.col("description")).alias("description"), "cached")


def with_urls(results: DataFrame, urls: DataFrame, keys: str = "image_urls") -> DataFrame:
    """results with the URLs of their sound image keys, in order."""
    sound = results.withColumn(keys, valid_keys(F.col(keys)))
    return search.attach_urls(sound, urls, "vec_id", keys)


def tasks(rows: DataFrame) -> int:
    """Into how many tasks to deal rows, so that each holds about TASK_ROWS however many rows there are; the session's number at least."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def grouped(results: DataFrame, items: DataFrame, related: DataFrame) -> DataFrame:
    """(kind, id, source_ids): the items found and what they are related to, each with the items that led to it.

    results: item_id; items: item_id, kind; related: item_id, related_id, kind.
    """
    items = items.select("kind", F.col("item_id").alias("id"), "item_id").unionByName(related.select("kind", F.col("related_id").alias("id"), "item_id"))
    n = tasks(items)
    found = items.repartition(n, "item_id").join(results.select("item_id").repartition(n, "item_id"), "item_id", "left_semi")
    return found.repartition(n, "kind", "id").groupBy("kind", "id").agg(F.array_sort(F.collect_set("item_id")).alias("source_ids"))


def remembered(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """requests with the result of an equal query (query_hash: sha256 of the text) that is still alive; cache: query_hash, result, expires_at."""
    # of several live results the one that lives longest
    alive = cache.filter(F.col("expires_at") > now).groupBy("query_hash").agg(F.max_by("result", F.struct("expires_at", "result")).alias("result"))
    return requests.withColumn("query_hash", F.sha2("query", 256)).join(alive, "query_hash", "left")
