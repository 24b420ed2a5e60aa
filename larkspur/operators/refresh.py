"""The refresh of a catalog: snapshot, augmentation, incremental merge, sweep and counters, over all items at once.

Nothing is written here: each step gives the next version of a state table, which the caller writes when all of them are there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import augmented, cut_description, strip_any_fence
from larkspur.operators import augment, chunks, merge
from larkspur.operators.models import Model, predict

LABEL = "Visual description"
#: Model calls of one refresh.
MOST_CALLS = 500


def describe_items(items: DataFrame, cache: DataFrame, model: Model, version: str, cap: int = MOST_CALLS) -> DataFrame:
    """items (external_id, pos, image_digests) with image_hash, hit, call and visual_description.

    A cached description of the same images and model is taken; of the others the first cap, in order of pos, are put to the model,
    whose answer loses its fence and is cut. Items without images are not described.
    """
    hashed = items.withColumn("image_hash", augment.set_hash(F.col("image_digests")))
    known = augment.cached(hashed, cache, "external_id", version)
    has_images = F.coalesce(F.size("image_digests"), F.lit(0)) > 0
    called = augment.capped(known, ~F.col("hit") & has_images, "pos", cap, "external_id")
    asked = predict(called.withColumn("_question", F.when(F.col("call"), F.concat_ws(" ", "external_id", "image_hash"))), "_question", model, "_answer")
    answer = F.nullif(cut_description(strip_any_fence(F.col("_answer"))), F.lit(""))
    return asked.withColumn("visual_description", F.when(F.col("hit"), F.col("visual_description")).otherwise(answer)).drop("_question", "_answer")


def next_cache(described: DataFrame, cache: DataFrame, gone: DataFrame, version: str) -> DataFrame:
    """(external_id, image_hash, visual_description, model_version): new descriptions replace old ones, and those of removed items go."""
    new = described.filter(F.col("call") & F.col("visual_description").isNotNull()).select("external_id", "image_hash", "visual_description", F.lit(version).alias("model_version"))
    old = cache.select(*new.columns).join(new.select("external_id"), "external_id", "left_anti").join(gone.select("external_id"), "external_id", "left_anti")
    return old.unionByName(new)


@dataclass
class Refreshed:
    """What a refresh gives: tables that are read from the same plan."""

    outcomes: DataFrame  # external_id, doc_id, num_added, num_skipped, num_deleted, outcome
    mapping: DataFrame  # external_id, doc_id
    chunks: DataFrame  # source_id, doc_id, chunk_no, chunk, hash
    gone: DataFrame  # external_id, doc_id of removed items
    counters: DataFrame  # one row: upserted, skipped, removed, failed


def merge_items(items: DataFrame, mapping: DataFrame, stored: DataFrame, sync_mode: str = "full", legacy_sweep: bool = False, undeleted: DataFrame | None = None) -> Refreshed:
    """items: external_id, pos, content, visual_description; mapping: external_id, doc_id; stored: the chunk table.

    Of several items of one id the last by pos is taken. New items get a document id from their own; chunks are compared by their hash; an item
    that has become empty loses its chunks; chunks of removed items go with them, but for those whose deletion failed (undeleted: doc_id), which are not counted as removed.
    """
    whole_row = F.struct(*items.columns)
    items = items.groupBy("external_id").agg(F.max_by(whole_row, F.struct("pos", *(c for c in ("content", "visual_description") if c in items.columns))).alias("_last")).select("_last.*")
    known = items.join(mapping.select("external_id", F.col("doc_id").alias("_known")), "external_id", "left")
    named = known.withColumn("doc_id", F.coalesce("_known", F.concat(F.lit("doc-"), F.substring(F.sha2(F.col("external_id").cast("string"), 256), 1, 16)))).drop("_known")
    whole = named.withColumn("content", augmented(F.col("content"), F.col("visual_description"), LABEL))
    parts = chunks.fixed_windows(whole, "external_id", "content").join(whole.select("external_id", "doc_id"), "external_id")
    incoming = parts.select(F.col("external_id").alias("source_id"), "doc_id", "chunk_no", "chunk").withColumn("hash", merge.content_hash("chunk", "doc_id"))
    touched = named.select(F.col("external_id").alias("source_id"))
    counts = merge.delta(stored, incoming, touched=touched).groupBy(F.col("source_id").alias("external_id")).agg(*(F.count_if(F.col("change") == c).alias(f"num_{c}") for c in ("added", "skipped", "deleted")))
    zero = {f"num_{c}": F.coalesce(F.col(f"num_{c}"), F.lit(0)) for c in ("added", "skipped", "deleted")}
    outcomes = named.select("external_id", "doc_id").join(counts, "external_id", "left").withColumns(zero)
    outcomes = outcomes.withColumn("outcome", merge.outcome(F.col("doc_id"), F.col("num_added"), F.lit(0), F.col("num_skipped")))
    gone = merge.removed(mapping, items, sync_mode=sync_mode, legacy_sweep=legacy_sweep)
    swept = merge.loaders_to_delete(gone)
    if undeleted is not None:
        swept = swept.join(undeleted.select("doc_id"), "doc_id", "left_anti").select("external_id", "doc_id")
    kept = merge.apply_delta(stored, incoming, touched=touched).join(swept.select(F.col("external_id").alias("source_id")), "source_id", "left_anti")
    next_mapping = merge.upsert_mapping(mapping, named.filter(F.col("doc_id") != "").select("external_id", "doc_id", "pos"), gone)
    kinds = outcomes.select(F.col("outcome").alias("kind")).unionByName(swept.select(F.lit("removed").alias("kind")))
    return Refreshed(outcomes, next_mapping, kept, gone, merge.refresh_counters(kinds))


def snapshot_digest(items: DataFrame) -> str:
    """One digest of what a snapshot's items say, whatever their order; bucket by bucket, so no task has all of them."""
    parts = items.select(F.lit(0).alias("_all"), merge.content_hash("external_id", "content", "visual_description").alias("_h"))
    found = augment.bucketed_hash(parts, "_all", "_h").select("set_hash").collect()
    return found[0]["set_hash"] if found else ""


def refresh_snapshot(items: DataFrame, mapping: DataFrame, stored: DataFrame, last_digest: str | None, **options) -> tuple[Refreshed | None, str]:
    """The refresh of a snapshot, or None if its digest is the last one: then no chunk is made or compared. The digest is kept for the next run."""
    digest = snapshot_digest(items)
    return (None if digest == last_digest else merge_items(items, mapping, stored, **options)), digest


def recovered_mapping(mapping: DataFrame, loaders: DataFrame) -> DataFrame:
    """The mapping, or, if it is empty and there are loaders (external_id, doc_id), what the loaders say."""
    empty = mapping.agg((F.count(F.lit(1)) == 0).alias("_empty"))
    return mapping.unionByName(loaders.select("external_id", "doc_id").crossJoin(F.broadcast(empty)).filter("_empty").drop("_empty"))


def recovered_texts(stored: DataFrame, overlap: int = chunks.OVERLAP) -> DataFrame:
    """(source_id, text): chunks (source_id, chunk_no, chunk) put together again, each without what it repeats of the one before.

    What is repeated is the longest beginning, of overlap characters at most, that the text so far ends in. A source's chunks are as long as its text.
    """
    parts = stored.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))).alias("parts"))
    longest = lambda text, part: F.coalesce(F.get(F.filter(F.sequence(F.lit(overlap), F.lit(1), F.lit(-1)), lambda n: F.endswith(text, F.left(part, n)) & (F.length(part) >= n)), F.lit(0)), F.lit(0))
    # windows of fixed size repeat overlap characters, which is looked for first
    repeated = lambda text, part: F.when(F.endswith(text, F.left(part, F.lit(overlap))) & (F.length(part) >= overlap), overlap).otherwise(longest(text, part))
    joined = F.aggregate("parts", F.lit("").cast("string"), lambda text, p: F.when(text == "", p["chunk"]).otherwise(F.concat(text, F.substring(p["chunk"], repeated(F.right(text, F.lit(overlap)), p["chunk"]) + 1, F.length(p["chunk"])))))
    return parts.select("source_id", joined.alias("text"))


def recovered_descriptions(stored: DataFrame, hashes: DataFrame, overlap: int = chunks.OVERLAP) -> DataFrame:
    """(external_id, image_hash, visual_description) read back from chunk texts, for items whose images (external_id, image_hash) are known.

    Chunks are put together first, as a description, or its label, may be cut between them.
    """
    whole = recovered_texts(stored.join(hashes.select(F.col("external_id").alias("source_id")).distinct(), "source_id", "left_semi"), overlap)
    found = whole.select(F.col("source_id").alias("external_id"), F.regexp_extract("text", rf"(?s)^.*\n\n{LABEL}: (.*)$", 1).alias("visual_description")).filter("visual_description <> ''")
    return found.join(hashes, "external_id").select("external_id", "image_hash", "visual_description")
