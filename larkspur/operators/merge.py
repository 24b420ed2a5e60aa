"""Incremental merge of chunks and mappings: joins on content hashes against the stored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.net import valid_id


def content_hash(*parts: str) -> Column:
    """A digest of the parts in order. Each is written with its length, and a null as a sign of its own, so no two lists of parts are alike."""
    written = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), F.col(p).cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*written), 256)


def stable_hash(fields: dict[str, Column], arrays: tuple[str, ...] = ()) -> Column:
    """A digest of named fields whose order does not matter; those named in arrays are sorted, and nulls are kept."""
    sorted_ = {k: F.sort_array(c) if k in arrays else c for k, c in fields.items()}
    return F.sha2(F.to_json(F.struct(*(c.alias(k) for k, c in sorted(sorted_.items()))), {"ignoreNullFields": "false"}), 256)


def delta(stored: DataFrame, incoming: DataFrame, source: str = "source_id", digest: str = "hash", touched: DataFrame | None = None, force_update: bool = False) -> DataFrame:
    """(source, digest, change) with change added, skipped (updated, if what is there already is written again all the same) or deleted.

    Chunks are deleted only of sources that come in again; others stay untouched and are not in the result. Sources that come in without any chunk are
    in touched, if that is given.
    """
    touched = (incoming if touched is None else touched).select(source).distinct()
    old = stored.select(source, digest).distinct().join(touched, source, "left_semi").withColumn("old", F.lit(True))
    new = incoming.select(source, digest).distinct().withColumn("new", F.lit(True))
    both = old.join(new, [source, digest], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("updated" if force_update else "skipped")
    return both.select(source, digest, change.alias("change"))


def outcomes(changes: DataFrame, source: str = "source_id") -> DataFrame:
    """Per source: counts and the outcome. A source is skipped if something was and nothing was added."""
    return upsert_counts(changes, source).withColumn("outcome", outcome(F.lit("d"), F.col("num_added"), F.col("num_updated"), F.col("num_skipped"))).drop("num_updated")


def upsert_counts(changes: DataFrame, source: str = "source_id") -> DataFrame:
    """Per source: num_added, num_updated, num_skipped and num_deleted."""
    return changes.groupBy(source).agg(*(F.count_if(F.col("change") == c).alias(f"num_{c}") for c in ("added", "updated", "skipped", "deleted")))


def outcome(doc_id: Column, added: Column, updated: Column, skipped: Column) -> Column:
    """failed without a sound document id, skipped if something was and nothing was added or updated, else upserted; null counts are 0."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return F.when(~valid_id(doc_id), "failed").when((n(skipped) > 0) & (n(added) == 0) & (n(updated) == 0), "skipped").otherwise("upserted")


def loaders_to_delete(gone: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Removed mappings whose loader is there to delete; those with an empty document id only leave the mapping."""
    return gone.filter(F.coalesce(F.col(doc_id), F.lit("")) != "")


def apply_delta(stored: DataFrame, incoming: DataFrame, source: str = "source_id", digest: str = "hash", touched: DataFrame | None = None) -> DataFrame:
    """The new version of the stored chunks; touched as for delta()."""
    touched = (incoming if touched is None else touched).select(source).distinct()
    kept = stored.join(touched, source, "left_anti").unionByName(stored.join(incoming.select(source, digest).distinct(), [source, digest], "left_semi"))
    added = incoming.join(stored.select(source, digest).distinct(), [source, digest], "left_anti").dropDuplicates([source, digest])
    return kept.unionByName(added)


def removed(mapping: DataFrame, items: DataFrame, key: str = "external_id", sync_mode: str = "full", legacy_sweep: bool = False) -> DataFrame:
    """Mapped ids that no item has. Only a full snapshot removes; legacy_sweep removes after partial ones as well."""
    gone = mapping.join(items.select(key), key, "left_anti")
    return gone if sync_mode == "full" or legacy_sweep else gone.limit(0)


def upsert_mapping(mapping: DataFrame, incoming: DataFrame, gone: DataFrame | None = None, key: str = "external_id", order: str = "pos") -> DataFrame:
    """Known ids keep their row, new ones get the last of theirs, removed ones go."""
    last = incoming.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r", order)
    out = mapping.unionByName(last.join(mapping.select(key), key, "left_anti"))
    return out if gone is None else out.join(gone.select(key), key, "left_anti")


def soft_delete(rows: DataFrame, last_seen: str, started: Column, sync_mode: str) -> DataFrame:
    """is_deleted for rows that a full run has not seen."""
    return rows.withColumn("is_deleted", (F.col(last_seen) < started) & F.lit(sync_mode == "full"))


def refresh_counters(kinds: DataFrame, kind: str = "kind") -> DataFrame:
    c = F.col(kind)
    counted = [F.count_if(c == k).alias(k) for k in ("upserted", "skipped", "removed")]
    return kinds.agg(*counted, F.count_if(~c.isin("upserted", "skipped", "removed")).alias("failed"))
