"""Catalog snapshots: read with an explicit schema, checked as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.schemas import SNAPSHOT

MOST_BYTES = 100 * 1024 * 1024
#: Allowed values and longest lengths.
SOURCES, TYPES, KINDS = ["moysklad", "1c", "manual"], ["product", "service", "cartridge", "bundle"], ["installation", "maintenance", "other"]
MODES = ["full", "partial"]
LENGTHS = {"externalId": (1, 256), "externalUpdatedAt": (0, 64), "name": (1, 200), "contentForEmbedding": (1, 50_000), "contentHash": (1, 128)}
OPTIONAL_LENGTHS = {"description": 10_000, "categoryPath": 500}
MOST_KEYS, LONGEST_KEY, MOST_RELATED, LONGEST_TIME = 50, 1024, 100, 64


def _related(column: str, kinds: bool) -> Column:
    def good(r: Column) -> Column:
        fits = F.coalesce(F.length(r["id"]).between(1, 64) & F.length(r["name"]).between(1, 200), F.lit(False))
        return fits & F.coalesce(r["kind"].isin(KINDS), F.lit(False)) if kinds else fits

    return F.col(column).isNull() | ((F.size(column) <= MOST_RELATED) & F.forall(column, good))


def rules() -> dict[str, Column]:
    """A condition that holds for a sound item, by the name of the field it is about."""
    out = {c: F.coalesce(F.length(c).between(a, b), F.lit(False)) for c, (a, b) in LENGTHS.items()}
    out |= {c: F.col(c).isNull() | (F.length(c) <= n) for c, n in OPTIONAL_LENGTHS.items()}
    out |= {"externalSource": F.coalesce(F.col("externalSource").isin(SOURCES), F.lit(False)), "externalType": F.coalesce(F.col("externalType").isin(TYPES), F.lit(False)), "isVisible": F.col("isVisible").isNotNull()}
    for c in ("imageUrls", "groupImageKeys"):
        out[c] = F.col(c).isNull() | ((F.size(c) <= MOST_KEYS) & F.forall(c, lambda k: F.coalesce(F.length(k) <= LONGEST_KEY, F.lit(False))))
    out["relatedServices"], out["relatedComponents"] = _related("relatedServices", True), _related("relatedComponents", False)
    return out


def violations(items: DataFrame) -> DataFrame:
    """Items that break a rule, with the names of the fields in ``broken``."""
    broken = F.filter(F.array(*(F.when(~ok, F.lit(name)) for name, ok in sorted(rules().items()))), lambda x: x.isNotNull())
    return items.withColumn("broken", broken).filter(F.size("broken") > 0)


def envelope_violations(whole: DataFrame) -> DataFrame:
    """Envelopes with a wrong mode or source system, no time, or no items, with the names of what is wrong in ``broken``."""
    among = lambda c, allowed: F.coalesce(F.col(c).isin(allowed), F.lit(False))
    sound = {"items": F.col("items").isNotNull(), "sourceSystem": among("sourceSystem", SOURCES), "syncMode": among("syncMode", MODES), "syncedAt": F.coalesce(F.length("syncedAt") <= LONGEST_TIME, F.lit(False))}
    broken = F.filter(F.array(*(F.when(~ok, F.lit(name)) for name, ok in sorted(sound.items()))), lambda x: x.isNotNull())
    return whole.withColumn("broken", broken).filter(F.size("broken") > 0).select("broken")


def with_defaults(items: DataFrame) -> DataFrame:
    """Missing lists become empty ones."""
    lists = [f for f in items.schema.fields if f.name in ("imageUrls", "groupImageKeys", "relatedServices", "relatedComponents")]
    return items.withColumns({f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in lists})


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One row per item with the envelope's columns. Too large a file, malformed JSON or one bad item fails the whole."""
    size = spark.read.format("binaryFile").load(path).agg(F.max("length").alias("n")).first()["n"]
    if size is not None and size > MOST_BYTES:
        raise ValueError(f"snapshot of {size} bytes; at most {MOST_BYTES}")
    whole = spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    wrong = envelope_violations(whole).collect()
    if wrong:
        raise ValueError(f"parse-payload: {wrong[0]['broken']}")
    items = whole.select("syncMode", "sourceSystem", "syncedAt", F.explode("items").alias("item")).select("syncMode", "sourceSystem", "syncedAt", "item.*")
    bad = violations(items).select("externalId", "broken").limit(5).collect()
    if bad:
        raise ValueError(f"parse-payload: {[(r['externalId'], r['broken']) for r in bad]}")
    return with_defaults(items)


def item_metadata(items: DataFrame) -> Column:
    """The metadata that chunks of an item carry, as JSON with nulls kept."""
    names = ["externalId", "externalType", "externalSource", "name", "description", "categoryPath", "salePriceKopecks", "rangForApp", "imageUrls"]
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
