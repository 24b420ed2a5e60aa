"""Objects in a store that Spark reads: listings, images within caps, and document loaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import mime_of

MOST_IMAGES, MOST_IMAGE_BYTES = 5, 5 * 1024 * 1024
#: MIME types that are taken.
IMAGE_TYPES = ["image/jpeg", "image/png", "image/gif", "image/webp"]


def heads(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modificationTime; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def object_keys(objects: DataFrame, base: str) -> DataFrame:
    """objects with their key: the path below base, however the file system writes the path's beginning."""
    below = "/" + base.split(":", 1)[-1].strip("/") + "/"
    return objects.withColumn("object_key", F.substring_index(F.col("path"), below, -1))


def image_inputs(items: DataFrame, objects: DataFrame, key: str, keys: str, base: str) -> DataFrame:
    """(key, pos, object_key, mime, content) of each item's first images in the folder base; too large ones, other types and misses are left out."""
    asked = items.select(key, F.posexplode(F.slice(keys, 1, MOST_IMAGES)).alias("pos", "object_key")).withColumn("mime", mime_of(F.col("object_key")))
    fit = object_keys(objects.filter(F.col("length") <= MOST_IMAGE_BYTES), base).select("object_key", "content")
    return asked.filter(F.col("mime").isin(IMAGE_TYPES)).join(fit, "object_key").select(key, "pos", "object_key", "mime", "content")


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one document."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def put(content: DataFrame, path: str) -> None:
    """Write rows (object_key, content) as they are, as one object table."""
    content.select("object_key", "content").write.mode("overwrite").parquet(path)


def get_object(objects: DataFrame, object_key: str) -> DataFrame:
    """The one object of this key. None, or one without content, is an error."""
    found = objects.filter(F.col("object_key") == object_key).limit(1)
    if found.filter(F.length("content") > 0).isEmpty():
        raise LookupError(f"no object {object_key}")
    return found


def delete_objects(objects: DataFrame, object_keys_: list[str]) -> DataFrame:
    return objects.filter(~F.col("object_key").isin(object_keys_))


def put_objects(stored: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The next version of an object table (object_key, content, etag, length, modified): new objects (object_key, content) replace those of their keys.

    The etag is the content's MD5; an object whose content is what it was keeps its time. Of several new objects of a key that of the greatest etag is taken.
    """
    one = new.withColumn("etag", F.md5("content")).groupBy("object_key").agg(F.max_by("content", "etag").alias("content"), F.max("etag").alias("etag"))
    before = stored.select("object_key", F.col("etag").alias("_etag"), F.col("modified").alias("_modified"))
    put = one.join(before, "object_key", "left").select("object_key", "content", "etag", F.length("content").alias("length"), F.when(F.col("etag") == F.col("_etag"), F.col("_modified")).otherwise(now).alias("modified"))
    return stored.select(put.columns).join(new.select("object_key"), "object_key", "left_anti").unionByName(put)


def json_documents(raw: DataFrame, column: str, pointer: str, metadata: dict[str, str] | None = None) -> DataFrame:
    """raw with text at a JSON path, and metadata from other paths (those without a leading slash are ignored)."""
    at = lambda p: F.get_json_object(column, "$" + p.replace("/", "."))
    found = {k: at(p) for k, p in (metadata or {}).items() if p.startswith("/")}
    pairs = [x for k, v in found.items() for x in (F.lit(k), v)]
    return raw.withColumn("text", at(pointer)).withColumn("metadata", F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))


def with_metadata(docs: DataFrame, text: str, metadata: list[str]) -> DataFrame:
    return docs.select(F.col(text).alias("text"), F.to_json(F.struct(*metadata)).alias("metadata"))
