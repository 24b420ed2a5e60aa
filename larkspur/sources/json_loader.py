"""Documents out of JSON: all strings of a value, those at given pointers, or one document per object.

A value is walked level by level: every container gives its parts, everything else stays as it is, so one narrow pass over the table walks
any depth, and values of different shapes stand next to each other. Places are written as JSON pointers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.variants import at, kind

#: Levels that a value may have.
DEEPEST = 64


def _token(key: Column) -> Column:
    """A step of a pointer, with its escapes."""
    return F.concat(F.lit("/"), F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def walk(rows: DataFrame, value: str, pointer: str = "pointer", depth: int | None = None, order: str | None = None) -> DataFrame:
    """rows with a variant column replaced by its leaves, one row each, and the pointer to each; order: also its place among the leaves.

    Leaves are scalars and empty containers. Without depth, levels are walked until no container is left, which is looked for at each.
    """
    place = order or "_place"
    kept = [c for c in rows.columns if c != value]
    out = rows.select(*kept, F.col(value), F.lit("").alias(pointer), F.array().cast("array<int>").alias(place))
    spark = rows.sparkSession
    for _ in range(depth or DEEPEST):
        if depth is None and out.filter(kind(F.col(value)).isin("object", "array") & ~F.to_json(value).isin("{}", "[]")).isEmpty():
            break
        parts = out.lateralJoin(spark.tvf.variant_explode_outer(F.col(value).outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_part")))
        inner = F.col("_pos").isNotNull()
        out = parts.select(
            *kept, F.when(inner, F.col("_part")).otherwise(F.col(value)).alias(value),
            F.when(inner, F.concat(F.col(pointer), _token(F.coalesce("_key", F.col("_pos").cast("string"))))).otherwise(F.col(pointer)).alias(pointer),
            F.when(inner, F.array_append(place, F.col("_pos"))).otherwise(F.col(place)).alias(place),
        )
    else:
        if depth is None:
            raise ValueError(f"values of more than {DEEPEST} levels")
    return out if order else out.drop(place)


def under(pointer: Column, given: str) -> Column:
    """Whether a place lies at or below a pointer, taken from any level of the value."""
    return F.contains(F.concat(pointer, F.lit("/")), F.lit(given.rstrip("/") + "/"))


def pointed(value: Column, pointer: str) -> Column:
    """The variant at a pointer; a number steps into arrays as well as objects."""
    for token in pointer.split("/")[1:]:
        key = token.replace("~1", "/").replace("~0", "~")
        value = F.coalesce(at(value, key), at(value, int(key))) if key.isdecimal() else at(value, key)
    return value


def metadata(value: Column, given: Mapping[str, str], omit: Sequence[str] = ()) -> Column:
    """A map of texts at pointers of the whole value. What is no pointer (no leading slash) is ignored, as are keys in omit, or all if it has a star."""
    own = {k: p for k, p in given.items() if p.startswith("/") and k not in omit and "*" not in omit}
    if not own:
        return F.create_map().cast("map<string,string>")
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.try_variant_get(pointed(value, p), "$", "string").alias("v")) for k, p in own.items()))
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))


def json_strings(raw: DataFrame, column: str, pointers: Sequence[str] = (), given: Mapping[str, str] | None = None, omit: Sequence[str] = (), depth: int | None = None) -> DataFrame:
    """raw without column, with pointer, text and metadata: a document for each string at or below one of the pointers, or, without pointers, for every string.

    What is no JSON gives no documents; numbers, booleans, nulls and empty strings are none.
    """
    value, place = "_value", "_place"
    parsed = raw.withColumn(value, F.try_parse_json(column)).drop(column).filter(F.col(value).isNotNull())
    marked = parsed.withColumn("metadata", metadata(F.col(value), given or {}, omit))
    leaves = walk(marked, value, "pointer", depth, place).filter(kind(F.col(value)) == "string")
    wanted = [p for p in pointers if p.startswith("/")]
    if pointers:
        found = F.lit(False)
        for p in wanted:
            found = found | under(F.col("pointer"), p)
        leaves = leaves.filter(found)
    return leaves.withColumn("text", F.try_variant_get(value, "$", "string")).filter("text <> ''").drop(value, place)


def json_objects(raw: DataFrame, column: str, given: Mapping[str, str] | None = None, omit: Sequence[str] = ()) -> DataFrame:
    """raw without column, with number, text and metadata: a document for each object of an array, or for the object that the value is.

    The text is the object as JSON with its keys in order; metadata are looked up in the object itself.
    """
    value = "_value"
    parsed = raw.withColumn(value, F.try_parse_json(column)).drop(column)
    elements = F.when(kind(F.col(value)) == "array", F.try_variant_get(value, "$", "array<variant>")).when(kind(F.col(value)) == "object", F.array(value))
    each = parsed.withColumn("_elements", elements).select(*(c for c in parsed.columns if c != value), F.posexplode("_elements").alias("number", value)).filter(kind(F.col(value)) == "object")
    return each.withColumns({"text": F.to_json(value), "metadata": metadata(F.col(value), given or {}, omit)}).drop(value)
