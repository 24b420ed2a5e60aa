"""Filters on JSON metadata by containment, and tables whose much-filtered keys are columns of their own."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.variants import Json, at, contains, kind

#: The kinds of JSON value that a column of a type holds.
_KINDS = {"string": (str,), "bigint": (int,), "double": (int, float), "boolean": (bool,)}
PREFIX = "meta_"


def holds(metadata: Column, wanted: Mapping[str, Json], also: Mapping[str, Json] | None = None, absent: str | None = None) -> Column:
    """Metadata contain wanted and do not have the key absent (a null there is there), or they contain also. Text of metadata is parsed."""
    first = contains(metadata, wanted)
    if absent is not None:
        first = first & at(metadata, absent).isNull()
    return first if also is None else first | contains(metadata, also)


def shredded(chunks: DataFrame, metadata: str, keys: Mapping[str, str]) -> DataFrame:
    """chunks with a column for each of keys (name: string, bigint, double or boolean) that metadata (JSON text) has with a value of that kind."""
    value = F.try_parse_json(metadata)
    kinds = {"string": "string", "bigint": "number", "double": "number", "boolean": "boolean"}
    own = {PREFIX + k: F.when(kind(at(value, k)) == kinds[t], F.try_variant_get(at(value, k), "$", t)) for k, t in keys.items()}
    return chunks.withColumns(own)


def filtered(chunks: DataFrame, metadata: str, wanted: Mapping[str, Json], keys: Mapping[str, str], also: Mapping[str, Json] | None = None, absent: str | None = None) -> DataFrame:
    """The rows of a shredded table whose metadata hold what is wanted.

    Top keys that are columns are compared as columns first, so that the scan skips row groups by their statistics; the whole condition follows on
    the rows that are left. Keys whose wanted value is not of the column's kind, and alternatives, are left to the whole condition.
    """
    out = chunks
    for k, v in wanted.items() if also is None else ():
        if k in keys and isinstance(v, _KINDS[keys[k]]) and not (isinstance(v, bool) and keys[k] != "boolean"):
            out = out.filter(F.col("`" + (PREFIX + k).replace("`", "``") + "`") == F.lit(v))
    return out.filter(holds(F.try_parse_json(metadata), wanted, also, absent))


def which(chunks: DataFrame, metadata: str, filters: Mapping[str, tuple[Mapping[str, Json], Mapping[str, Json] | None, str | None]], into: str = "filter") -> DataFrame:
    """chunks with into: a row for each of filters (name: wanted, also, absent) that its metadata hold; the metadata are read and parsed once for all of them."""
    parsed = chunks.withColumn("_value", F.try_parse_json(metadata))
    names = F.array(*(F.when(holds(F.col("_value"), wanted, also, absent), F.lit(name)) for name, (wanted, also, absent) in filters.items()))
    return parsed.select(*chunks.columns, F.explode(F.array_compact(names)).alias(into))
