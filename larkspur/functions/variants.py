"""JSON values of any shape: what kind they are, and whether one contains another."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Json = str | int | float | bool | None | list | Mapping


def at(value: Column, *keys: str | int) -> Column:
    """What stands at a place of a variant: null if nothing does, a variant null if a null does. A key with a dot is one step."""
    for key in keys:
        if isinstance(key, int):
            value = F.try_variant_get(value, f"$[{key}]", "variant")
        elif key and "'" not in key:
            value = F.try_variant_get(value, f"$['{key}']", "variant")
        else:  # paths have no escapes
            value = F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(key))
    return value


def kind(value: Column) -> Column:
    """object, array, string, number, boolean or null; null for no value at all."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null")
        .when(schema.isNotNull(), "number")
    )


def contains(value: Column, wanted: Json) -> Column:
    """Whether a variant contains wanted, never null.

    An object contains one with some of its keys, whose values it contains in turn; an array contains one each of whose elements some element
    of it contains, in any order and number, and, at the top only, a scalar that is one of its elements; scalars must be equal and of one kind, so the
    number 7 is not the text 7, and null is contained only where a null stands.
    """
    return F.coalesce(_contains(value, wanted) | _element(value, wanted) if _scalar(wanted) else _contains(value, wanted), F.lit(False))


def _scalar(wanted: Json) -> bool:
    return not isinstance(wanted, (list, tuple, Mapping))


def _element(value: Column, wanted: Json) -> Column:
    """Whether value is an array, one of whose elements contains wanted."""
    return F.coalesce((kind(value) == "array") & F.exists(F.try_variant_get(value, "$", "array<variant>"), lambda x: _contains(x, wanted)), F.lit(False))


def _contains(value: Column, wanted: Json) -> Column:
    own = kind(value)
    if isinstance(wanted, Mapping):
        out = own == "object"
        for k, v in wanted.items():
            out = out & _contains(at(value, k), v)
    elif isinstance(wanted, (list, tuple)):
        out = own == "array"
        for w in wanted:
            out = out & _element(value, w)
    elif wanted is None:
        out = own == "null"
    elif isinstance(wanted, bool):
        out = (own == "boolean") & (F.try_variant_get(value, "$", "boolean") == wanted)
    elif isinstance(wanted, (int, float)):
        # whole numbers keep all their digits
        out = (own == "number") & (F.try_variant_get(value, "$", "double") == float(wanted))
        if isinstance(wanted, int):
            out = out & (F.try_variant_get(value, "$", "decimal(38,0)") == F.lit(str(wanted)).cast("decimal(38,0)"))
    elif isinstance(wanted, str):
        out = (own == "string") & (F.try_variant_get(value, "$", "string") == wanted)
    else:
        raise TypeError(f"not a JSON value: {wanted!r}")
    return F.coalesce(out, F.lit(False))
