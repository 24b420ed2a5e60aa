"""Addresses and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Groups of an IPv6 address, and those of them that requests are counted by.
GROUPS, COUNTED = 8, 4


def is_ipv4(text: Column) -> Column:
    """Four decimal numbers from 0 to 255, without leading zeros."""
    numbers = F.split(text, r"\.")
    fits = lambda n: n.rlike("^(0|[1-9][0-9]{0,2})$") & (F.coalesce(n.try_cast("int"), F.lit(999)) < 256)
    return F.coalesce((F.size(numbers) == 4) & F.forall(numbers, fits), F.lit(False))


def _ipv6_bucket(ip: Column) -> Column:
    """The first groups of an address. Where it is shortened, a group's place is counted from the end that it is written at."""
    written = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))
    halves = F.split(ip, "::")
    left, right = written(F.get(halves, F.lit(0))), written(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    from_end = F.lit(GROUPS) - F.size(right)
    shortened = F.size(halves) > 1

    def group(i: Column) -> Column:
        tail = F.get(right, (i - from_end).cast("int"))
        return F.when(i < F.size(left), F.get(left, i)).when(shortened, F.when(i < from_end, "0").otherwise(tail)).otherwise("")

    # groups that are too many leave no place for the shortened ones, unless the counted ones all stand before them
    fits = ~shortened | (F.size(left) >= COUNTED) | (F.size(left) + F.size(right) <= GROUPS)
    first = F.transform(F.array(*(F.lit(i) for i in range(COUNTED))), group)
    return F.when(fits & F.forall(first, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$")), F.array_join(first, ":")).otherwise(UNKNOWN)


def ip_bucket(ip: Column) -> Column:
    """What requests are counted by: the IPv4 address (also of a mapped one), the first four groups of IPv6, or unknown."""
    mapped = F.regexp_extract(ip, r"(?i)^::ffff:([0-9.]+)$", 1)
    four = F.when(mapped != "", mapped).when(~F.contains(ip, F.lit(":")), ip)
    return F.when(F.coalesce(ip, F.lit("")) == "", UNKNOWN).when(four.isNotNull(), F.when(is_ipv4(four), four).otherwise(UNKNOWN)).otherwise(_ipv6_bucket(ip))


def valid_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[a-zA-Z0-9_-]{1,64}$"), F.lit(False))


def uuid4(text: Column) -> Column:
    """The lower-cased text if it is a UUID of version 4, else null."""
    return F.when(text.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lower(text))
