"""Tokens, costs and days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a token, and dollars for a million tokens and for an image.
CHARS_PER_TOKEN, USD_PER_MILLION_TOKENS, USD_PER_IMAGE = 3, 0.02, 0.007


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("bigint")


def embedding_cost(tokens: Column) -> Column:
    return tokens / 1e6 * USD_PER_MILLION_TOKENS


def image_cost(images: Column) -> Column:
    return images * USD_PER_IMAGE


def round4(x: Column) -> Column:
    return F.round(x, 4)


def utc_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def next_midnight(ts: Column) -> Column:
    return F.date_trunc("day", ts) + F.expr("INTERVAL 1 DAY")


def alive(written: Column, seconds: int, now: Column) -> Column:
    """True until a cached row's time is over."""
    return written + F.make_dt_interval(secs=F.lit(seconds)) > now


def money(x: Column) -> Column:
    """Exact sums do not depend on the order of rows."""
    return x.cast("decimal(18,8)")
