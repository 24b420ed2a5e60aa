"""Text functions: cleaning, redaction, truncation, fences, keys, MIME types and handles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"
LONGEST_ERROR, LONGEST_FREE_TEXT, LONGEST_DESCRIPTION, LONGEST_KEY = 2048, 2000, 500, 1024

#: What counts as a secret in an error text, most specific first.
SECRET_PATTERNS = [
    r"AKIA[0-9A-Z]{16}",
    r"(?i)(aws[_-]?secret[_-]?access[_-]?key|secretAccessKey)[\"'\s:=]+[A-Za-z0-9/+=]{40}",
    r"(?i)X-Amz-Signature=[0-9a-f]{64}",
    r"(?i)X-Amz-Security-Token=[^&\s\"']+",
    r"(?i)X-Amz-Credential=[^&\s\"']+",
    r"sk-ant-[A-Za-z0-9_-]{20,}",
    r"sk-[A-Za-z0-9]{20,}",
    r"Bearer\s+[A-Za-z0-9._~+/=-]+",
    r"Basic\s+[A-Za-z0-9+/=]+",
    r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    r"(?i)postgres(?:ql)?:\/\/[^:/?\s]+:[^@/\s]+@",
]
#: MIME types by the last part of a key.
MIME_TYPES = {"png": "image/png", "gif": "image/gif", "webp": "image/webp", "jpg": "image/jpeg", "jpeg": "image/jpeg"}


def effective_query(query: Column, description: Column) -> Column:
    """Both, joined by a space, or the one that there is."""
    return F.when(query.isNotNull() | description.isNotNull(), F.concat_ws(" ", query, description))


def augmented(content: Column, description: Column, label: str) -> Column:
    return F.when(description.isNull(), content).otherwise(F.concat(content, F.lit(f"\n\n{label}: "), description))


def strip_fence(text: Column, tag: str = "(?:json)?") -> Column:
    """The inside of a fenced block that is the whole text, else the trimmed text."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    fenced = r"(?s)^```" + tag + r"\s*\n?(.*?)\n?```$"
    inside = F.regexp_replace(F.regexp_extract(trimmed, fenced, 1), r"^\s+|\s+$", "")
    return F.when(trimmed.rlike(fenced), inside).otherwise(trimmed)


def strip_any_fence(text: Column) -> Column:
    return strip_fence(text, "(?:[a-z]+)?")


def sanitize(text: Column) -> Column:
    """Without control characters, then without tags, then cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f]", ""), r"<[^>]*>", ""), 1, LONGEST_FREE_TEXT)


#: Every match of a pattern contains one of these; a text without any is not searched.
_MARKS = r"AKIA|(?i:secret)|(?i:x-amz-)|sk-|Bearer|Basic|eyJ|(?i:postgres)"


def redact(text: Column) -> Column:
    out = text
    for pattern in SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, REDACTED)
    return F.when(text.rlike(_MARKS), out).otherwise(text)


def cut_error(text: Column) -> Column:
    return F.when(F.length(text) > LONGEST_ERROR, F.concat(F.substring(text, 1, LONGEST_ERROR - 3), F.lit("..."))).otherwise(text)


def cut_description(text: Column) -> Column:
    return F.when(F.length(text) > LONGEST_DESCRIPTION, F.concat(F.regexp_replace(F.substring(text, 1, LONGEST_DESCRIPTION), r"\s+$", ""), F.lit("…"))).otherwise(text)


def valid_key(key: Column) -> Column:
    """An object key: 1 to 1024 characters of a small set, no leading slash or dot, and no part that is two dots."""
    return F.coalesce(F.length(key).between(1, LONGEST_KEY) & ~key.rlike(r"^[/.]") & key.rlike(r"^[a-zA-Z0-9/_.-]+$") & ~F.array_contains(F.split(key, "/"), ".."), F.lit(False))


def valid_keys(keys: Column) -> Column:
    """The valid ones, in order; null gives none."""
    return F.filter(F.coalesce(keys, F.array().cast("array<string>")), valid_key)


def mime_of(key: Column) -> Column:
    last = F.lower(F.element_at(F.split(key, r"\."), -1))
    out = F.lit("image/jpeg")
    for ending, mime in MIME_TYPES.items():
        out = F.when(last == ending, mime).otherwise(out)
    return out


def data_uri(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def decoded_size(encoded: Column) -> Column:
    """Bytes of a base64 text; null if it isn't one."""
    return F.octet_length(F.try_to_binary(encoded, F.lit("base64")))


def split_list(text: Column, separator: str) -> Column:
    """Parts between separators, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def mask(text: Column) -> Column:
    return F.when(F.length(text) <= 4, text).otherwise(F.right(text, F.lit(4)))


def output_handle(node: Column, name: Column, kind: Column) -> Column:
    return F.concat_ws("-", node, F.lit("output"), name, kind)


def input_handle(node: Column, name: Column, kind: Column) -> Column:
    return F.concat_ws("-", node, F.lit("input"), name, kind)


def trigrams(text: Column) -> Column:
    """The set of three-character parts of the lower-cased text, padded by two spaces before and one after."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
