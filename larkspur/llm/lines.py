"""Line dedup: windows of three consecutive lines that were seen before are removed.

Every three consecutive lines that aren't blank are hashed as one window, and windows overlap. A window that
stands in several places keeps its first one, by document id and then by position; all lines from the first to
the last line of a later one are covered, covered places are merged, and covered lines go. Whatever goes
still stands at an earlier place, so no line is lost everywhere.

Only hashes and positions are shuffled to find the repeats (counts and first places are combined before the
shuffle); the texts move once, to meet the places of their own document.

Defined cases: a document of one or two lines that aren't blank has them as its only window; blank lines form no window and go
only between covered lines; null and empty texts stay as they are; rows with the same id and text are one
document, and each keeps or loses the same lines; a null id comes before all others; other columns pass through, whatever their
names (but for lines_removed, which is replaced); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import checkpoint, free_names

#: Lines of a window.
WINDOW = 3


def _windows(own: str) -> Column:
    """Windows of the lines in column own: an array of structs (at, line)."""
    n = F.size(own)

    def window(i: Column) -> Column:
        lines = [F.get(own, i + k)["line"] for k in range(WINDOW)]
        return F.struct(
            F.get(own, i)["at"].alias("first"),
            F.get(own, F.least(i + F.lit(WINDOW - 1), n - 1))["at"].alias("last"),
            F.xxhash64(*lines).alias("h1"),
            F.xxhash64(F.lit(WINDOW), *reversed(lines)).alias("h2"),
        )

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), window))


def later_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _text_hash, spans): the first and last line of each repeated window's later places, for documents that have any."""
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    own = docs.select(
        F.col(key).alias("_id"), F.xxhash64(text).alias("_text_hash"), F.filter(lines, lambda x: F.trim(x["line"]) != "").alias("_own")
    )
    windows = own.select("_id", "_text_hash", F.explode(_windows("_own")).alias("w")).select("_id", "_text_hash", "w.*")
    place = F.struct("_id", "_text_hash", "first")
    repeated = windows.groupBy("h1", "h2").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("places")).filter("places > 1").drop("places")
    repeated = checkpoint(repeated)  # so that adaptive execution can split the places of a very common window
    later = windows.join(repeated, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("earliest")))
    return later.groupBy("_id", "_text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with later repeats of three-line windows removed from the text, and the number of lines removed in lines_removed."""
    digest, spans, lines, kept, id_ = free_names(docs, "text_hash", "spans", "lines", "kept", "id")
    found = later_windows(docs, key, text).select(F.col("_id").alias(id_), F.col("_text_hash").alias(f"{digest}_"), F.col("spans").alias(spans))
    columns = [c for c in docs.columns if c != "lines_removed"]
    keyed = docs.select(*columns, F.xxhash64(text).alias(digest))
    joined = keyed.join(found, F.col(key).eqNullSafe(F.col(id_)) & (F.col(digest) == F.col(f"{digest}_")), "left")
    covered = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"]))))
    out = joined.withColumn(lines, F.when(F.col(spans).isNotNull(), F.split(text, "\n", -1))).withColumn(kept, F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered))
    cleaned = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    removed = F.when(F.col(spans).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept))
    return out.select(*(F.when(F.col(spans).isNull(), F.col(c)).otherwise(cleaned).alias(c) if c == text else F.col(c) for c in columns), removed.alias("lines_removed"))


#: The same rows in DuckDB's SQL, from a table of (doc_id, text).
ORACLE = """
WITH docs AS (SELECT doc_id, text FROM documents),
lines AS (
  SELECT doc_id, text, unnest(range(len(l))) AS "at", unnest(l) AS line
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM (SELECT DISTINCT doc_id, text FROM docs WHERE text IS NOT NULL))
),
own AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY "at") AS i, count(*) OVER (PARTITION BY doc_id, text) AS n
  FROM lines WHERE trim(line) <> ''
),
win AS (
  SELECT doc_id, text, i, n, "at" AS first,
         coalesce(lead("at", 2) OVER (PARTITION BY doc_id, text ORDER BY "at"), lead("at", 1) OVER (PARTITION BY doc_id, text ORDER BY "at"), "at") AS last,
         [line, lead(line, 1) OVER (PARTITION BY doc_id, text ORDER BY "at"), lead(line, 2) OVER (PARTITION BY doc_id, text ORDER BY "at")] AS content
  FROM own
),
placed AS (SELECT * FROM win WHERE i <= greatest(n - 2, 1)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id NULLS FIRST, first) AS r FROM placed),
covered AS (SELECT DISTINCT doc_id, text, unnest(range(first, last + 1)) AS "at" FROM ranked WHERE r > 1),
kept AS (
  SELECT l.doc_id, l.text, string_agg(l.line, chr(10) ORDER BY l."at") AS cleaned, count(*) AS n
  FROM lines l LEFT JOIN covered c ON l.doc_id IS NOT DISTINCT FROM c.doc_id AND l.text = c.text AND l."at" = c."at"
  WHERE c."at" IS NULL GROUP BY ALL
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.cleaned, '') END AS text,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(k.n, 0) END AS INTEGER) AS lines_removed
FROM docs d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text = k.text
"""
