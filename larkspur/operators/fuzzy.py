"""All pairs of similar short texts, by a join of sets of trigrams with a prefix filter.

Equal texts are one class with a number of copies. A class's trigrams are ordered from the rarest to the most frequent; two sets of a Jaccard similarity of at least the threshold
share one among the first of each (as many as the size less the least overlap, and one), and their sizes differ by the threshold at most. Only classes that share such a
trigram are compared; a frequent trigram stands in few beginnings, which is what keeps the join small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import trigrams

_SLACK = 1e-9


def classes(rows: DataFrame, text: str) -> DataFrame:
    """(class, grams, size, copies): the distinct texts with their trigrams; null texts are in none."""
    distinct = rows.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("class")).agg(F.count(F.lit(1)).alias("copies"))
    return distinct.withColumn("grams", trigrams(F.col("class"))).withColumn("size", F.size("grams"))


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(gram, class, size): the rarest trigrams of each class, of which two similar classes share one."""
    each = sets.select("class", "size", F.explode("grams").alias("gram"))
    frequency = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(frequency, "gram").groupBy("class", "size").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    length = F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - _SLACK).cast("int") + 1
    return ordered.select("class", "size", F.explode(F.slice("grams", F.lit(1), length)).alias("g")).select("class", "size", F.col("g.gram").alias("gram"))


def similar(rows: DataFrame, text: str, threshold: float) -> DataFrame:
    """(a, b, similarity): pairs of distinct texts, a before b, whose trigrams have at least this Jaccard similarity."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    sets = classes(rows, text)
    start = prefixes(sets, threshold)
    x, y = start.select(F.col("class").alias("a"), F.col("size").alias("n"), "gram"), start.select(F.col("class").alias("b"), F.col("size").alias("m"), "gram")
    near = x.join(y, "gram").filter((F.col("a") < F.col("b")) & (F.least("n", "m") >= F.greatest("n", "m") * F.lit(threshold) - _SLACK)).select("a", "b").distinct()
    both = near.join(sets.select(F.col("class").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("grams").alias("y")), "b")
    found = both.select("a", "b", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("similarity"))
    return found.filter(F.col("similarity") >= threshold - _SLACK)


def link_counts(rows: DataFrame, text: str, threshold: float) -> DataFrame:
    """(class, copies, n_links): each distinct text, how often it stands, and how many other rows are similar to one of its rows, copies among them."""
    sets = classes(rows, text).select("class", "copies")
    pairs = similar(rows, text, threshold).select("a", "b")
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sets.select(F.col("class").alias("b"), "copies"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("copies").alias("others"))
    return sets.join(others, "class", "left").select("class", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
