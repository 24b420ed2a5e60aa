"""Running a flow up to its stop nodes: what leads to them, in what order, and what keeps a flow from running.

All rounds are joins of edges with a frontier, over all flows and stop nodes of the tables at once; there are as many as the longest way has edges. A node with very many
edges is a skewed key of a join, which adaptive execution splits, or of an aggregate with partial sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import checkpoint

#: Nodes of a way, at most.
DEEPEST = 1000


def ancestors(links: DataFrame, stops: DataFrame) -> DataFrame:
    """(stop, node, distance): every node that leads to a stop node (id), the stop itself among them, with the fewest edges between. Links: source, target."""
    edges = checkpoint(links.select("source", "target").filter("source is not null and target is not null").distinct())
    frontier = checkpoint(stops.select(F.col("id").alias("stop"), F.col("id").alias("node"), F.lit(0).alias("distance")).filter("node is not null").distinct())
    found = [frontier]
    for n in range(1, DEEPEST):
        seen = reduce(DataFrame.unionAll, found).select("stop", "node")
        new = frontier.select("stop", F.col("node").alias("target")).join(edges, "target").select("stop", F.col("source").alias("node")).distinct()
        frontier = checkpoint(new.join(seen, ["stop", "node"], "left_anti").withColumn("distance", F.lit(n)))
        if frontier.isEmpty():
            return reduce(DataFrame.unionAll, found)
        found.append(frontier)
    raise ValueError(f"a way of more than {DEEPEST} nodes")


def levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, level): 0 for nodes that nothing leads to, else one more than the highest level of what leads to them; null for nodes on a cycle or behind one.

    In each round the nodes whose last predecessor has got its level get theirs.
    """
    own = checkpoint(nodes.select("id").distinct())
    inside = links.select("source", "target").distinct().join(own.select(F.col("id").alias("source")), "source", "left_semi").join(own.select(F.col("id").alias("target")), "target", "left_semi")
    edges = checkpoint(inside.select("source", "target"))
    waiting = checkpoint(edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("missing")))
    frontier = checkpoint(own.join(waiting, "id", "left_anti").withColumn("level", F.lit(0)))
    found = [frontier]
    for n in range(1, DEEPEST):
        reached = frontier.select(F.col("id").alias("source")).join(edges, "source").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        waiting = checkpoint(waiting.join(reached, "id", "left").select("id", (F.col("missing") - F.coalesce("n", F.lit(0))).alias("missing")))
        frontier = checkpoint(waiting.filter("missing = 0").select("id", F.lit(n).alias("level")))
        waiting = waiting.filter("missing > 0")
        if frontier.isEmpty():
            done = reduce(DataFrame.unionAll, found)
            return own.join(done, "id", "left")
        found.append(frontier)
    raise ValueError(f"a way of more than {DEEPEST} nodes")


def cycles(nodes: DataFrame, links: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """(id): the nodes on cycles or between two. What has no level forwards and none backwards is on one. placed: the levels, if they are known."""
    ahead = checkpoint((levels(nodes, links) if placed is None else placed).filter("level is null").select("id"))
    if ahead.isEmpty():
        return ahead
    rest = links.join(ahead.select(F.col("id").alias("source")), "source", "left_semi").join(ahead.select(F.col("id").alias("target")), "target", "left_semi")
    return levels(ahead, rest.select(F.col("target").alias("source"), F.col("source").alias("target"))).filter("level is null").select("id")


def run_order(nodes: DataFrame, links: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What runs for each stop node, (stop, id, level, distance), in order of level; and problems (stop, id, problem).

    Nodes on a cycle do not run, nor do those behind one; a stop that is no node is a problem as well.
    """
    up = checkpoint(ancestors(links, stops))
    known = nodes.select("id").distinct()
    involved = checkpoint(up.select(F.col("node").alias("id")).distinct())
    inside = links.join(involved.select(F.col("id").alias("target")), "target", "left_semi")
    placed = checkpoint(levels(involved, inside))
    looped = checkpoint(cycles(involved, inside, placed))
    run = up.select("stop", F.col("node").alias("id"), "distance").join(placed.filter("level is not null"), "id").join(known, "id", "left_semi").select("stop", "id", "level", "distance")
    at = up.select("stop", F.col("node").alias("id"))
    missing = at.join(known, "id", "left_anti").select("stop", "id", F.lit("no node").alias("problem"))
    circular = at.join(looped, "id").select("stop", "id", F.lit("cycle").alias("problem"))
    behind = at.join(placed.filter("level is null").select("id"), "id").join(looped, "id", "left_anti").select("stop", "id", F.lit("behind a cycle").alias("problem"))
    return run, missing.unionByName(circular).unionByName(behind)
