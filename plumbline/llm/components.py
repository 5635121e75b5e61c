"""Connected components of edge tables by repeated contraction; nothing is gathered on the driver.

In a round every node takes the neighbour of the lowest rank below its own as its parent, parents are followed to
the top, and edges go on between tops. Ranks are the ids at first and hashes of them later, other ones in each round, so half of the
nodes, on average, go in a round whatever the shape. Nothing is grouped but by partial aggregation, so a
node with very many neighbours is no hot key.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.saved import saved

#: Rows of a lookup that are sent to every executor (by count; more are joined by shuffle).
SENT = 1_000_000


def _told(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SENT else table


def _mapped(edges: DataFrame, parents: DataFrame | None) -> DataFrame:
    """Edges between the parents of their ends, without loops and repeats."""
    if parents is not None:
        for end in ("u", "v"):
            up = parents.select(F.col("node").alias(end), F.col("root").alias("up"))
            edges = edges.join(up, end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def merged(named: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Until no edge is left (in each round the highest node of a component goes, at least): (node, root) of all nodes in edges(u, v), a saved table, or named(node, root), the components found before; others are their own roots."""
    tops = []
    n = edges.count()
    now = saved(_mapped(edges, None if named is None else _told(named)), n)
    for number in count():
        if not (n := now.count()):
            break
        rank = lambda c: F.xxhash64(c, F.lit(number)) if number else F.col(c)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("rank"), F.col("v").alias("root"))).alias("low"))
        parents = saved(low.where(F.col("low.rank") < rank("u")).select(F.col("u").alias("node"), F.col("low.root").alias("root")), n)
        while True:  # up three steps at a time
            up = _told(parents)
            far = parents
            for step in ("one", "two"):
                far = far.join(up.select(F.col("node").alias("root"), F.col("root").alias(step)), "root", "left").withColumn("root", F.coalesce(step, "root"))
            parents = saved(far.select("node", "root", F.col("two").isNotNull().alias("moved")))
            if parents.where("moved").isEmpty():
                break
        parents = parents.select("node", "root")
        tops.append(parents)
        now = saved(_mapped(now, _told(parents)), n)
    for parents in tops:
        if named is None:
            named = parents
            continue
        up = _told(parents).select(F.col("node").alias("root"), F.col("root").alias("up"))
        named = named.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")).unionByName(parents)
    return saved(named) if named is not None else now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges(u, v); a node is also given with itself where it is the root."""
    named = merged(None, saved(edges))
    return named.unionByName(named.select(F.col("root").alias("node"), "root").distinct())
