"""Runs of versions over which a key, a node or an edge, stays as it is, and what follows from them: intervals, steps and sizes of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import graph
from plumbline.sources import lineage

KEYS = ("project", "version")
NODE, EDGE = ("node",), ("src", "dst")


def digest(*columns: str) -> Column:
    """A value that is equal just for equal columns, NULLs included."""
    return F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def _runs(rows: DataFrame, versions: DataFrame, key: tuple[str, ...], kept: tuple[str, ...] = ()) -> DataFrame:
    """(project, key, digest, kept, valid_from, valid_to, version, ord, replaces, replaced): one row a run of versions over which a key keeps its digest.

    ``version`` and ``ord`` are the run's first; it replaces one that ended there, or is replaced where it ends. All of it comes from one shuffle by key and one order.
    """
    order = Window.partitionBy("project").orderBy("version")
    placed = lineage.cut(versions.select(*KEYS).distinct().withColumns({"ord": F.row_number().over(order), "next": F.lead("version").over(order)}))  # its size is known then: a small one is broadcast
    since = F.coalesce("since", "version") if "since" in rows.columns else F.col("version")
    rows = rows.select(*KEYS, *key, "digest", since.alias("since"), *kept).join(placed, list(KEYS))
    line = Window.partitionBy("project", *key).orderBy("ord")
    again = F.lag("ord").over(Window.partitionBy("project", *key).orderBy("ord", "digest")).eqNullSafe(F.col("ord"))
    rows = rows.repartition("project", *key).withColumn("again", again).where("NOT again").drop("again")
    was, follows = F.lag("ord").over(line) == F.col("ord") - 1, F.lead("ord").over(line) == F.col("ord") + 1
    rows = rows.withColumns({"replaces": F.coalesce(was, F.lit(False)), "same": F.lag("digest").over(line).eqNullSafe(F.col("digest")), "replaced": F.coalesce(follows, F.lit(False))})
    starts = ~(F.col("replaces") & F.col("same"))
    rows = rows.withColumns({"starts": starts, "ends": ~F.col("replaced") | F.lead(starts).over(line)}).where("starts OR ends")
    last = {c: F.when(F.col("ends"), F.col(c)).otherwise(F.lead(c).over(line)) for c in ("next", "replaced", *kept)}  # a run's last row is itself or the one after it
    rows = rows.withColumns(last).where("starts")
    return rows.select("project", *key, "digest", *kept, F.col("since").alias("valid_from"), F.col("next").alias("valid_to"), "version", "ord", "replaces", "replaced")


def intervals(rows: DataFrame, versions: DataFrame, *key: str) -> DataFrame:
    """(project, key, digest, valid_from, valid_to) of rows(project, version, key, digest[, since]).

    ``versions`` lists every version of a project, empty ones too. ``since`` is what a row that goes on from an earlier interval is valid from.
    """
    return _runs(rows, versions, key).select("project", *key, "digest", "valid_from", "valid_to")


def _since(table: DataFrame) -> tuple[str, ...]:
    return ("since",) if "since" in table.columns else ()


def node_runs(nodes: DataFrame, versions: DataFrame, tracked: tuple[str, ...] = graph.TRACKED, kept: tuple[str, ...] = ()) -> DataFrame:
    return _runs(nodes.select(*KEYS, "node", digest(*graph.tracked_in(nodes, tracked)).alias("digest"), *kept, *_since(nodes)), versions, NODE, kept)


def edge_runs(edges: DataFrame, versions: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    return _runs(edges.select(*KEYS, "src", "dst", F.lit(0).cast("bigint").alias("digest"), *kept, *_since(edges)), versions, EDGE, kept)


def steps(runs: DataFrame, *key: str) -> DataFrame:
    """(project, version, key, change) against the version before, from runs: added, removed or changed."""
    here = F.when(F.col("ord") > 1, F.struct("version", F.when(F.col("replaces"), "changed").otherwise("added").alias("change")))
    gone = F.when(F.col("valid_to").isNotNull() & ~F.col("replaced"), F.struct(F.col("valid_to").alias("version"), F.lit("removed").alias("change")))
    return runs.select("project", *key, F.explode(F.array_compact(F.array(here, gone))).alias("step")).select("project", "step.version", *key, "step.change")


def sizes(runs: DataFrame, versions: DataFrame, name: str) -> DataFrame:
    """(project, version, name): how many keys each of ``versions`` has, as a running sum of what begins and ends."""
    ends = F.array_compact(F.array(F.struct("version", F.lit(1).alias("step")), F.when(F.col("valid_to").isNotNull(), F.struct(F.col("valid_to").alias("version"), F.lit(-1).alias("step")))))
    moved = runs.select("project", F.explode(ends).alias("e")).groupBy("project", "e.version").agg(F.sum("e.step").alias("step"))
    total = F.sum("step").over(Window.partitionBy("project").orderBy("version"))  # one row a version
    return versions.select(*KEYS).distinct().join(moved, list(KEYS), "left").select(*KEYS, F.coalesce(total, F.lit(0)).alias(name))


def node_intervals(nodes: DataFrame, versions: DataFrame, tracked: tuple[str, ...] = graph.TRACKED) -> DataFrame:
    return node_runs(nodes, versions, tracked).select("project", "node", "digest", "valid_from", "valid_to")


def edge_intervals(edges: DataFrame, versions: DataFrame) -> DataFrame:
    return edge_runs(edges, versions).select("project", "src", "dst", "digest", "valid_from", "valid_to")
