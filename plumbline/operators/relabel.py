"""Findings carried along reused versions under the names that things have by then."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources import lineage


def _doubled(step: DataFrame, far: int) -> DataFrame:
    """(project, at, node, to) over twice as many versions, from what is renamed over ``far``: a node without a row keeps its name."""
    on = step.select("project", (F.col("at") - far).alias("at"), F.col("node").alias("to"), F.col("to").alias("then"))
    first = step.join(on, ["project", "at", "to"], "left").select("project", "at", "node", F.coalesce("then", "to").alias("to"))
    later = on.select("project", "at", F.col("to").alias("node"), F.col("then").alias("to")).join(step, ["project", "at", "node"], "left_anti")
    return first.unionByName(later)


def carried(reused: DataFrame, renames: DataFrame, gaps: DataFrame, versions: DataFrame) -> DataFrame:
    """(project, gate_strategy, version, served_version, node, gap, name): what a reused version serves, node by node.

    reused is ``gate.reuse``'s result, renames(project, version, node, new_node) are those of the step to a version, gaps(project,
    version, node, gap) are the findings of each analysed version. ``name`` is what the node is called in the version that
    serves them: renames are composed by doubling the number of versions they span, so a run of n reused versions takes
    log2(n) joins, whatever lies between.
    """
    order = Window.partitionBy("project").orderBy("version")
    placed = lineage.cut(versions.select("project", "version").distinct().withColumn("ord", F.row_number().over(order)))
    served = placed.select("project", F.col("version").alias("served_version"), F.col("ord").alias("at"))
    rows = reused.where("NOT fired AND served_version IS NOT NULL").select("project", "gate_strategy", "version", "served_version")
    rows = rows.join(placed, ["project", "version"]).join(served, ["project", "served_version"])
    rows = rows.join(gaps.withColumnRenamed("version", "served_version"), ["project", "served_version"]).withColumn("name", F.col("node"))
    rows = lineage.cut(rows.withColumn("far", F.col("ord") - F.col("at")))
    most = rows.agg(F.max("far")).first()[0] or 0
    step = renames.join(placed, ["project", "version"]).select("project", (F.col("ord") - 1).alias("at"), "node", F.col("new_node").alias("to"))
    span = 1
    while span <= most:
        step = lineage.cut(step)
        renamed = step.select("project", "at", F.col("node").alias("name"), "to")
        hop = F.col("far").bitwiseAND(span) != 0
        moved = rows.join(renamed, ["project", "at", "name"], "left")
        rows = moved.withColumns({"name": F.when(hop, F.coalesce("to", "name")).otherwise(F.col("name")), "at": F.when(hop, F.col("at") + span).otherwise(F.col("at"))}).drop("to")
        rows = lineage.cut(rows)
        step, span = _doubled(step, span), 2 * span
    return rows.select("project", "gate_strategy", "version", "served_version", "node", "gap", "name")


def relabelled(carried_gaps: DataFrame) -> DataFrame:
    """(project, gate_strategy, version, gaps, relabelled): how many gaps a reused version carries and how many of them under another name."""
    return carried_gaps.groupBy("project", "gate_strategy", "version").agg(F.count("*").alias("gaps"), F.count_if(F.col("node") != F.col("name")).alias("relabelled"))
