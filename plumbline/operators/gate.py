"""The gate: does a version need to be analysed again, under each policy, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("always", "content", "structural", "isomorphism")


def decide(snapshots: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """(project, version, gate_strategy, fired, reason) for every version and policy, against the version saved before it.

    snapshots(project, version, text_hash, structure_hash[, design_hash, delta_size, isomorphic]). In this order: no
    version before fires; a changed design fires; always fires; content compares text hashes;
    isomorphism fires on a changed structure unless the shapes are proved alike; all else is structural. The
    structure has changed when its hash differs or the delta is not empty.
    """
    order = Window.partitionBy("project").orderBy("version")
    have = snapshots.columns
    design = F.col("design_hash") if "design_hash" in have else F.lit("")
    delta = F.coalesce(F.col("delta_size"), F.lit(0)) if "delta_size" in have else F.lit(0)
    alike = F.coalesce(F.col("isomorphic"), F.lit(False)) if "isomorphic" in have else F.lit(False)
    rows = snapshots.withColumns(
        {
            "has_before": F.lag(F.lit(True)).over(order).isNotNull(),
            "design_moved": ~F.lag(design).over(order).eqNullSafe(design),
            "text_moved": ~F.lag("text_hash").over(order).eqNullSafe(F.col("text_hash")),
            "structure_moved": ~F.lag("structure_hash").over(order).eqNullSafe(F.col("structure_hash")) | (delta > 0),
            "alike": alike,
        }
    )
    rows = rows.withColumn("gate_strategy", F.explode(F.array(*map(F.lit, strategies))))
    gate = F.col("gate_strategy")
    reason = (
        F.when(~F.col("has_before"), "first version")
        .when(F.col("design_moved"), "design changed")
        .when(gate == "always", "always")
        .when(gate == "content", F.when(F.col("text_moved"), "content changed").otherwise("content unchanged"))
        .when(~F.col("structure_moved"), "structure unchanged")
        .when((gate == "isomorphism") & F.col("alike"), "same shape")
        .otherwise("structure changed")
    )
    out = rows.withColumn("reason", reason)
    return out.select("project", "version", "gate_strategy", (~F.col("reason").isin("content unchanged", "structure unchanged", "same shape")).alias("fired"), "reason")


def reuse(decisions: DataFrame) -> DataFrame:
    """The version each decision serves: its own if fired, else the latest one that did, and the version it was reused from."""
    order = Window.partitionBy("project", "gate_strategy").orderBy("version")
    served = F.last(F.when(F.col("fired"), F.col("version")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return decisions.withColumns({"served_version": served, "reused_from": F.when(~F.col("fired"), F.lag("version").over(order))})


def keep_newest(versions: DataFrame, most: int = 3) -> DataFrame:
    """The newest ``most`` versions per project."""
    place = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("version")))
    return versions.withColumn("place", place).where(F.col("place") <= most).drop("place")


def roll_up(files: DataFrame, *keys: str) -> DataFrame:
    """One hash per snapshot over its (path, hash) pairs, whatever the order of rows.

    Pairs are sorted and hashed in 4096 classes by the hash of their path, then the classes in order, so no task holds
    all files of a snapshot. Null paths are empty.
    """
    rows = files.withColumn("part", F.substring(F.sha2(F.coalesce("path", F.lit("")), 256), 1, 3))
    parts = rows.groupBy(*keys, "part").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("path", "hash")))), 256).alias("digest"))
    whole = F.to_json(F.array_sort(F.collect_list(F.struct("part", "digest"))))
    return parts.groupBy(*keys).agg(F.sha2(whole, 256).alias("tree_hash"))


def touched(trees: DataFrame) -> DataFrame:
    """Whether a snapshot's tree differs from the one before; NULL for the first."""
    before = F.lag("tree_hash").over(Window.partitionBy("project").orderBy("version"))
    return trees.withColumn("source_touched", F.when(before.isNotNull(), before != F.col("tree_hash")))
