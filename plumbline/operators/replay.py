"""Runs of the gate over a history: run rows, comparison with a full analysis of every version, labelled deviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import gate, graph
from plumbline.operators import runs as spans
from plumbline.sources import lineage

#: Reasons after which everything counts as affected.
WHOLE = ("first version", "design changed", "always")

DELTAS = ("added_nodes", "removed_nodes", "changed_nodes", "added_edges", "removed_edges")


def impact_sizes(nodes: DataFrame, edges: DataFrame, radius: int, moved: DataFrame, counted: DataFrame) -> DataFrame:
    """(project, version, touched_impact, all_nodes): nodes within ``radius`` steps of what the step to a version touched, and all its nodes, which ``counted`` has."""
    touched = moved.where("change <> 'removed'").select("project", "version", "node")  # nodes of the version, each once
    keys, sized = ["project", "version"], "tokens" in nodes.columns
    near = graph.impact(edges, nodes, touched, radius, known=True)
    near = near.join(nodes.select(*keys, "node", "tokens"), [*keys, "node"]) if sized else near
    amount = lambda name: [F.sum("tokens").alias(name)] if sized else []
    reached = near.groupBy(*keys).agg(F.count("*").alias("touched_impact"), *amount("touched_tokens"))
    whole = counted.join(nodes.groupBy(*keys).agg(*amount("all_tokens")), keys) if sized else counted.where("all_nodes > 0")
    return whole.join(reached, keys, "left").fillna(0, ["touched_impact", *(["touched_tokens"] if sized else [])])


ANALYSIS = ("convergences", "divergences", "absences", "findings_hash", "score", "call_resolution_rate", "ambiguous_calls")


def run_rows(
    snapshots: DataFrame, nodes: DataFrame, edges: DataFrame, settings: dict | None = None, radius: int = 1, strategies: tuple[str, ...] = gate.STRATEGIES, analysis: DataFrame | None = None,
    runs: dict | None = None,
) -> DataFrame:
    """One row per (project, version, gate_strategy): decision, sizes of the delta and of the impact, tokens and settings.

    snapshots(project, version, text_hash, structure_hash[, design_hash, isomorphic, tokens]). A version without one
    before it has all its nodes as added. A reused run has no impact and spends no tokens. ``settings`` become columns.
    Where nodes have ``tokens``, ``counterfactual_prompt_tokens`` is what a run would have sent: nothing if reused, the nodes
    of its impact, or all nodes where everything counts as affected or nothing was touched. ``analysis`` adds those of
    ``ANALYSIS`` that it has, by project and version: reflexion counts, fingerprint, score, call resolution.
    The diff is worked out once, for the delta and for the impact; ``runs`` has ``nodes`` and ``edges`` as runs of versions (``runs.node_runs``) where these are at hand.
    Edges are read twice, and nodes that have tokens three times: give tables, not what is yet to be derived.
    """
    keys = ["project", "version"]
    runs = runs or {"nodes": lineage.cut(spans.node_runs(nodes, snapshots)), "edges": spans.edge_runs(edges, snapshots)}
    moved = spans.steps(runs["nodes"], "node")
    sizes = impact_sizes(nodes, edges, radius, moved, spans.sizes(runs["nodes"], snapshots, "all_nodes"))
    counts = graph.delta_counts(nodes, edges, snapshots, moved, spans.steps(runs["edges"], "src", "dst")).select(*keys, *DELTAS, F.col("edit_distance").alias("delta_size"))
    rows = lineage.cut(snapshots.join(counts, keys, "left").join(sizes, keys, "left"))  # one row a version, read several times
    decided = gate.decide(rows, strategies)
    extra = [F.col("tokens")] if "tokens" in snapshots.columns else [F.lit(None).cast("bigint").alias("tokens")]
    out = decided.join(rows.select(*keys, *DELTAS, "touched_impact", "all_nodes", *extra), keys)
    first = F.col("reason") == "first version"
    affected = F.when(F.col("reason").isin(*WHOLE), F.col("all_nodes")).when(F.col("fired"), F.col("touched_impact")).otherwise(0)
    none = F.lit(0).cast("bigint")
    deltas = [F.when(first, F.col("all_nodes") if c == "added_nodes" else none).otherwise(F.coalesce(c, none)).alias(c) for c in DELTAS]
    fixed = [F.lit(v).alias(k) for k, v in (settings or {}).items()]
    if "all_tokens" in sizes.columns:
        part = F.when(F.col("reason").isin(*WHOLE) | (F.col("touched_impact") == 0), F.col("all_tokens")).otherwise(F.col("touched_tokens"))
        out = out.join(rows.select(*keys, "all_tokens", "touched_tokens"), keys)
        fixed.append(F.when(F.col("fired"), part).otherwise(none).cast("bigint").alias("counterfactual_prompt_tokens"))
    if analysis is not None:
        more = [c for c in ANALYSIS if c in analysis.columns]
        out = out.join(analysis.select(*keys, *more), keys, "left")
        fixed += [F.col(c) for c in more]
    return out.select(
        *keys, "gate_strategy", F.col("fired").alias("gate_allowed_llm"), F.when(F.col("fired"), "invoke").otherwise("reuse").alias("decision"), "reason",
        *deltas, F.coalesce(affected, none).alias("impact_nodes"), F.when(F.col("fired"), F.col("tokens")).otherwise(none).alias("prompt_tokens"), *fixed,
    )


def _differing(a: str, b: str, fields: tuple[str, ...]) -> Column:
    """Names of the fields in which two structs differ, NULL-safe."""
    return F.array_compact(F.array(*(F.when(~F.col(a)[f].eqNullSafe(F.col(b)[f]), F.lit(f)) for f in fields)))


def replay(snapshots: DataFrame, fields: tuple[str, ...], strategies: tuple[str, ...] = gate.STRATEGIES) -> DataFrame:
    """Every version under every policy against the findings (``fields``) of a full analysis of that version.

    A run that fires serves its own findings, any other those of the last run that fired. It diverges where they differ from the
    full analysis, and is a miss if it was reused as well. ``conformance_changed`` and ``source_touched`` compare a
    version with the one before and are NULL for the first, which was not measured.
    """
    keys = ["project", "version"]
    order = Window.partitionBy("project").orderBy("version")
    truth = snapshots.select(*keys, F.struct(*fields).alias("truth"), "text_hash")
    truth = truth.withColumns({"before": F.lag("truth").over(order), "text_before": F.lag("text_hash").over(order), "seen": F.lag(F.lit(True)).over(order)})
    truth = truth.select(
        *keys, "truth",
        F.when(F.col("seen"), F.size(_differing("truth", "before", fields)) > 0).alias("conformance_changed"),
        F.when(F.col("seen"), ~F.col("text_hash").eqNullSafe(F.col("text_before"))).alias("source_touched"),
    )
    rows = gate.decide(snapshots, strategies).join(truth, keys)
    upto = Window.partitionBy("project", "gate_strategy").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("served", F.last(F.when(F.col("fired"), F.col("truth")), ignorenulls=True).over(upto))
    rows = rows.withColumn("differing", _differing("truth", "served", fields))
    diverges = F.size("differing") > 0
    return rows.select(
        *keys, "gate_strategy", "fired", "reason", F.array_join("differing", ",").alias("differing_fields"), diverges.alias("diverges_from_oracle"),
        (diverges & ~F.col("fired")).alias("missed_change"), "conformance_changed", "source_touched",
    )


def misses(replayed: DataFrame) -> DataFrame:
    """The misses of a replay with the fields that were served stale."""
    return replayed.where("missed_change").select("project", "gate_strategy", "version", "differing_fields", "reason")


def evaluate_mutations(snapshots: DataFrame, fields: tuple[str, ...], strategies: tuple[str, ...] = gate.STRATEGIES) -> DataFrame:
    """Each labelled mutation under each policy: did the gate fire, did the findings move, was that missed or wasted.

    snapshots holds two versions per mutation, 0 before and 1 after it: mutation, category, version,
    expect_structural_change, the columns of ``gate.decide`` and the findings ``fields``.
    """
    moved = gate.decide(snapshots.withColumn("project", F.col("mutation")), strategies).where("version = 1")
    sides = [snapshots.where(f"version = {v}") for v in (0, 1)]
    after = sides[1].select("mutation", "category", "expect_structural_change", F.struct(*fields).alias("after"))
    both = after.join(sides[0].select("mutation", F.struct(*fields).alias("before")), "mutation")
    changed = both.withColumn("changed", _differing("before", "after", fields))
    out = changed.join(moved.select(F.col("project").alias("mutation"), "gate_strategy", F.col("fired").alias("gate_fired"), "reason"), "mutation")
    differ = F.size("changed") > 0
    return out.select(
        "mutation", "category", "gate_strategy", "gate_fired", differ.alias("findings_changed"), F.array_join("changed", ";").alias("changed_fields"),
        (F.col("gate_fired") == F.col("expect_structural_change")).alias("gate_correct_on_structure"),
        (differ & ~F.col("gate_fired")).alias("missed_change"), (~differ & F.col("gate_fired")).alias("wasted_reanalysis"), "reason",
    )
