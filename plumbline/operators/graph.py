"""Snapshot graphs as node and edge tables: diffs, impact, shape isomorphism, renames, hubs, layers, grounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import count_if
from plumbline.operators import shapes
from plumbline.sources import lineage

#: Fixed value: passes of layering.
LAYER_PASSES = 24


#: Attributes of a node whose change counts: as far as a table has them.
TRACKED = ("kind", "signature")


def tracked_in(nodes: DataFrame, tracked: tuple[str, ...]) -> list[str]:
    return [c for c in tracked if c in nodes.columns]


def _steps(rows: DataFrame, versions: DataFrame, *key: str) -> DataFrame:
    """(project, version, key, change) of rows(project, version, key, digest) against the version saved before: one shuffle by key.

    A row is seen from its key's rows before and after it: it was added where the version before had none, and is
    removed in the next version where that has none.
    """
    order = Window.partitionBy("project").orderBy("version")
    placed = lineage.cut(versions.withColumns({"ord": F.row_number().over(order), "next": F.lead("version").over(order)}))  # its size is known then: a small one is broadcast
    line = Window.partitionBy("project", *key).orderBy("ord")
    rows = rows.join(placed, ["project", "version"])
    was, follows = F.lag("ord").over(line) == F.col("ord") - 1, F.lead("ord").over(line) == F.col("ord") + 1
    rows = rows.withColumns({"was": F.coalesce(was, F.lit(False)), "same": F.lag("digest").over(line).eqNullSafe(F.col("digest")), "follows": F.coalesce(follows, F.lit(False))})
    change = F.when(~F.col("was"), "added").when(F.col("same"), "unchanged").otherwise("changed")
    here = F.when(F.col("ord") > 1, F.struct("version", change.alias("change")))
    gone = F.when(~F.col("follows") & F.col("next").isNotNull(), F.struct(F.col("next").alias("version"), F.lit("removed").alias("change")))
    return rows.select("project", *key, F.explode(F.array_compact(F.array(here, gone))).alias("step")).select("project", "step.version", *key, "step.change")


def diff_nodes(nodes: DataFrame, tracked: tuple[str, ...] = TRACKED, versions: DataFrame | None = None) -> DataFrame:
    """(project, version, node, change) against the version before: added, removed, changed or unchanged, deep and NULL-safe."""
    digest = F.xxhash64(F.to_json(F.struct(*tracked_in(nodes, tracked)), {"ignoreNullFields": "false"}))
    rows = nodes.select("project", "version", "node", digest.alias("digest")).dropDuplicates(["project", "version", "node"])
    versions = nodes.select("project", "version").distinct() if versions is None else versions.select("project", "version").distinct()
    return _steps(rows, versions, "node")


def diff_edges(edges: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """(project, version, src, dst, change): added or removed pairs; the relation does not matter."""
    pairs = edges.select("project", "version", "src", "dst").distinct().withColumn("digest", F.lit(0))
    versions = pairs.select("project", "version").distinct() if versions is None else versions.select("project", "version").distinct()
    return _steps(pairs, versions, "src", "dst").where("change <> 'unchanged'")


def delta_counts(nodes: DataFrame, edges: DataFrame, versions: DataFrame | None = None, moved: DataFrame | None = None, moved_edges: DataFrame | None = None) -> DataFrame:
    """Per (project, version): the five delta sizes and their sum, the set-based edit distance.

    Edges are compared over ``versions``, by default those that have edges. ``moved`` is diff_nodes' result where it is at hand, ``moved_edges`` diff_edges'.
    """
    moved = diff_nodes(nodes, versions=versions) if moved is None else moved
    n = moved.groupBy("project", "version").agg(*(count_if(F.col("change") == c).alias(f"{c}_nodes") for c in ("added", "removed", "changed")))
    e = (diff_edges(edges, versions) if moved_edges is None else moved_edges).groupBy("project", "version").agg(*(count_if(F.col("change") == c).alias(f"{c}_edges") for c in ("added", "removed")))
    names = ("added_nodes", "removed_nodes", "changed_nodes", "added_edges", "removed_edges")
    both = n.join(e, ["project", "version"], "left" if versions is None else "full_outer")
    out = both.select("project", "version", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names))
    return out.withColumn("edit_distance", reduce(lambda a, b: a + b, map(F.col, names)))


def impact(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, radius: int, known: bool = False) -> DataFrame:
    """(project, version, node, hops): seeds that exist and everything within ``radius`` undirected steps of them. Seeds that are ``known`` are nodes, each once."""
    keys = ["project", "version"]
    ways = (F.struct(F.col(a).alias("node"), F.col(b).alias("to")) for a, b in (("src", "dst"), ("dst", "src")))
    both = edges.select(*keys, F.explode(F.array(*ways)).alias("way")).select(*keys, "way.*")  # one reading of the edges
    if radius > 1:
        both = lineage.cut(both.distinct())
    reached = seeds.select(*keys, "node")
    reached = (reached if known else reached.distinct().join(nodes.select(*keys, "node").distinct(), [*keys, "node"])).withColumn("hops", F.lit(0))
    front = reached = lineage.cut(reached) if radius > 0 and not known else reached
    for hop in range(1, radius + 1):
        step = front.join(both, [*keys, "node"]).select(*keys, F.col("to").alias("node"), F.lit(hop).alias("hops"))
        if hop == radius:
            return reached.unionByName(step).groupBy(*keys, "node").agg(F.min("hops").alias("hops"))
        front = lineage.cut(step.distinct().join(reached, [*keys, "node"], "left_anti"))
        reached = reached.unionByName(front)
    return reached


def _pair(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two snapshots of each project as its versions 0 and 1."""
    return old.withColumn("version", F.lit(0)).unionByName(new.withColumn("version", F.lit(1)))


def isomorphic(old: DataFrame, new: DataFrame, old_edges: DataFrame, new_edges: DataFrame, most: int | None = None) -> DataFrame:
    """(project, isomorphic) of two snapshots of each project, names aside: NULL beyond ``most`` nodes, where that is given and counts do not tell."""
    versions = _pair(*(t.select("project").distinct() for t in (old.select("project").unionByName(new.select("project")),) * 2))
    return shapes.same_as_before(_pair(old, new), _pair(old_edges, new_edges), most, versions=versions).select("project", "isomorphic")


def renames(old: DataFrame, new: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(project, node, new_node) of nodes whose name changed, only where the whole mapping carries every edge both ways."""
    return shapes.renamed(_pair(old, new), _pair(old_edges, new_edges)).select("project", "node", "new_node")


def degrees(edges: DataFrame, *keys: str) -> DataFrame:
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy(*keys, "node").agg(F.count("*").alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, most: int, *keys: str) -> DataFrame:
    """(keys, node, degree, place): at most ``most`` nodes per key, of highest degree, ties by id.

    Classes, interfaces and modules only, or all nodes where a key has none of these; nodes without edges have degree 0.
    """
    shown = F.col("kind").isin("class", "interface", "module")
    some = lineage.cut(nodes.where(shown).select(*keys).distinct().withColumn("some", F.lit(True)))  # one row a key
    pool = nodes.select(*keys, "node", "kind").join(some, list(keys), "left").where(shown | F.col("some").isNull()).select(*keys, "node").distinct()
    ranked = pool.join(degrees(edges, *keys), [*keys, "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("degree"), "node"))
    return ranked.withColumn("place", place.cast("bigint")).where(F.col("place") <= most)


def induced(edges: DataFrame, kept: DataFrame, *keys: str) -> DataFrame:
    """Edges both ends of which are kept."""
    kept = lineage.cut(kept.select(*keys, "node"))
    for end in ("src", "dst"):
        edges = edges.join(kept.select(*keys, F.col("node").alias(end)).distinct(), [*keys, end], "left_semi")
    return edges


#: Names that tell a node's layer, in the order in which they are tried.
LAYER_NAMES = (
    "(controller|handler|resource|endpoint|router|view|api)$",
    "(service|manager|usecase|use_case|facade|engine|processor)$",
    "(repository|repo|dao|gateway|store|client|adapter)$",
    "(model|entity|dto|record|schema|domain|type)$",
)


def layers(edges: DataFrame, nodes: DataFrame, *keys: str, passes: int = LAYER_PASSES) -> DataFrame:
    """Layer of every node, gaps closed: by the ending of its name (``label``, else ``node``), and never moved, or else the longest path to it.

    Paths grow in synchronous passes that end when no layer rises or after ``passes``; a node told by its name passes its layer
    on. Each pass is checkpointed, so the plan does not double; on cycles, which have no longest path, the passes are the bound.
    """
    edges = lineage.cut(edges.select(*keys, "src", "dst"))
    label = F.lower(F.col("label") if "label" in nodes.columns else F.col("node"))
    told = F.coalesce(*(F.when(label.rlike(name), F.lit(k)) for k, name in enumerate(LAYER_NAMES)))
    now = nodes.select(*keys, "node", told.alias("told")).groupBy(*keys, "node").agg(F.min("told").alias("told"))
    now = now.withColumns({"pinned": F.col("told").isNotNull(), "layer": F.coalesce("told", F.lit(0)), "rose": F.lit(True)}).drop("told")
    for _ in range(passes):
        rose = now.where("rose").select(*keys, F.col("node").alias("src"), "layer")
        up = edges.join(rose, [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg((F.max("layer") + 1).alias("up"))
        higher = F.coalesce((F.col("up") > F.col("layer")) & ~F.col("pinned"), F.lit(False))
        layer = F.when(higher, F.col("up")).otherwise(F.col("layer"))
        now = lineage.cut(now.join(up, [*keys, "node"], "left").select(*keys, "node", "pinned", layer.alias("layer"), higher.alias("rose")))
        if now.where("rose").isEmpty():
            break
    closed = F.dense_rank().over(Window.partitionBy(*keys).orderBy("layer")) - 1
    return now.select(*keys, "node", closed.cast("bigint").alias("layer"))


def ground(inferred: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Inferred nodes (node, name) matched to known (node, name, node_order) by id, else name, else the last part of the id; others get the prefix llm::."""
    by_id = known.select(*keys, F.col("node").alias("id_hit")).distinct().withColumn("probe", F.col("id_hit"))
    first = known.groupBy(*keys, "name").agg(F.min_by("node", "node_order").alias("name_hit"))
    base = first.select(*keys, F.col("name").alias("leaf"), F.col("name_hit").alias("leaf_hit"))
    out = inferred.withColumns({"probe": F.col("node"), "leaf": F.substring_index(F.substring_index("node", "::", -1), "/", -1)})
    out = out.join(by_id, [*keys, "probe"], "left").join(first, [*keys, "name"], "left").join(base, [*keys, "leaf"], "left")
    hit = F.coalesce("id_hit", "name_hit", "leaf_hit")
    return out.select(*keys, "node", F.coalesce(hit, F.concat(F.lit("llm::"), F.col("node"))).alias("grounded_as"), hit.isNotNull().alias("grounded"))


def merge_inferred(edges: DataFrame, inferred: DataFrame, grounding: DataFrame, *keys: str) -> DataFrame:
    """Known edges, and inferred edges(source, target, relation) between what their ends are grounded as (node, grounded_as).

    An edge that is known is marked confirmed and keeps its relation; the others come from the model, one a pair. Edges of a
    node to itself and those with an end that was never inferred are dropped.
    """
    for end, alias in (("source", "src"), ("target", "dst")):
        inferred = inferred.join(grounding.select(*keys, F.col("node").alias(end), F.col("grounded_as").alias(alias)).distinct(), [*keys, end])
    new = inferred.where("src <> dst").groupBy(*keys, "src", "dst").agg(F.min("relation").alias("said"))
    known = edges.groupBy(*keys, "src", "dst").agg(F.min("relation").alias("relation"))
    both = known.join(new, [*keys, "src", "dst"], "full_outer")
    origin = F.when(F.col("relation").isNull(), "model").otherwise("code")
    return both.select(*keys, "src", "dst", F.coalesce("relation", "said").alias("relation"), origin.alias("origin"), (F.col("relation").isNotNull() & F.col("said").isNotNull()).alias("confirmed"))


def grounded_ratio(grounding: DataFrame, *keys: str) -> DataFrame:
    """(keys, inferred, grounded, ratio)."""
    out = grounding.groupBy(*keys).agg(F.count("*").alias("inferred"), count_if(F.col("grounded")).alias("grounded"))
    return out.withColumn("ratio", F.try_divide("grounded", "inferred"))


def annotate_edges(edges: DataFrame, designed: DataFrame, nodes: DataFrame, *keys: str) -> DataFrame:
    """Edges of the code, and designed edges(src, dst, relation) between nodes that are there, where the code has no edge of that pair."""
    pair = [*keys, "src", "dst"]
    own = edges.select(*pair, "relation", F.lit("code").alias("origin"))
    more = induced(designed.select(*pair, "relation").dropDuplicates(pair), nodes, *keys).join(edges.select(*pair), pair, "left_anti")
    return own.unionByName(more.select(*pair, F.coalesce("relation", F.lit("designed")).alias("relation"), F.lit("uml").alias("origin")))


def annotate(nodes: DataFrame, status: DataFrame, *keys: str) -> DataFrame:
    """Conformance of each node: classes and interfaces by status, undocumented without one, others not applicable; designed nodes that are absent are added."""
    design = status.select(*keys, F.col("element").alias("name"), "status")
    kind = F.col("kind").isin("class", "interface")
    out = nodes.join(design, [*keys, "name"], "left").select(
        *keys, "node", "name", "kind", F.when(~kind, "not_applicable").when(F.col("status").isNull(), "undocumented").when(F.col("status") == "conforming", "conforming").otherwise("partial").alias("conformance")
    )
    lost = design.where("status = 'absent'").select(*keys, F.concat(F.lit("uml::"), "name").alias("node"), "name", F.lit("class").alias("kind"), F.lit("missing").alias("conformance"))
    return out.unionByName(lost)


def one_edge(edges: DataFrame, *keys: str) -> DataFrame:
    """A single relation per ordered pair: the last inserted wins."""
    return edges.groupBy(*keys, "src", "dst").agg(F.max_by("relation", "ord").alias("relation"))


def agreement(reports: DataFrame, *keys: str) -> DataFrame:
    """All pairs of models (ord, model, score, gaps[, nodes]): score difference, gap-set overlap (NULL if both have no gaps) and difference of node counts."""
    reports = reports if "nodes" in reports.columns else reports.withColumn("nodes", F.lit(None).cast("bigint"))
    other = reports.select(*keys, *(F.col(c).alias(f"o_{c}") for c in ("ord", "model", "score", "gaps", "nodes")))
    pairs = reports.join(other, list(keys)).where("ord < o_ord")
    union: Column = F.size(F.array_union("gaps", "o_gaps"))
    return pairs.select(*keys, "model", F.col("o_model").alias("other"), F.abs(F.col("score") - F.col("o_score")).alias("score_gap"), F.try_divide(F.size(F.array_intersect("gaps", "o_gaps")), F.nullif(union, F.lit(0))).alias("overlap"), F.abs(F.col("nodes") - F.col("o_nodes")).alias("node_gap"))
