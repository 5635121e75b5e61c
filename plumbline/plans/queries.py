"""Registered queries: the operators applied to the stand-in tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import columns as fn
from plumbline.operators import compare, facts, findings, gate, graph, history, relabel, replay, report, resolve, responses, shapes, snapshots, statistics, survival
from plumbline.sources import files, lineage
from plumbline.sources.bridge import load
from plumbline.streaming import jobs

QUERIES: dict = {}


def query(name: str):
    def register(f):
        QUERIES[name] = f
        return f

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places (sums may be added up in any order), integers as BIGINT."""
    cast = {"double": lambda c: F.round(c, 6), "int": lambda c: c.cast("bigint"), "smallint": lambda c: c.cast("bigint"), "tinyint": lambda c: c.cast("bigint")}
    return df.select(*(cast.get(t, lambda c: c)(F.col(f"`{n}`")).alias(n) for n, t in df.dtypes))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    members = load(spark, sf_dir, "members")
    return members.where("side = 'design'").drop("side"), members.where("side = 'code'").drop("side")


def _compared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    design, code = _sides(spark, sf_dir)
    return compare.compare_elements(design, code, "project"), compare.compare_members(design, code, "project")


@query("c01_element_compare")
def c01(spark, sf_dir):
    return compare.compare_elements(*_sides(spark, sf_dir), "project")


@query("c02_member_compare")
def c02(spark, sf_dir):
    return compare.compare_members(*_sides(spark, sf_dir), "project")


@query("e01_conformance_score")
def e01(spark, sf_dir):
    return tidy(compare.conformance_score(*_compared(spark, sf_dir), "project").withColumn("score", fn.round2(F.col("score"))))


def _evidence(spark, sf_dir):
    fields, uses = load(spark, sf_dir, "code_fields"), load(spark, sf_dir, "code_callables")
    elements = _sides(spark, sf_dir)[1].select("project", "element").distinct()
    return compare.association_evidence(load(spark, sf_dir, "associations"), fields, uses, elements, "project")


@query("c04_association_evidence")
def c04(spark, sf_dir):
    return _evidence(spark, sf_dir)


@query("e01_score_with_relations")
def e01_relations(spark, sf_dir):
    credits = compare.relation_credits(c03(spark, sf_dir), _evidence(spark, sf_dir), "project")
    return tidy(compare.conformance_score(*_compared(spark, sf_dir), "project", relations=credits).withColumn("score", fn.round2(F.col("score"))))


@query("h01_round2")
def h01(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity").cast("double") / 8).alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    values = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fn.round2(F.col("x")).alias("halves"), fn.round2(F.col("y") / 1000).alias("thousands"))
    return tidy(values)


@query("b09_code_as_design")
def b09(spark, sf_dir):
    fields = load(spark, sf_dir, "code_fields").withColumnRenamed("element", "class")
    uses = load(spark, sf_dir, "code_callables").where("kind <> 'param'").withColumn("name", F.concat(F.lit("m"), F.col("pos").cast("string")))
    methods = uses.select("project", F.col("element").alias("class"), "name", F.when(F.col("kind") == "return", F.col("type")).alias("returns"))
    classes = fields.select("project", "class").distinct().withColumn("kind", F.when(F.endswith("class", F.lit("7")), "interface").otherwise("enum"))
    elements, members = compare.project_code(classes, fields, methods, "project")
    return members.distinct().join(elements, ["project", "element"], "left")


@query("b15_all_findings")
def b15_all(spark, sf_dir):
    elements, members = _compared(spark, sf_dir)
    violations = c21(spark, sf_dir).withColumn("project", F.length("file_path") % 5)
    keys = compare.finding_keys(elements, members, "project", relations=c03(spark, sf_dir), associations=_evidence(spark, sf_dir), violations=violations)
    return compare.findings_fingerprint(keys, "project")


@query("b14_reflexion_counts")
def b14(spark, sf_dir):
    return compare.reflexion_counts(*_compared(spark, sf_dir), "project")


@query("b14_reflexion_with_relations")
def b14_relations(spark, sf_dir):
    return tidy(compare.reflexion_with_relations(*_compared(spark, sf_dir), c03(spark, sf_dir), _evidence(spark, sf_dir), "project", score_associations=True))


@query("b15_findings_fingerprint")
def b15(spark, sf_dir):
    return compare.findings_fingerprint(compare.finding_keys(*_compared(spark, sf_dir), "project"), "project")


@query("b16_signature_difference")
def b16(spark, sf_dir):
    before, after = _compared(spark, sf_dir)
    old = compare.reflexion_counts(before, after.where("member_kind = 'attribute'"), "project")
    return compare.signature_differences(old, compare.reflexion_counts(before, after, "project"), ("divergences", "absences", "convergences"), "project")


@query("b17_element_status")
def b17(spark, sf_dir):
    return compare.element_status(*_compared(spark, sf_dir), "project")


@query("b24_gap_sentences")
def b24(spark, sf_dir):
    return compare.gap_sentences(*_compared(spark, sf_dir), "project", relations=c03(spark, sf_dir), associations=_evidence(spark, sf_dir))


@query("b24_recommendations")
def b24_advice(spark, sf_dir):
    elements, members = _compared(spark, sf_dir)
    known = elements.withColumn("state", F.when(F.col("project") == 2, "matched").otherwise(F.col("state")))  # one project without gaps of classes
    associations = _evidence(spark, sf_dir).where("project < 2")
    return tidy(compare.recommendations(known, members, "project", associations=associations))


@query("g08_member_sets")
def g08(spark, sf_dir):
    design, code = (x.select("project", "element", "member") for x in _sides(spark, sf_dir))
    parts = {"missing": design.exceptAll(code), "extra": code.exceptAll(design), "both": design.intersect(code)}
    out = [d.groupBy("project").agg(F.count("*").alias("n")).select("project", F.lit(k).alias("part"), "n") for k, d in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("c03_relation_check")
def c03(spark, sf_dir):
    edges = load(spark, sf_dir, "snap_edges").withColumnsRenamed({"src": "source", "dst": "target"})
    design = edges.where("version = 0").select("project", "source", "target", "relation")
    code = edges.where("version = 1 AND relation <> 'extends'").select("project", "source", "target", "relation")
    untyped = edges.where("version = 2 AND relation = 'extends'").select("project", "source", "target")
    return compare.check_relations(design, code, untyped, "project")


@query("c06_unique_names")
def c06(spark, sf_dir):
    return resolve.unique(load(spark, sf_dir, "definitions"), "name", "def_id")


def _resolved(spark, sf_dir):
    return resolve.resolve_by_name(load(spark, sf_dir, "call_sites"), load(spark, sf_dir, "definitions"))


@query("c09_call_resolution")
def c09(spark, sf_dir):
    return _resolved(spark, sf_dir).select("caller", "site", "bucket", "target")


@query("c10_call_edges")
def c10(spark, sf_dir):
    nodes = load(spark, sf_dir, "definitions").select(F.col("def_id").alias("node"))
    return resolve.call_edges(_resolved(spark, sf_dir).withColumn("caller", F.col("caller_file").cast("string")), nodes)


@query("e02_resolution_stats")
def e02(spark, sf_dir):
    out = resolve.resolution_stats(_resolved(spark, sf_dir), "caller_file")
    return tidy(out.select("caller_file", "same_file", "unique_global", "ambiguous", "external", "sites", "resolved", "rate"))


def _code(spark, sf_dir):
    classes = load(spark, sf_dir, "code_classes")
    method = F.concat(F.lit("m"), (F.col("size") % 4).cast("string"))
    methods = classes.select("class", method.alias("name"), F.concat("class", F.lit("::"), method).alias("method_id"), F.lit(0).alias("pos"))
    fields = classes.select("class", F.lit("f1").alias("field"), F.concat(F.lit("a.C"), F.floor(F.col("k") / 2).cast("string")).alias("type"))
    bases = classes.where("k % 4 = 3").select("class", F.concat(F.lit("C"), (F.col("k") - 1).cast("string")).alias("base"), F.lit(0).alias("pos"))
    return classes.drop("k", "size"), methods, fields, bases, load(spark, sf_dir, "code_functions")


def _cascade(spark, sf_dir):
    return resolve.resolve_calls(load(spark, sf_dir, "code_sites"), *_code(spark, sf_dir), load(spark, sf_dir, "code_imports"))


@query("c09_call_cascade")
def c09_cascade(spark, sf_dir):
    return _cascade(spark, sf_dir)


@query("e02_cascade_stats")
def e02_cascade(spark, sf_dir):
    return tidy(resolve.resolution_stats(_cascade(spark, sf_dir)))


@query("c11_implementation_graph")
def c11_graph(spark, sf_dir):
    classes, methods, _, bases, functions = _code(spark, sf_dir)
    text = lambda t: t.withColumn("file", F.concat(F.lit("file"), F.col("file").cast("string")))
    callers = load(spark, sf_dir, "code_sites").where("class IS NOT NULL").select("site", F.col("class").alias("caller")).distinct()
    calls = _cascade(spark, sf_dir).join(callers, "site").where("target IS NOT NULL")
    calls = calls.select(F.col("caller").alias("src"), F.col("target").alias("dst"), F.when(F.col("bucket") == "instantiation", "instantiates").otherwise("calls").alias("relation"))
    supertypes = bases.select("class", F.concat(F.lit("K"), F.substring("base", 2, 20)).alias("base"), F.lit("extends").alias("relation"))
    modules = text(classes.select("file").union(functions.select("file")).distinct())
    nodes, edges = resolve.implementation_graph(modules, text(classes).withColumn("kind", F.lit("class")), methods, supertypes, calls, functions=text(functions))
    out = nodes.select(F.lit("node").alias("part"), "kind", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"))
    return out.unionByName(edges.select(F.lit("edge").alias("part"), F.col("relation").alias("kind"), "src", "dst"))


@query("c12_design_graph_nodes")
def c12(spark, sf_dir):
    edges = load(spark, sf_dir, "snap_edges").where("version = 0")
    elements = load(spark, sf_dir, "snap_nodes").where("version = 0 AND kind = 'class'").select("project", F.col("node").alias("element"), F.col("kind").alias("element_type"))
    return resolve.design_graph(elements, edges.select("project", F.col("src").alias("source"), F.col("dst").alias("target"), "relation"), "project")[0]


@query("c11_single_edges")
def c11(spark, sf_dir):
    return graph.one_edge(load(spark, sf_dir, "snap_edges").withColumn("ord", F.col("version")), "project")


@query("c13_snapshot_node_diff")
def c13(spark, sf_dir):
    return graph.diff_nodes(load(spark, sf_dir, "snap_nodes")).where("change <> 'unchanged'")


@query("c13_snapshot_edge_diff")
def c13_edges(spark, sf_dir):
    return graph.diff_edges(load(spark, sf_dir, "snap_edges"))


def _scored_versions(nodes):
    return nodes.groupBy("project", "version").agg((100 * fn.count_if(F.col("kind") == "class") / F.count("*")).alias("score"))


@query("c14_version_diff")
def c14(spark, sf_dir):
    kept = lineage.cut(load(spark, sf_dir, "snap_nodes"))
    versions = lineage.cut(_scored_versions(kept))
    nodes, edges = snapshots.node_intervals(kept, versions), snapshots.edge_intervals(load(spark, sf_dir, "snap_edges"), versions)
    found = snapshots.diff(nodes, edges, versions, 0, 3)
    return tidy(found.select("project", "retained", *replay.DELTAS, *(F.array_join(c, ",").alias(c) for c in ("added", "removed", "changed")), "score_from", "score_to"))


def _whole_snapshots(spark, sf_dir):
    tables = {"nodes": lineage.cut(load(spark, sf_dir, "snap_nodes")), "edges": lineage.cut(load(spark, sf_dir, "snap_edges"))}
    hashes = {"text_hash": F.lit("t"), "structure_hash": F.lit("s"), "design_hash": F.floor(F.col("version") / 4).cast("string")}
    return tables | {"snapshots": lineage.cut(_scored_versions(tables["nodes"]).withColumns(hashes))}


def _store(spark):
    return snapshots.SnapshotStore(spark, f"{lineage.folder(spark)}/{uuid.uuid4().hex}", buckets=8)


@query("a12_snapshot_store")
def a12(spark, sf_dir):
    store, tables = _store(spark), _whole_snapshots(spark, sf_dir)
    for batch, some in ((0, "version < 1"), (1, "version BETWEEN 1 AND 2"), (1, "version BETWEEN 1 AND 2"), (2, "version > 2")):  # run again, a batch adds nothing
        store.append(*(tables[p].where(some) for p in ("nodes", "edges", "snapshots")), batch, number=True)
    return tidy(store.versions().select("project", "version", "parent_version", "node_count", "edge_count", "score"))


@query("a12_stored_intervals")
def a12_intervals(spark, sf_dir):
    versions = load(spark, sf_dir, "snap_nodes").select("project", "version").distinct()
    return snapshots.node_intervals(load(spark, sf_dir, "snap_nodes"), versions).select("project", "node", "valid_from", "valid_to")


@query("c15_impact_set")
def c15(spark, sf_dir):
    nodes = lineage.cut(load(spark, sf_dir, "snap_nodes"))
    found = graph.impact(load(spark, sf_dir, "snap_edges"), nodes, nodes.where("kind = 'class' AND signature = '7'"), 1)
    return tidy(found)


@query("c16_same_shape")
def c16(spark, sf_dir):
    return shapes.same_as_before(load(spark, sf_dir, "ring_nodes"), load(spark, sf_dir, "ring_edges"))


@query("c17_rename_recovery")
def c17(spark, sf_dir):
    return shapes.renamed(load(spark, sf_dir, "chain_nodes"), load(spark, sf_dir, "chain_edges"))


@query("d01_gate_on_shapes")
def d01_shapes(spark, sf_dir):
    nodes, edges = load(spark, sf_dir, "ring_nodes"), load(spark, sf_dir, "ring_edges")
    named = nodes.groupBy("project", "version").agg(F.min("node").alias("structure_hash")).withColumns({"text_hash": F.col("structure_hash"), "design_hash": F.lit("d")})
    return gate.decide(named.join(shapes.same_as_before(nodes, edges), ["project", "version"], "left"), ("structural", "isomorphism"))


@query("c18_edit_distance")
def c18(spark, sf_dir):
    return graph.delta_counts(load(spark, sf_dir, "snap_nodes"), load(spark, sf_dir, "snap_edges"))


@query("c19_annotated_nodes")
def c19(spark, sf_dir):
    elements, members = _compared(spark, sf_dir)
    nodes = elements.where("state <> 'missing'").select("project", F.col("element").alias("node"), F.col("element").alias("name"), F.lit("class").alias("kind"))
    return graph.annotate(nodes, compare.element_status(elements, members, "project"), "project")


@query("c19_annotated_edges")
def c19_edges(spark, sf_dir):
    edges, nodes = load(spark, sf_dir, "snap_edges"), load(spark, sf_dir, "snap_nodes")
    now, planned = (edges.where(f"version = {v}").drop("version") for v in (2, 1))
    return graph.annotate_edges(now, planned, nodes.where("version = 2").select("project", "node"), "project")


def _inferred(spark, sf_dir):
    edges = load(spark, sf_dir, "snap_edges")
    said = edges.where("version = 1").select("project", F.concat(F.lit("x/"), "src").alias("source"), F.col("dst").alias("target"), F.lit("uses").alias("relation"))
    names = said.select("project", F.col("source").alias("node")).union(said.select("project", "target")).distinct().withColumn("name", F.col("node"))
    known = load(spark, sf_dir, "snap_nodes").where("version = 0").select("project", "node", F.col("node").alias("name"), F.lit(0).alias("node_order")).distinct()
    return edges.where("version = 0").drop("version"), said, graph.ground(names, known, "project")


@query("c20_merged_edges")
def c20_edges(spark, sf_dir):
    return graph.merge_inferred(*_inferred(spark, sf_dir), "project")


@query("c20_grounded_ratio")
def c20_ratio(spark, sf_dir):
    return tidy(graph.grounded_ratio(_inferred(spark, sf_dir)[2], "project"))


@query("c20_grounding")
def c20(spark, sf_dir):
    sites = load(spark, sf_dir, "call_sites").select(F.col("callee").alias("name")).distinct().withColumn("node", F.concat(F.lit("class::x/"), "name"))
    known = load(spark, sf_dir, "definitions").select(F.col("def_id").alias("node"), "name", F.col("def_id").cast("bigint").alias("node_order"))
    keyed = [t.withColumn("project", F.lit(0)) for t in (sites, known)]
    return graph.ground(*keyed, "project").select("node", "grounded_as", "grounded")


@query("c21_layer_rules")
def c21(spark, sf_dir):
    rules = spark.sql("SELECT 'view-layer' AS rule, 'economy' AS source_marker, forbidden_marker FROM VALUES ('widget'), ('red'), ('blue') AS t(forbidden_marker)")
    return compare.layer_violations(load(spark, sf_dir, "layer_evidence"), rules)


@query("c25_model_agreement")
def c25(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    reports = parts.groupBy(F.col("p_size").cast("bigint").alias("project"), F.col("p_brand").alias("model")).agg(
        F.avg("p_retailprice").alias("score"), F.array_sort(F.collect_set("p_type")).alias("gaps"), F.count("*").alias("nodes")
    )
    return tidy(graph.agreement(reports.withColumn("ord", F.col("model")), "project"))


@query("g05_hub_nodes")
def g05(spark, sf_dir):
    return graph.hubs(load(spark, sf_dir, "snap_nodes"), load(spark, sf_dir, "snap_edges"), 10, "project", "version")


@query("g05_induced_edges")
def g05_edges(spark, sf_dir):
    edges = lineage.cut(load(spark, sf_dir, "snap_edges"))
    return graph.induced(edges, graph.hubs(load(spark, sf_dir, "snap_nodes"), edges, 60, "project", "version"), "project", "version")


@query("g06_layers")
def g06(spark, sf_dir):
    ending = F.when(F.endswith("node", F.lit("7")), "Repository").when(F.endswith("node", F.lit("3")), "Controller").otherwise("")
    nodes = load(spark, sf_dir, "snap_nodes").withColumn("label", F.concat("node", ending))
    return graph.layers(load(spark, sf_dir, "snap_edges"), nodes, "project", "version")


def _snapshots(spark, sf_dir):
    docs = load(spark, sf_dir, "doc_versions")
    return docs.withColumn("design_hash", F.floor(F.col("version") / 25).cast("string"))


@query("d01_gate_decisions")
def d01(spark, sf_dir):
    return gate.decide(_snapshots(spark, sf_dir))


@query("d02_chained_previous")
def d02(spark, sf_dir):
    docs = load(spark, sf_dir, "doc_versions")
    return docs.select("project", "version", F.lag("version").over(Window.partitionBy("project").orderBy("version")).alias("previous"))


@query("d03_reuse_bookkeeping")
def d03(spark, sf_dir):
    return gate.reuse(gate.decide(_snapshots(spark, sf_dir))).select("project", "version", "gate_strategy", "served_version", "reused_from")


@query("d03_relabelled_gaps")
def d03_relabelled(spark, sf_dir):
    nodes, edges = load(spark, sf_dir, "renamed_nodes"), load(spark, sf_dir, "renamed_edges")
    snaps = nodes.groupBy("project", "version").agg(F.max("node").alias("structure_hash")).withColumns({"text_hash": F.col("structure_hash"), "design_hash": F.lit("d"), "delta_size": F.lit(1)})
    found = lineage.cut(shapes.measured(nodes, edges, names=True))
    reused = gate.reuse(gate.decide(snaps.join(shapes.same_as_before(nodes, edges, found=found), ["project", "version"], "left"), ("structural", "isomorphism")))
    gaps = nodes.where("ring % 5 = 0").select("project", "version", "node", F.lit("lacks a method").alias("gap"))
    return relabel.carried(reused, shapes.renamed(nodes, edges, found=found), gaps, snaps)


@query("d05_corpus_replay")
def d05(spark, sf_dir):
    decisions = gate.decide(_snapshots(spark, sf_dir))
    return tidy(decisions.groupBy("project", "gate_strategy").agg(F.count("*").alias("runs"), fn.count_if(F.col("fired")).alias("fired"), F.countDistinct("reason").alias("reasons")))


@query("d01_all_policies")
def d01_all_policies(spark, sf_dir):
    return gate.decide(load(spark, sf_dir, "history"))


@query("d04_run_rows")
def d04(spark, sf_dir):
    nodes, edges = lineage.cut(load(spark, sf_dir, "snap_nodes")), lineage.cut(load(spark, sf_dir, "snap_edges").select("project", "version", "src", "dst"))
    snaps = nodes.groupBy("project", "version").agg(F.count("*").alias("tokens")).withColumns({"text_hash": F.lit("t"), "structure_hash": F.lit("s"), "design_hash": F.floor(F.col("version") / 4).cast("string")})
    return tidy(replay.run_rows(snaps, nodes, edges, {"impact_radius": 1, "provider": "none"}))


FINDINGS = ("divergences", "absences")


@query("d05_oracle_replay")
def d05_oracle(spark, sf_dir):
    return replay.replay(load(spark, sf_dir, "history"), FINDINGS)


def _history(spark, sf_dir):
    design = lineage.cut(load(spark, sf_dir, "members").where("side = 'design'").select("project", "element", "member_kind", "member"))
    code = lineage.cut(load(spark, sf_dir, "code_history"))
    versions = lineage.cut(code.select("project", "version").distinct())
    there = findings.present(code, versions)
    return design, code, versions, lineage.cut(findings.over_versions(design, code, versions, there)), there


@query("d05_findings_by_delta")
def d05_delta(spark, sf_dir):
    design, code, versions, found, there = _history(spark, sf_dir)
    return tidy(findings.per_version(found, design, code, versions, there).drop("missing_classes", "extra_classes", "element_differences"))


@query("d05_element_statuses")
def d05_statuses(spark, sf_dir):
    design, _, versions, found, _ = _history(spark, sf_dir)
    return findings.statuses(found, design, versions)


@query("d05_replay_from_facts")
def d05_facts(spark, sf_dir):
    design, code, versions, found, there = _history(spark, sf_dir)
    truth = findings.per_version(found, design, code, versions, there)
    seen = code.groupBy("project", "version").agg(F.count_if(F.col("member_kind") == "method").cast("string").alias("structure_hash"), F.count("*").cast("string").alias("text_hash"))
    some = truth.join(seen, ["project", "version"]).withColumn("structure_hash", F.when(F.col("version") % 3 == 0, F.lit("same")).otherwise(F.col("structure_hash")))
    return replay.replay(some.withColumn("design_hash", F.lit("d")), findings.FIELDS)


@query("d04_rows_with_analysis")
def d04_analysis(spark, sf_dir):
    nodes, edges = lineage.cut(load(spark, sf_dir, "snap_nodes")), lineage.cut(load(spark, sf_dir, "snap_edges").select("project", "version", "src", "dst"))
    nodes = nodes.withColumn("tokens", F.length("node"))
    design, code, versions, found, there = _history(spark, sf_dir)
    truth = findings.per_version(found, design, code, versions, there).withColumn("version", F.col("version") - 3)
    snaps = nodes.select("project", "version").distinct().withColumns({"text_hash": F.lit("t"), "structure_hash": F.lit("s"), "design_hash": F.floor(F.col("version") / 4).cast("string")})
    return tidy(replay.run_rows(snaps, nodes, edges, analysis=truth).drop("prompt_tokens"))


@query("d05_misses")
def d05_misses(spark, sf_dir):
    return replay.misses(replay.replay(load(spark, sf_dir, "history"), FINDINGS))


@query("d07_labelled_deviations")
def d07(spark, sf_dir):
    return replay.evaluate_mutations(load(spark, sf_dir, "mutations"), FINDINGS)


@query("d06_forced_run")
def d06(spark, sf_dir):
    return gate.decide(_snapshots(spark, sf_dir), ("always",)).where("fired").select("project", "version", "reason")


@query("b07_project_roll_up")
def b07(spark, sf_dir):
    docs = load(spark, sf_dir, "doc_versions")
    rows = docs.select("project", F.col("doc_id").cast("string").alias("path"), F.col("text_hash").alias("hash"))
    return gate.roll_up(rows, "project")


@query("b08_source_touched")
def b08(spark, sf_dir):
    docs = load(spark, sf_dir, "doc_versions").withColumn("tree_hash", F.col("text_hash"))
    return gate.touched(docs).select("project", "version", "source_touched")


@query("b06_text_fingerprint")
def b06(spark, sf_dir):
    return load(spark, sf_dir, "doc_versions").select("doc_id", "text_hash", "structure_hash")


@query("b22_token_estimate")
def b22(spark, sf_dir):
    docs = load(spark, sf_dir, "doc_versions")
    decisions = gate.decide(_snapshots(spark, sf_dir))
    sized = docs.select("project", "version", fn.tokens(F.col("n_chars")).alias("tokens"))
    out = decisions.join(sized, ["project", "version"]).withColumn("sent", F.when(F.col("fired"), F.col("tokens")).otherwise(F.lit(0)))
    return out.groupBy("project", "gate_strategy").agg(F.sum("sent").alias("tokens"))


@query("b23_representation_saving")
def b23(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    facts = F.length(F.regexp_replace("text", r"[^A-Za-z0-9 ]", ""))
    out = docs.groupBy("source").agg(F.sum(fn.tokens(F.col("n_chars"))).alias("raw_tokens"), F.sum(fn.tokens(facts)).alias("fact_tokens"))
    return tidy(out.withColumn("saving", 100 * (1 - F.col("fact_tokens") / F.greatest(F.col("raw_tokens"), F.lit(1)))))


@query("b22_payload_tokens")
def b22_payload(spark, sf_dir):
    nodes = load(spark, sf_dir, "snap_nodes").withColumn("file_path", F.concat(F.lit("f"), "signature"))
    records = nodes.groupBy("project", "version", "file_path").agg(F.array_sort(F.collect_list("node")).alias("classes"))
    records = records.select("project", "version", "file_path", F.struct("file_path", "classes").alias("record"))
    impact = nodes.where("version % 2 = 0 AND signature = '7'").select("project", "version", F.concat_ws("::", F.lit("class"), "file_path", "node").alias("node"))
    before = F.lag("version").over(Window.partitionBy("project").orderBy("version"))
    decisions = nodes.select("project", "version").distinct().select("project", "version", before.alias("previous"), (F.col("version") % 3 != 0).alias("fired"))
    return facts.payload_tokens(decisions, records, impact, "project", "version")


@query("b23_fact_tokens")
def b23_facts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.coalesce("text", F.lit("")))
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))))
    records = docs.select("source", F.struct(F.col("doc_id").alias("file_path"), names.alias("names")).alias("record"))
    return tidy(facts.representation_saving(docs.select("source", F.length("text").alias("chars")), records, "source"))


@query("f13_version_ring")
def f13(spark, sf_dir):
    return gate.keep_newest(load(spark, sf_dir, "doc_versions").select("project", "version", "doc_id"))


@query("g02_latest_versions")
def g02(spark, sf_dir):
    return load(spark, sf_dir, "doc_versions").groupBy("project").agg(F.max("version").alias("latest"), F.max_by("doc_id", "version").alias("doc_id"))


@query("e23_project_overview")
def e23(spark, sf_dir):
    docs = load(spark, sf_dir, "doc_versions")
    return docs.groupBy("project").agg(F.count("*").alias("versions"), F.max("version").alias("latest"), F.max_by("n_chars", "version").alias("latest_size"), F.sum("n_chars").alias("total_size"))


@query("b13_run_normalisation")
def b13(spark, sf_dir):
    runs = load(spark, sf_dir, "runs")
    runs = runs.withColumn("fired_first", F.col("commit_index") == 0).withColumn("gate_strategy", F.when(F.col("gate_strategy") == "isomorphism", "").otherwise(F.col("gate_strategy")))
    words = F.when(F.col("gate_allowed_llm"), F.lit(" Yes ")).otherwise(F.lit("0"))
    raw = runs.select(
        "project", F.col("commit_id").alias("commit_hash"), F.lit("").alias("commit"), F.col("commit_index").cast("string").alias("commit_index"), "gate_strategy", words.alias("llm_invoked"),
        F.when(F.col("source_touched"), F.col("missed_change").cast("string")).alias("missed_change"), F.lit("maybe").alias("latency_ms"),
        F.col("prompt_tokens").cast("string").alias("prompt_tokens"), F.col("completion_tokens").cast("string").alias("completion_tokens"), F.col("commit_index").alias("ord"),
        F.when(F.col("fired_first"), F.lit("")).otherwise(F.col("divergences").cast("string")).alias("divergences"), "findings_hash", F.lit(" 0.5 ").alias("temperature"), F.lit("7").alias("seed"),
    )
    return tidy(statistics.normalise_runs(raw))


def _called(spark, sf_dir):
    """Run rows in which a model is called for three of four runs that were allowed."""
    called = F.col("gate_allowed_llm") & (F.col("commit_index") % 4 != 0)
    return load(spark, sf_dir, "runs").withColumns({"llm_invoked": called, "similarity_score": F.when(called, 100 - F.col("divergences") % 40).cast("double")})


@query("e03_ledger_metrics")
def e03(spark, sf_dir):
    return tidy(statistics.ledger_metrics(_called(spark, sf_dir)))


@query("e04_by_strategy")
def e04(spark, sf_dir):
    return statistics.by_strategy(_called(spark, sf_dir))


@query("e05_score_variance")
def e05(spark, sf_dir):
    return tidy(statistics.score_variance(load(spark, sf_dir, "runs"), "latency_ms", "project"))


@query("e06_describe_latency")
def e06(spark, sf_dir):
    return tidy(statistics.describe(load(spark, sf_dir, "runs"), "latency_ms", "gate_strategy"))


@query("e08_wilson_intervals")
def e08(spark, sf_dir):
    counts = statistics.gate_counts(load(spark, sf_dir, "runs"), "project")
    low, high = fn.wilson(F.col("skipped"), F.col("runs"))
    return tidy(counts.select("project", "gate_strategy", fn.rate(F.col("skipped"), F.col("runs")).alias("rate"), low.alias("low"), high.alias("high")))


@query("e09_exact_paired_test")
def e09(spark, sf_dir):
    pairs = statistics.pair_gates(load(spark, sf_dir, "runs"), "structural", "isomorphism")
    return tidy(statistics.paired_test(pairs, "project"))


@query("e10_study_table")
def e10(spark, sf_dir):
    return statistics.study_table(load(spark, sf_dir, "runs"))


@query("e11_gate_table")
def e11(spark, sf_dir):
    return tidy(statistics.gate_table(load(spark, sf_dir, "runs")))


@query("e12_baseline_choice")
def e12(spark, sf_dir):
    counts = statistics.gate_counts(load(spark, sf_dir, "runs").where("gate_strategy <> 'always'"))
    return statistics.baseline(counts)


@query("e13_recommendation")
def e13(spark, sf_dir):
    return tidy(statistics.recommend(statistics.gate_table(load(spark, sf_dir, "runs"))))


@query("e14_project_table")
def e14(spark, sf_dir):
    return tidy(statistics.project_table(load(spark, sf_dir, "runs"), "structural"))


def _uneven(spark, sf_dir):
    """Runs of which one project lacks a gate, one was never checked and one has no ``always`` runs."""
    runs = _called(spark, sf_dir).where("NOT (project = 1 AND gate_strategy = 'structural') AND NOT (project = 3 AND gate_strategy = 'always')")
    return runs.withColumn("missed_change", F.when(F.col("project") != 2, F.col("missed_change")))


@query("e14_project_report")
def e14_report(spark, sf_dir):
    runs = _uneven(spark, sf_dir)
    made = statistics.project_report(statistics.gate_counts(runs, "project"), statistics.project_wholes(runs), "structural")
    return tidy(made.withColumn("tokens_saved", F.col("tokens_saved").cast("double")))  # a double in pandas anyway, as it may be NULL


@query("e14_project_agreement")
def e14_agreement(spark, sf_dir):
    return tidy(statistics.project_agreement(e14_report(spark, sf_dir)))


@query("e15_project_gate_cells")
def e15(spark, sf_dir):
    return tidy(statistics.project_gate_cells(load(spark, sf_dir, "runs").where("NOT (project = 1 AND gate_strategy = 'content')")))


@query("e16_configuration")
def e16(spark, sf_dir):
    return statistics.configuration(load(spark, sf_dir, "runs"), "gate_strategy", "completion_tokens", "project")


@query("e16_study_settings")
def e16_settings(spark, sf_dir):
    runs = load(spark, sf_dir, "runs").withColumns(
        {"llm_mode": F.lit("offline"), "provider": F.lit(""), "model": F.when(F.col("project") == 4, "m2").otherwise("m1"), "temperature": F.lit(0.0), "seed": F.when(F.col("commit_index") > 5, "7"), "degraded": F.col("latency_ms") > 400}
    )
    return statistics.study_settings(runs)


@query("e17_confusion_matrix")
def e17(spark, sf_dir):
    runs = load(spark, sf_dir, "runs").withColumns({"fired": F.col("gate_allowed_llm"), "changed": F.col("conformance_changed")})
    return tidy(statistics.confusion(runs, "gate_strategy"))


@query("e17_confused_commits")
def e17_ids(spark, sf_dir):
    runs = load(spark, sf_dir, "runs").withColumns({"fired": F.col("gate_allowed_llm"), "changed": F.col("conformance_changed")})
    return statistics.confused_ids(runs, "commit_id", "gate_strategy")


@query("e19_replay_summary")
def e19(spark, sf_dir):
    return tidy(statistics.replay_summary(load(spark, sf_dir, "runs").withColumn("impact_nodes", F.col("commit_index") % 50)))


@query("e20_spread")
def e20(spark, sf_dir):
    return tidy(statistics.spread(load(spark, sf_dir, "runs"), "latency_ms", "project", "gate_strategy"))


@query("e21_corpus_totals")
def e21(spark, sf_dir):
    return tidy(statistics.corpus_totals(load(spark, sf_dir, "runs")))


@query("e22_design_screening")
def e22(spark, sf_dir):
    design, _ = _sides(spark, sf_dir)
    return design.groupBy("project").agg(F.countDistinct("element").alias("elements"), fn.count_if(F.col("member_kind") == "attribute").alias("attributes"), fn.count_if(F.col("member_kind") == "method").alias("methods"))


def _served(spark, sf_dir):
    return statistics.serve(load(spark, sf_dir, "runs"))


@query("c22_serving_as_of")
def c22(spark, sf_dir):
    return _served(spark, sf_dir).select("project", "gate_strategy", "commit_index", "served_hash", "diverges_from_oracle", "missed_change")


@query("c23_paired_gates")
def c23(spark, sf_dir):
    return statistics.pair_gates(load(spark, sf_dir, "runs"), "content", "structural")


@query("c24_dominance")
def c24(spark, sf_dir):
    return tidy(statistics.dominance(statistics.gate_table(load(spark, sf_dir, "runs"))))


@query("f01_conformance_changed")
def f01(spark, sf_dir):
    return statistics.label_changes(load(spark, sf_dir, "runs").where("gate_strategy = 'always'")).select("project", "commit_index", "changed")


@query("f02_label_inference")
def f02(spark, sf_dir):
    runs = load(spark, sf_dir, "runs")
    gaps = runs.withColumns({"conformance_changed": F.when(F.col("source_touched"), F.col("conformance_changed")), "findings_hash": F.when(F.col("commit_index") % 3 != 0, F.col("findings_hash"))})
    out = statistics.infer_labels(gaps)
    return out.groupBy("project", "gate_strategy").agg(fn.count_if(F.col("filled")).alias("filled"), fn.count_if(F.col("conformance_changed")).alias("changed"), F.count("conformance_changed").alias("labelled"))


@query("f03_trajectories")
def f03(spark, sf_dir):
    return statistics.trajectories(load(spark, sf_dir, "runs"))


@query("f04_drift_direction")
def f04(spark, sf_dir):
    return tidy(statistics.drift_direction(statistics.trajectories(load(spark, sf_dir, "runs"))))


@query("f05_drift_rate")
def f05(spark, sf_dir):
    return tidy(statistics.drift_rate(load(spark, sf_dir, "runs")))


@query("f06_drift_series")
def f06(spark, sf_dir):
    points = statistics.trajectories(load(spark, sf_dir, "runs"))
    many = points.groupBy("project").count().where("count >= 2").select("project")
    return points.join(F.broadcast(many), "project", "left_semi").select("project", "commit_index", (F.col("divergences") + F.col("absences")).alias("drift"))


@query("f07_kaplan_meier")
def f07(spark, sf_dir):
    seen = survival.observations(load(spark, sf_dir, "element_status")).where("NOT at_freeze")
    return tidy(survival.kaplan_meier(seen, "project"))


@query("f08_km_quantile")
def f08(spark, sf_dir):
    seen = survival.observations(load(spark, sf_dir, "element_status")).where("NOT at_freeze")
    return survival.km_quantile(survival.kaplan_meier(seen, "project"), 0.8, "project")


@query("f09_element_survival")
def f09(spark, sf_dir):
    return tidy(survival.element_survival(load(spark, sf_dir, "element_status"), "project"))


@query("f10_pooled_survival")
def f10(spark, sf_dir):
    return tidy(survival.element_survival(load(spark, sf_dir, "element_status")))


@query("f11_recovery_horizons")
def f11(spark, sf_dir):
    return survival.recovery_horizons(_served(spark, sf_dir))


@query("f12_median_horizon")
def f12(spark, sf_dir):
    return survival.median_horizon(survival.recovery_horizons(_served(spark, sf_dir)), "gate_strategy")


@query("f14_run_ordinals")
def f14(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("project", "gate_strategy").orderBy("commit_index")).cast("bigint")
    return load(spark, sf_dir, "runs").select("project", "gate_strategy", "commit_index", place.alias("ordinal"))


@query("c26_mainline_history")
def c26(spark, sf_dir):
    commits = load(spark, sf_dir, "commits")
    tips = commits.groupBy("project").agg(F.max("sha").alias("sha"))
    return history.mainline(commits, tips)


@query("c26_newest_plain_commits")
def c26_plain(spark, sf_dir):
    return history.newest_plain(load(spark, sf_dir, "commits"), 25).select("project", "sha", "place")


@query("c27_diagram_staleness")
def c27(spark, sf_dir):
    return history.diagram_staleness(load(spark, sf_dir, "commit_files")).select("project", "diagram", "last_commit", "stale_commits", "code_files_changed_since", "stale_days", "verdict")


@query("g03_stale_diagrams")
def g03(spark, sf_dir):
    found = history.diagram_staleness(load(spark, sf_dir, "commit_files"))
    return found.where("verdict = 'candidate'").select("project", "diagram", "stale_commits").orderBy(F.desc("stale_commits"), "project", "diagram")


@query("g01_gate_order")
def g01(spark, sf_dir):
    gates = load(spark, sf_dir, "runs").select("gate_strategy").distinct()
    return gates.select("gate_strategy", statistics.gate_rank(F.col("gate_strategy")).cast("bigint").alias("place"))


@query("b02_type_heads")
def b02(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    head = F.substring_index("p_type", " ", 1)
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("List["), head, F.lit("]"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Map<String, "), head, F.lit(">"))).otherwise(F.concat(F.lit("'"), head, F.lit("' | None")))
    return parts.select("p_partkey", fn.type_head(said).alias("head"))


@query("b03_callee_split")
def b03(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    said = F.concat(F.lit("self->"), F.substring_index("p_name", " ", 1), F.when(F.col("p_size") % 2 == 0, F.lit("::save()")).otherwise(F.lit(".9x")))
    return parts.select("p_partkey", fn.callee(said).alias("c")).select("p_partkey", "c.receiver", "c.name")


def _paths(spark, sf_dir):
    return load(spark, sf_dir, "commit_files").select("path").distinct()


@query("b18_module_keys")
def b18(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", F.array_join(fn.module_keys(F.col("path")), ",").alias("keys"))


@query("b19_import_strings")
def b19(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", fn.module_name(F.concat(F.lit('"../'), "path", F.lit('"'))).alias("module"))


@query("h07_languages")
def h07(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", fn.language(F.col("path")).alias("language"), fn.node_id("module", F.col("path")).alias("node"))


@query("b26_staleness_verdicts")
def b26(spark, sf_dir):
    files = load(spark, sf_dir, "commit_files")
    counts = files.groupBy("project", F.weekofyear("committed_on").cast("bigint").alias("week")).agg(F.count("*").alias("stale"), F.countDistinct(F.when(F.endswith("path", F.lit(".py")), F.col("path"))).alias("code"))
    return counts.select("project", "week", statistics.staleness_verdict(F.col("stale"), F.col("code")).alias("verdict"))


@query("b01_field_normalisation")
def b01(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    fields = lines.select(
        F.col("l_orderkey").alias("class"), F.concat(F.lit("f"), (F.col("l_partkey") % 3).cast("string")).alias("name"), F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")).alias("type"), F.col("l_linenumber").alias("pos")
    )
    return tidy(facts.normalise_fields(fields))


@query("b04_call_lists")
def b04(spark, sf_dir):
    sites = load(spark, sf_dir, "call_sites").groupBy("caller").agg(F.array_sort(F.collect_list(F.struct("site", "callee"))).alias("refs"))
    kept, names = facts.cap_calls(F.transform("refs", lambda r: r["callee"]))
    return sites.select("caller", F.size(kept).cast("bigint").alias("kept"), F.array_join(names, ",").alias("calls"))


@query("b20_impact_scope")
def b20(spark, sf_dir):
    known = _paths(spark, sf_dir).withColumnRenamed("path", "file_path")
    hit = load(spark, sf_dir, "commit_files").where("project = 1").select(F.concat(F.lit("class::"), "path", F.lit("::C")).alias("node"))
    return facts.scope(known, hit)


@query("b21_evaluability")
def b21(spark, sf_dir):
    files = load(spark, sf_dir, "commit_files")
    snaps = files.groupBy("project", "committed_on").agg(
        fn.count_if(F.endswith("path", F.lit(".mdj"))).alias("design_elements"), fn.count_if(F.endswith("path", F.lit(".py"))).alias("code_classes"), F.lit(0).alias("parse_errors"), fn.count_if(F.endswith("path", F.lit(".md"))).alias("u")
    )
    snaps = snaps.select("project", "committed_on", "design_elements", "code_classes", "parse_errors", F.when(F.col("u") > 2, 1).otherwise(0).alias("unsupported"), F.lit(50.0).alias("score"))
    return facts.evaluability(snaps).select("project", F.col("committed_on").cast("string").alias("day"), "issues", "score")


@query("b25_output_coercion")
def b25(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    body = F.concat(F.lit('{"score": '), (F.col("p_size") * 3).cast("string"), F.lit(', "gaps": '), F.when(F.col("p_size") % 2 == 0, F.lit('"one"')).otherwise(F.lit('["a", "b"]')), F.lit("}"))
    said = F.when(F.col("p_partkey") % 7 == 0, F.lit("sorry, no")).otherwise(F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```")))
    return facts.coerce_outputs(parts.select("p_partkey", said.alias("response"))).select("p_partkey", "score", "gaps", "readable")


def _responses(spark, sf_dir):
    return responses.read(load(spark, sf_dir, "responses"))


@query("b25_scores")
def b25_scores(spark, sf_dir):
    return responses.scores(_responses(spark, sf_dir), "p_partkey")


@query("b25_texts")
def b25_texts(spark, sf_dir):
    read = _responses(spark, sf_dir)
    each = [responses.texts(read, "p_partkey", f).withColumn("field", F.lit(f)) for f in ("gaps", "recommendations")]
    return tidy(each[0].unionByName(each[1]))


@query("b25_tests")
def b25_tests(spark, sf_dir):
    return tidy(responses.tests(_responses(spark, sf_dir), "p_partkey"))


@query("b25_graph_edges")
def b25_edges(spark, sf_dir):
    return tidy(responses.edges(_responses(spark, sf_dir), "p_partkey"))


@query("b25_graph_nodes")
def b25_nodes(spark, sf_dir):
    return responses.nodes(_responses(spark, sf_dir), "p_partkey")


def _sized_files(spark, sf_dir):
    return load(spark, sf_dir, "commit_files").select("project", "path", (F.col("commit_ord") % 1000).alias("size"))


@query("a14_file_tree")
def a14(spark, sf_dir):
    return files.tree(_sized_files(spark, sf_dir), "project", most=200)


@query("a14_totals")
def a14_totals(spark, sf_dir):
    return files.totals(_sized_files(spark, sf_dir), "project")


@query("e23_overview_with_files")
def e23_files(spark, sf_dir):
    versions = _scored_versions(load(spark, sf_dir, "snap_nodes")).withColumn("created_at", F.concat(F.lit("v"), F.col("version").cast("string")))
    kept = _sized_files(spark, sf_dir).where("project <> 3")
    return tidy(files.overview(versions, kept, kept.where("path LIKE '%.mdj'"), "project"))


def _bases(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(F.col("p_partkey").alias("class"), F.floor(F.col("p_partkey") / 2).alias("base"), F.lit(0).alias("pos")).where("base > 0"), parts


@query("c05_symbol_tables")
def c05(spark, sf_dir):
    _, parts = _bases(spark, sf_dir)
    return parts.groupBy(F.col("p_brand").alias("class"), F.substring_index("p_name", " ", 1).alias("method")).agg(F.min_by("p_partkey", "p_partkey").alias("method_id"), F.count("*").alias("candidates"))


@query("c07_inherited_methods")
def c07(spark, sf_dir):
    bases, parts = _bases(spark, sf_dir)
    methods = parts.where("p_size % 4 = 0").select(F.col("p_partkey").alias("class"), F.concat(F.lit("m"), (F.col("p_size") % 8).cast("string")).alias("name"), F.col("p_partkey").alias("method_id"), F.lit(0).alias("pos"))
    return resolve.inherited_methods(methods, bases)


@query("c08_import_bindings")
def c08(spark, sf_dir):
    modules = _paths(spark, sf_dir).where("path LIKE 'src/%'").select(F.explode(fn.module_keys(F.col("path"))).alias("module"), F.col("path").alias("target"))
    bindings = load(spark, sf_dir, "commit_files").where("path LIKE 'src/%'").select(
        F.concat(F.lit("f"), F.col("project").cast("string")).alias("file"), F.col("commit_ord").alias("pos"), F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".").alias("module"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("alias")
    )
    return resolve.import_targets(bindings, modules)


@query("e18_controlled_tests")
def e18(spark, sf_dir):
    runs = load(spark, sf_dir, "runs").withColumns({"fired": F.col("gate_allowed_llm"), "changed": F.col("conformance_changed"), "kind": F.when(F.col("source_touched"), "touched").otherwise("untouched")})
    return tidy(statistics.confusion(runs, "gate_strategy", "kind"))


@query("a06_active_designs")
def a06(spark, sf_dir):
    return files.active_designs(load(spark, sf_dir, "commit_files"), "project")


@query("a10_merged_results")
def a10(spark, sf_dir):
    runs = load(spark, sf_dir, "runs").select("project", "gate_strategy", "commit_index", "conformance_changed")
    rows, conflicts = files.merge_results([runs.where("project <> 3"), runs.where("project = 3").drop("conformance_changed"), runs.where("project = 2 AND commit_index < 5")])
    return conflicts.groupBy("conflict").agg(F.count("*").alias("n")).unionByName(rows.agg(F.count("*").alias("n")).withColumn("conflict", F.lit("rows")))


@query("a10_merged_elements")
def a10_elements(spark, sf_dir):
    rows = load(spark, sf_dir, "element_status")
    early, late = rows.where("commit_index < 6"), rows.where("commit_index > 3")
    return tidy(files.merge_elements([early, late.withColumn("status", F.upper("status"))]))


@query("a13_report_tables")
def a13(spark, sf_dir):
    where = f"{lineage.folder(spark)}/{uuid.uuid4().hex}"
    made = report.tables(_called(spark, sf_dir).withColumn("seed", F.lit("7")))
    files.write_report(made, where)
    rows = [files.read_csv(spark, f"{where}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name in made]
    return reduce(DataFrame.unionByName, rows)


@query("a13_report_projects")
def a13_projects(spark, sf_dir):
    made = report.tables(_called(spark, sf_dir))["table3-per-project"]
    return tidy(made)


@query("a15_changed_files")
def a15(spark, sf_dir):
    each = load(spark, sf_dir, "commit_files").groupBy("project", "committed_on").agg(F.collect_set("path").alias("paths"))
    nothing = F.array().cast("array<string>")
    commit = F.array(F.struct(F.filter("paths", lambda p: F.startswith(p, F.lit("src/"))).alias("added"), nothing.alias("modified"), F.filter("paths", lambda p: F.startswith(p, F.lit("docs/"))).alias("removed")))
    return files.changed_files(each.select(F.lit("push").alias("event"), "project", commit.alias("commits")))


def _streamed(spark, sf_dir, table, build, mode):
    """The result of a streaming query over a table's files, run to the end and read back."""
    where = f"{lineage.folder(spark)}/{uuid.uuid4().hex}"
    kind = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    stream = build(spark.readStream.schema(kind).parquet(f"{sf_dir}/{table}.parque*"))

    def write(batch, _):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{where}/out")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/out")


@query("i01_streaming_gate")
def i01(spark, sf_dir):
    def build(docs):
        bare = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("")), F.lit(" "), F.lit(""))
        snaps = docs.select(F.col("source").alias("project"), F.col("doc_id").alias("version"), F.sha2("text", 256).alias("text_hash"), F.sha2(bare, 256).alias("structure_hash"), F.lit("d").alias("design_hash"))
        return jobs.stream_gate(snaps)

    return _streamed(spark, sf_dir, "documents", build, "append")


@query("i04_incremental_runs")
def i04(spark, sf_dir):
    store, where = _store(spark), f"{lineage.folder(spark)}/{uuid.uuid4().hex}"
    rows = lineage.cut(jobs.as_rows(**_whole_snapshots(spark, sf_dir)))
    for some in ("version < 0", "version BETWEEN -1 AND 0", "version IN (1, 2)", "version > 2"):  # -1 comes again, too late
        rows.where(some).write.mode("append").parquet(where)  # what has come since the last run, in however many files, is one batch
        stream = spark.readStream.schema(rows.schema).parquet(where)
        stream.writeStream.foreachBatch(jobs.into_store(store)).option("checkpointLocation", f"{where}-state").trigger(availableNow=True).start().awaitTermination()
    return store.runs().select("project", "version", "gate_strategy", "gate_allowed_llm", "decision", "reason", *replay.DELTAS, "impact_nodes")


@query("i02_streaming_metrics")
def i02(spark, sf_dir):
    def build(events):
        runs = events.select((F.col("user_id") % 5).alias("project"), F.col("event_type").alias("gate_strategy"), (F.col("value") > 20).alias("gate_allowed_llm"), F.floor("value").alias("prompt_tokens"), F.lit(1).alias("completion_tokens"))
        return jobs.stream_metrics(runs)

    return _streamed(spark, sf_dir, "events", build, "complete")


@query("i03_streaming_changed_files")
def i03(spark, sf_dir):
    def build(events):
        path = F.concat(F.lit("src/"), F.col("user_id").cast("string"), F.lit(".py"))
        commit = F.array(F.struct(F.array(path).alias("added"), F.array().cast("array<string>").alias("modified"), F.array().cast("array<string>").alias("removed")))
        kind = F.when(F.col("event_type") == "view", "ping").otherwise("push")
        return jobs.stream_changed_files(events.select(kind.alias("event"), (F.col("user_id") % 5).alias("project"), commit.alias("commits")))

    return _streamed(spark, sf_dir, "events", build, "append")
