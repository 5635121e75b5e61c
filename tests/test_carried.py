"""Names along reused versions, responses, trees, reports, rounding, layers, ledgers: small cases with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import columns as fn
from plumbline.operators import compare, graph, history, relabel, report, responses, statistics
from plumbline.sources import files


def test_three_renames_in_a_row_give_the_final_names(spark):
    versions = spark.createDataFrame([("p", v) for v in (0, 1, 2, 4, 7, 9)], "project string, version long")
    renames = spark.createDataFrame([("p", 1, "A", "B"), ("p", 2, "B", "C"), ("p", 4, "C", "D"), ("p", 9, "D", "E"), ("p", 2, "X", "Y")], "project string, version long, node string, new_node string")
    gaps = spark.createDataFrame([("p", 0, "A", "g1"), ("p", 0, "X", "g2"), ("p", 0, "S", "g3"), ("p", 7, "D", "g4")], "project string, version long, node string, gap string")
    kind = "project string, version long, gate_strategy string, fired boolean, served_version long, reused_from long"
    reused = spark.createDataFrame([("p", 0, "i", True, 0, None), ("p", 1, "i", False, 0, 0), ("p", 2, "i", False, 0, 1), ("p", 4, "i", False, 0, 2), ("p", 7, "i", True, 7, None), ("p", 9, "i", False, 7, 7), ("p", 9, "j", False, 0, 7)], kind)
    out = relabel.carried(reused, renames, gaps, versions)
    got = {(r.gate_strategy, r.version, r.node): r.name for r in out.collect()}
    assert [got["i", v, "A"] for v in (1, 2, 4)] == ["B", "C", "D"] and got["j", 9, "A"] == "E" and got["i", 9, "D"] == "E"
    assert [got["i", v, "X"] for v in (1, 2, 4)] == ["X", "Y", "Y"] and got["j", 9, "S"] == "S" and len(got) == 13
    assert {(r.gate_strategy, r.version): (r.gaps, r.relabelled) for r in relabel.relabelled(out).collect()}["i", 2] == (3, 2)
    assert relabel.carried(reused.limit(0), renames, gaps, versions).count() == 0


def test_responses_of_every_shape(spark):
    said = {
        1: '```json\n{"similarity_score": "85.5", "gaps": "one", "recommendations": ["a", 7, {"x": 1}]}\n```',
        2: 'Well: {"similarity_score": 120, "gaps": null, "semantic_graph": {"nodes": ["N", {"id": "M", "type": "class"}, {"type": "x"}, {"id": ""}], "edges": [{"source": "N", "target": "Q"}, {"source": "Q", "target": ""}, 5]}} bye',
        3: "no braces", 4: None, 5: '{"similarity_score": "high", "unit_tests": {"code": "x", "framework": "f"}}', 6: '["not", "an object"]', 7: '{"broken": ', 8: '{"similarity_score": -3, "semantic_graph": "none"}',
        9: '{"similarity_score": 2.5}',
    }
    read = responses.read(spark.createDataFrame(list(said.items()), "k int, response string"))
    assert {r.k: (r.readable, r.score) for r in responses.scores(read, "k").collect()} == {
        1: (True, 86), 2: (True, 100), 3: (False, None), 4: (False, None), 5: (True, 0), 6: (False, None), 7: (False, None), 8: (True, 0), 9: (True, 2),
    }
    assert [(r.k, r.text) for r in responses.texts(read, "k", "gaps").collect()] == [(1, "one")]
    assert [(r.place, r.text) for r in responses.texts(read, "k", "recommendations").orderBy("place").collect()] == [(0, "a"), (1, "7"), (2, '{"x":1}')]
    assert [tuple(r) for r in responses.edges(read, "k").collect()] == [(2, 0, "N", "Q", "depends_on")]
    assert sorted((r.id, r.type) for r in responses.nodes(read, "k").collect()) == [("M", "class"), ("N", "unknown"), ("Q", "inferred")]
    assert [(r.k, r.target_file, r.framework, r.code) for r in responses.tests(read, "k").collect()] == [(5, "unknown", "f", "x")]


def test_two_places_round_as_the_binary_value(spark):
    rng = random.Random(3)
    values = [rng.uniform(-1000, 1000) for _ in range(50_000)] + [rng.randint(-100_000, 100_000) / 8 for _ in range(20_000)] + [round(rng.uniform(0, 100), 3) for _ in range(30_000)]
    values += [2.675, 1.005, 0.125, 0.375, -2.675, 0.0, -0.0, 1e15, 1e300, 5e-324, 0.005, 0.015, 4503599627370497.5, float("inf"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(fn.round2(F.col("x"))).collect()]
    assert got == [None if v is None else v if abs(v) == float("inf") else round(v, 2) for v in values]


def test_relations_of_one_pair_are_checks_of_their_own(spark):
    associations = spark.createDataFrame([("O", "R", "association"), ("O", "R", "dependency"), ("O", "R", "dependency")], "source string, target string, relation string")
    fields = spark.createDataFrame([("O", 0, "r", "R")], "element string, pos int, name string, type string")
    calls = spark.createDataFrame([], "element string, pos int, kind string, ref_pos int, type string")
    out = compare.association_evidence(associations, fields, calls, spark.createDataFrame([("O",)], "element string"))
    assert sorted((r.relation, r.evidence) for r in out.collect()) == [("association", "strong"), ("dependency", "strong"), ("dependency", "strong")]
    elements = spark.createDataFrame([("p", "O", "matched"), ("p", "M", "missing")], "project string, element string, state string")
    members = spark.createDataFrame([("p", "O", "method", "run", "extra"), ("p", "O", "method", "go", "missing"), ("p", "O", "attribute", "x", "missing")], "project string, element string, member_kind string, member string, state string")
    relations = spark.createDataFrame([("p", "O", "B", "generalization", True), ("p", "O", "C", "realization", False)], "project string, source string, target string, relation string, satisfied boolean")
    weak = spark.createDataFrame([("p", "O", "R", "association", "weak"), ("p", "O", "S", "dependency", "none")], "project string, source string, target string, relation string, evidence string")
    r = compare.reflexion_with_relations(elements, members, relations, weak, "project", score_associations=True).first()
    assert (r.divergences, r.absences, r.convergences, r.checks_total) == (1, 5, 4, 8)  # 2.5 checks passed and two relations held
    gaps = {x.gap for x in compare.gap_sentences(elements, members, "project", relations=relations, associations=weak).collect()}
    assert len(gaps) == 5 and "O.go() is designed but not implemented." in gaps and "Relationship not implemented: O --realization--> C" in gaps and not any("run" in g for g in gaps)
    advice = [x.place for x in compare.recommendations(elements, members, "project", associations=weak).orderBy("place").collect()]
    assert advice == [0, 2]
    assert [x.place for x in compare.recommendations(elements.where("state = 'matched'"), members, "project").collect()] == [3]


def test_layers_by_name_and_hubs_by_kind(spark):
    nodes = spark.createDataFrame([("p", n, k) for n, k in (("OrderController", "class"), ("OrderRepository", "class"), ("Helper", "class"), ("Deep", "class"), ("m", "method"))], "project string, node string, kind string")
    edges = spark.createDataFrame([("p", "OrderRepository", "Helper", "calls"), ("p", "Helper", "Deep", "calls"), ("p", "Helper", "OrderController", "calls"), ("p", "m", "Deep", "calls")], "project string, src string, dst string, relation string")
    assert {r.node: r.layer for r in graph.layers(edges, nodes, "project").collect()} == {"OrderController": 0, "m": 0, "OrderRepository": 1, "Helper": 2, "Deep": 3}
    kept = graph.hubs(nodes, edges, 3, "project")
    assert [(r.node, r.degree) for r in kept.orderBy("place").collect()] == [("Helper", 3), ("Deep", 2), ("OrderController", 1)]
    assert {(r.src, r.dst) for r in graph.induced(edges, kept, "project").collect()} == {("Helper", "Deep"), ("Helper", "OrderController")}
    only = nodes.where("kind = 'method'")
    assert [r.node for r in graph.hubs(only, edges, 5, "project").collect()] == ["m"]


def test_ledger_tells_allowed_from_called(spark):
    kind = "project string, gate_strategy string, gate_allowed_llm boolean, llm_invoked boolean, prompt_tokens long, completion_tokens long, latency_ms double, similarity_score double"
    runs = spark.createDataFrame([("p", "a", True, True, 100, 10, 50.0, 80.0), ("p", "a", True, False, 0, 0, 2.0, 90.0), ("p", "b", False, False, 0, 0, 4.0, None), ("p", None, False, False, None, None, None, None)], kind)
    r = statistics.ledger_metrics(runs).first()
    assert (r.total_runs, r.reanalyses, r.llm_calls, r.cached_runs, r.cache_hit_rate) == (4, 2, 1, 2, 0.5)
    assert (r.baseline_total_tokens, r.tokens_saved, r.mean_latency_ms_llm, r.mean_latency_ms_cached, r.latency_saved_ms) == (440, 330, 50.0, 2.0, 96.0)
    assert r.score_variance == 25.0 and r.actual_cost_usd == pytest.approx((100 * 5 + 10 * 15) / 1e6)
    assert {x.gate_strategy: (x.runs, x.reanalyses, x.llm_calls) for x in statistics.by_strategy(runs).collect()} == {"a": (2, 2, 1), "b": (1, 0, 0), "unknown": (1, 0, 0)}
    raw = spark.createDataFrame([(None, "", "maybe", "x", None, "true", 0), ("q", None, " TRUE ", "3.0", "", None, 1)], "project string, gate_strategy string, missed_change string, latency_ms string, gate_allowed_llm string, llm_invoked string, ord int")
    got = {x.project: x for x in statistics.normalise_runs(raw).collect()}
    assert len(got["q"]) == 26 and (got["project"].gate_strategy, got["project"].latency_ms, got["project"].gate_allowed_llm, got["project"].missed_change) == ("unknown", 0.0, True, False)
    assert (got["q"].gate_allowed_llm, got["q"].missed_change, got["q"].latency_ms, got["q"].commit, got["q"].commit_index) == (False, True, 3.0, "run-1", 0)


def test_trees_and_overview(spark):
    table = spark.createDataFrame([("p", "src/a/x.py", 5), ("p", "src/y.py", 7), ("p", "z.md", 1), ("q", "model/d.mdj", 2)], "project string, path string, size long")
    rows = [(r.path, r.type, r.size, r.files) for r in files.tree(table, "project").where("project = 'p'").orderBy("place").collect()]
    assert rows == [("src", "tree", 12, 2), ("z.md", "blob", 1, 1), ("src/a", "tree", 5, 1), ("src/y.py", "blob", 7, 1), ("src/a/x.py", "blob", 5, 1)]
    assert [r.path for r in files.tree(table, "project", most=2).where("project = 'p'").orderBy("place").collect()] == ["src", "z.md"]
    versions = spark.createDataFrame([("p", 1, 50.0, "t1"), ("p", 2, None, "t2"), ("r", 1, 9.0, "t")], "project string, version long, score double, created_at string")
    got = {r.project: tuple(r)[1:] for r in files.overview(versions, table, table.where("path LIKE '%.mdj'"), "project").collect()}
    assert got == {"p": (2, 2, None, "t2", 3, 2, 13, False), "q": (0, None, None, None, 1, 1, 2, True), "r": (1, 1, 9.0, "t", 0, 0, 0, False)}


def test_staleness_in_one_sweep(spark):
    rows = [("p", 1, "d.mdj"), ("p", 1, "a.py"), ("p", 2, "a.py"), ("p", 3, "b.py"), ("p", 3, "c.md"), ("p", 4, "e.mdj"), ("p", 5, "a.py"), ("q", 9, "x.mdj")]
    table = spark.createDataFrame([(p, o, f"2024-01-{o:02}", f) for p, o, f in rows], "project string, commit_ord long, committed_on string, path string").withColumn("committed_on", F.to_date("committed_on"))
    got = {(r.project, r.diagram): (r.stale_commits, r.code_files_changed_since, r.stale_days) for r in history.diagram_staleness(table).collect()}
    assert got == {("p", "d.mdj"): (4, 2, 4), ("p", "e.mdj"): (1, 1, 1), ("q", "x.mdj"): (0, 0, 0)}


def test_report_tables_agree_with_their_operators(spark, sf_dir, tmp_path):
    from plumbline.sources.bridge import load

    runs = load(spark, sf_dir, "runs")
    made = report.tables(runs)
    assert tuple(made) == report.TABLES
    pooled = {r.gate_strategy: r for r in statistics.gate_table(runs).collect()}
    for r in made["table2-gate-performance"].collect():
        assert (r.runs, r.missed, r.tokens, r.recall_rate) == tuple(pooled[r.gate_strategy][c] for c in ("runs", "missed", "tokens", "recall_rate"))
    cells = {(r.project, r.gate_strategy): (r.runs, r.skipped, r.missed) for r in statistics.project_gate_cells(runs).collect()}
    assert {(r.project, r.gate): (r.runs, r.skipped, r.missed) for r in made["table3b-per-project-per-gate"].collect()} == cells
    files.write_report(made, str(tmp_path))
    assert files.read_csv(spark, str(tmp_path / "raw-runs")).count() == runs.count()
    nothing = report.tables(runs.where("gate_strategy = 'always'"))
    assert nothing["table3-per-project"].count() == 5
