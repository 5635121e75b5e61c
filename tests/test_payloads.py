"""Sizes of what an analysis is sent, merged element rows, the per-project report, and call lists of declarations."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import facts, statistics
from plumbline.sources import files


def _tokens(records):
    return max(1, len(json.dumps({"files": records}, separators=(",", ":"))) // 4)


def test_payloads_are_whole_scoped_or_nothing(spark):
    kept = {"a.py": {"path": "a.py", "names": ["A", "B"]}, "b.py": {"path": "b.py", "names": []}, "c.py": {"path": "c.py", "names": ["Long" * 30]}}
    rows = [("p", v, f, (r["path"], r["names"])) for v in range(5) for f, r in kept.items()]
    records = spark.createDataFrame(rows, "project string, version long, file_path string, record struct<path:string,names:array<string>>")
    impact = spark.createDataFrame([("p", 0, "class::a.py::A"), ("p", 2, "class::c.py::L"), ("p", 2, "method::a.py::A::m"), ("p", 3, "nowhere")], "project string, version long, node string")
    fired = [("p", 0, None, True), ("p", 1, 0, True), ("p", 2, 1, True), ("p", 3, 2, True), ("p", 4, 3, False), ("q", 0, None, True)]
    decisions = spark.createDataFrame(fired, "project string, version long, previous long, fired boolean")
    got = {(r.project, r.version): (r.scoped, r.tokens) for r in facts.payload_tokens(decisions, records, impact, "project", "version").collect()}
    whole = _tokens(list(kept.values()))
    assert got == {
        ("p", 0): (False, whole), ("p", 1): (False, whole), ("p", 2): (True, _tokens([kept["a.py"], kept["c.py"]])),
        ("p", 3): (True, _tokens([])), ("p", 4): (False, 0), ("q", 0): (False, _tokens([])),
    }


def test_representation_saving(spark):
    texts = {"a.py": "class A:\n    pass\n" * 40, "b.py": "", "c.py": "x = 1"}
    sources = spark.createDataFrame([("p", len(t)) for t in texts.values()] + [("q", None)], "project string, chars long")
    records = spark.createDataFrame([("p", (f, ["A"])) for f in texts], "project string, record struct<path:string,names:array<string>>")
    got = {r.project: r for r in facts.representation_saving(sources, records, "project").collect()}
    raw, said = len("\n".join(texts.values())) // 4, _tokens([{"path": f, "names": ["A"]} for f in texts])
    assert (got["p"].files, got["p"].raw_tokens, got["p"].fact_tokens, got["p"].saving) == (3, raw, said, round((1 - said / raw) * 100, 2))
    assert (got["q"].files, got["q"].raw_tokens, got["q"].fact_tokens, got["q"].saving) == (0, 1, 3, -200.0)


def test_element_rows_merge_once(spark):
    schema = "project string, commit_index long, element string, status string"
    one = spark.createDataFrame([("p", 0, "A", "absent"), ("p", 0, "A", "conforming"), ("p", 1, "A", None)], schema)
    two = spark.createDataFrame([("p", 0, "A", "aaa"), ("p", 1, "B", "absent"), (None, 1, "B", "absent")], schema).withColumn("note", F.lit("n"))
    got = {tuple(r) for r in files.merge_elements([one, two]).select("project", "commit_index", "element", "status", "note").collect()}
    assert got == {("p", 0, "A", "absent", None), ("p", 1, "A", None, None), ("p", 1, "B", "absent", "n"), (None, 1, "B", "absent", "n")}


RUNS = "project string, commit_id string, commit_index long, gate_strategy string, gate_allowed_llm boolean, missed_change boolean, tokens long, similarity_score double, divergences long, absences long"


def _runs(spark, *rows):
    table = spark.createDataFrame(rows, RUNS)
    return table.withColumns({"prompt_tokens": F.col("tokens"), "completion_tokens": F.lit(0), "latency_ms": F.lit(1.0), "conformance_changed": F.lit(False)})


def test_project_report(spark):
    runs = _runs(
        spark,
        ("p", "1", 0, "always", True, False, 100, 90.0, 1, 0), ("p", "2", 1, "always", True, False, 100, 80.0, 2, 3),
        ("p", "1", 0, "structural", True, False, 60, 70.0, 1, 0), ("p", "2", 1, "structural", False, True, 0, None, 2, 3),
        ("q", "7", 0, "content", False, None, 0, None, None, None), ("q", "8", 4, "content", True, None, 9, None, None, 2),
    )
    made = statistics.project_report(statistics.gate_counts(runs, "project"), statistics.project_wholes(runs), "structural")
    got = {r.project: r.asDict() for r in made.collect()}
    p, q = got["p"], got["q"]
    assert (p["commits"], p["runs"], p["skipped"], p["skip_rate"], p["missed"], p["tokens_saved"]) == (2, 2, 1, 0.5, 1, 140)
    assert p["median_similarity"] == 80.0 and p["drift_per_commit"] == pytest.approx(4.0)  # of all the project's runs, not only the gate's
    assert p["gate_ranking"] == "structural > always > content" and p["best_gate"] == "structural"
    assert (q["runs"], q["skipped"], q["missed"], q["tokens_saved"], q["median_similarity"], q["drift_per_commit"]) == (2, 1, None, None, None, None)  # lacks the gate: over all its runs
    assert q["gate_ranking"] == "content > always > structural" and not q["enough_runs"]
    agreed = statistics.project_agreement(made).first()
    assert (agreed.consistent_ranking, agreed.lowest_skip_rate, agreed.highest_skip_rate, agreed.projects) == (False, 0.5, 0.5, 2)
    none = statistics.project_agreement(made.limit(0)).first()
    assert (none.consistent_ranking, none.lowest_skip_rate, none.projects) == (False, None, 0)


def test_calls_of_a_declaration_are_its_own():
    code = "def outer():\n    a()\n    def inner():\n        hidden()\n    class K:\n        x = unseen()\n    b()\n" + "def many():\n" + "".join(f"    f{i:03}()\n" for i in range(100))
    outer, many = sorted(files.python_facts("m.py", code.encode())["functions"], key=lambda f: f["name"], reverse=True)
    assert outer["calls"] == ["a", "b"] and [r["name"] for r in outer["call_refs"]] == ["a", "b"]
    assert len(many["call_refs"]) == 96 and many["calls"] == [f"f{i:03}" for i in range(96)]


def test_local_types_keep_the_first_binding():
    code = "def f():\n    r = Repo()\n    r = Other()\n    n: int = 1\n    q: Queue = make()\n    def g():\n        h = Hidden()\n"
    assert files.python_facts("m.py", code.encode())["functions"][0]["local_types"] == {"r": "Repo", "q": "Queue"}
