"""Gate decisions with deltas and shapes, replay against a full analysis, labelled deviations, run rows."""

from plumbline.operators import gate, replay

SNAPS = "project string, version long, text_hash string, structure_hash string, design_hash string, delta_size long, isomorphic boolean, divergences long, absences long"
HISTORY = [
    ("p", 0, "a", "s", "d", None, None, 1, 0),
    ("p", 2, "b", "s", "d", 0, None, 1, 0),  # text only
    ("p", 3, "b", "s", "d", 2, True, 2, 0),  # a delta alone changes the structure; same shape
    ("p", 5, "b", "t", "d", 0, None, 2, None),  # not decided counts as not alike
    ("p", 6, "b", "t", "e", 0, True, 2, None),  # design
    ("q", 0, None, None, None, None, None, None, None),
    ("q", 1, None, None, None, None, None, None, None),
]


def test_policies_differ_where_the_shape_is_kept(spark):
    rows = {(r.project, r.version, r.gate_strategy): (r.fired, r.reason) for r in gate.decide(spark.createDataFrame(HISTORY, SNAPS)).collect()}
    assert len(rows) == 28
    assert [rows["p", v, "structural"][0] for v in (0, 2, 3, 5, 6)] == [True, False, True, True, True]
    assert [rows["p", v, "isomorphism"][0] for v in (0, 2, 3, 5, 6)] == [True, False, False, True, True]
    assert [rows["p", v, "content"][0] for v in (0, 2, 3, 5, 6)] == [True, True, False, False, True]
    assert rows["p", 3, "isomorphism"][1] == "same shape" and rows["p", 6, "content"][1] == "design changed"
    assert rows["q", 0, "always"] == (True, "first version") and not rows["q", 1, "content"][0]


def test_replay_serves_the_last_run_that_fired(spark):
    out = replay.replay(spark.createDataFrame(HISTORY, SNAPS), ("divergences", "absences"))
    rows = {(r.project, r.version, r.gate_strategy): r for r in out.collect()}
    miss = rows["p", 3, "isomorphism"]
    assert miss.missed_change and miss.diverges_from_oracle and miss.differing_fields == "divergences"
    assert not rows["p", 5, "isomorphism"].diverges_from_oracle
    assert rows["p", 5, "content"].differing_fields == "divergences,absences"
    first = rows["p", 0, "structural"]
    assert first.conformance_changed is None and first.source_touched is None and not first.missed_change
    assert rows["p", 2, "always"].source_touched and not rows["p", 2, "always"].conformance_changed
    assert rows["p", 5, "always"].conformance_changed and not rows["p", 5, "always"].source_touched
    assert rows["q", 1, "content"].conformance_changed is False
    assert {(r.version, r.gate_strategy) for r in replay.misses(out).collect()} == {(3, "isomorphism"), (3, "content"), (5, "content")}
    assert replay.replay(spark.createDataFrame([], SNAPS), ("divergences", "absences")).count() == 0


def test_labelled_deviations(spark):
    kind = "mutation string, category string, version long, expect_structural_change boolean, text_hash string, structure_hash string, isomorphic boolean, divergences long"
    rows = [("rename", "x", 0, True, "a", "s", None, 0), ("rename", "x", 1, True, "b", "t", True, 1), ("comment", "y", 0, False, "a", "s", None, 0), ("comment", "y", 1, False, "b", "s", None, 0)]
    out = {(r.mutation, r.gate_strategy): r for r in replay.evaluate_mutations(spark.createDataFrame(rows, kind), ("divergences",)).collect()}
    assert len(out) == 8
    assert out["rename", "isomorphism"].missed_change and not out["rename", "structural"].missed_change
    assert out["comment", "content"].wasted_reanalysis and not out["comment", "structural"].wasted_reanalysis
    assert out["rename", "structural"].changed_fields == "divergences" and out["rename", "structural"].gate_correct_on_structure
    assert not out["comment", "content"].gate_correct_on_structure


def test_run_rows(spark):
    nodes = spark.createDataFrame([("p", 0, n, "class", "1") for n in "abcd"] + [("p", 1, n, "class", "2" if n == "a" else "1") for n in "abc"], "project string, version long, node string, kind string, signature string")
    edges = spark.createDataFrame([("p", v, "a", "b", "calls") for v in (0, 1)], "project string, version long, src string, dst string, relation string")
    snaps = spark.createDataFrame([("p", 0, "x", "s", 10), ("p", 1, "x", "s", 20)], "project string, version long, text_hash string, structure_hash string, tokens long")
    rows = {(r.version, r.gate_strategy): r for r in replay.run_rows(snaps, nodes, edges, {"seed": 7}).collect()}
    assert (rows[0, "content"].added_nodes, rows[0, "content"].impact_nodes, rows[0, "content"].prompt_tokens) == (4, 4, 10)
    one = rows[1, "structural"]
    assert (one.added_nodes, one.removed_nodes, one.changed_nodes, one.impact_nodes, one.prompt_tokens, one.seed) == (0, 1, 1, 2, 20, 7)
    assert (rows[1, "content"].decision, rows[1, "content"].impact_nodes, rows[1, "content"].prompt_tokens) == ("reuse", 0, 0)
    assert rows[1, "always"].impact_nodes == 3
