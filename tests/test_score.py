"""Score with relations and associations, findings of every kind, hashes in two steps, code as a design."""

from plumbline.operators import compare, gate


def _pairs(spark):
    elements = spark.createDataFrame([("p", "A", "matched"), ("p", "B", "missing")], "project string, element string, state string")
    members = spark.createDataFrame([("p", "A", "method", "m", "matched")], "project string, element string, member_kind string, member string, state string")
    relations = spark.createDataFrame([("p", "A", "B", "generalization", True), ("p", "A", "C", "realization", False)], "project string, source string, target string, relation string, satisfied boolean")
    associations = spark.createDataFrame([("p", "A", t, e) for t, e in (("X", "strong"), ("Y", "weak"), ("Z", "none"))], "project string, source string, target string, evidence string")
    return elements, members, relations, associations


def test_weak_evidence_is_half_a_check(spark):
    elements, members, relations, associations = _pairs(spark)
    row = compare.conformance_score(elements, members, "project", relations=compare.relation_credits(relations, associations, "project")).collect()[0]
    assert (row.checks_total, row.checks_passed, row.score) == (8, 4.5, 56.25)
    row = compare.conformance_score(elements, members, "project", relations=compare.relation_credits(relations, associations, "project", score_associations=False)).collect()[0]
    assert (row.checks_total, row.checks_passed, row.score) == (5, 3.0, 60.0)


def test_evidence_takes_the_last_part_of_a_type(spark):
    associations = spark.createDataFrame([("A", t) for t in ("Desk", "Lamp", "Pen", "Rug")] + [("Gone", "Desk")], "source string, target string")
    fields = spark.createDataFrame([("A", 1, "x", "office.Desk"), ("A", 2, "pens", None), ("A", 3, "y", "Lamp.Other")], "element string, pos long, name string, type string")
    uses = spark.createDataFrame([("A", 1, "return", 0, "a.b.Lamp"), ("A", 0, "instantiation", 0, "Lamp"), ("A", 5, "instantiation", 0, "a.Rug")], "element string, pos long, kind string, ref_pos long, type string")
    elements = spark.createDataFrame([("A",)], "element string")
    out = {(r.source, r.target): r.evidence for r in compare.association_evidence(associations, fields, uses, elements).collect()}
    assert out == {("A", "Desk"): "strong", ("A", "Lamp"): "weak", ("A", "Pen"): "weak", ("A", "Rug"): "none", ("Gone", "Desk"): "none"}


def test_a_change_of_relations_alone_moves_the_fingerprint(spark):
    elements, members, relations, associations = _pairs(spark)
    violations = spark.createDataFrame([("p", "r", "f.py")], "project string, rule string, file_path string")
    some = [{}, {"relations": relations}, {"relations": relations, "associations": associations}, {"relations": relations, "associations": associations, "violations": violations}]
    prints = [compare.findings_fingerprint(compare.finding_keys(elements, members, "project", **k), "project").collect()[0].fingerprint for k in some]
    assert len(set(prints)) == 4 and all(len(p) == 16 for p in prints)
    keys = compare.finding_keys(elements, members, "project", **some[-1])
    assert compare.findings_fingerprint(keys.union(keys).repartition(5), "project").collect()[0].fingerprint == prints[-1]


def test_roll_up_does_not_depend_on_order_but_on_content(spark):
    rows = [("s", f"f{i}", str(i)) for i in range(3000)]
    kind = "project string, path string, hash string"
    one = gate.roll_up(spark.createDataFrame(rows, kind), "project").collect()[0].tree_hash
    assert gate.roll_up(spark.createDataFrame(rows[::-1], kind).repartition(7), "project").collect()[0].tree_hash == one
    assert gate.roll_up(spark.createDataFrame(rows[:-1] + [("s", "f2999", "x")], kind), "project").collect()[0].tree_hash != one
    assert gate.roll_up(spark.createDataFrame([("s", None, None)], kind), "project").count() == 1
    assert gate.roll_up(spark.createDataFrame([], kind), "project").count() == 0


def test_code_as_design(spark):
    classes = spark.createDataFrame([("A", "class"), ("I", "interface"), ("E", "enum")], "class string, kind string")
    fields = spark.createDataFrame([("A", "x", None), ("A", "y", "int"), ("E", "z", "")], "class string, name string, type string")
    methods = spark.createDataFrame([("I", "run", None), ("I", "get", "str")], "class string, name string, returns string")
    elements, members = compare.project_code(classes, fields, methods)
    assert {tuple(r) for r in elements.collect()} == {("A", "class"), ("I", "interface"), ("E", "class")}
    assert {(r.member, r.member_kind, r.type) for r in members.collect()} == {("x", "attribute", "Object"), ("y", "attribute", "int"), ("z", "attribute", "Object"), ("run", "method", "void"), ("get", "method", "str")}
