"""Findings of versions: the code's elements are read once, members and the design meet in one shuffle."""

from plumbline.operators import findings

M = "element string, member_kind string, member string"


def test_findings_from_elements_at_hand(spark):
    design = spark.createDataFrame([("p", "A", "method", "m"), ("p", "A", "attribute", "x"), ("p", "B", None, None), ("p", "C", "method", "k")], f"project string, {M}")
    code = spark.createDataFrame([("p", 1, "A", "method", "m"), ("p", 1, "D", None, None), ("p", 2, "A", "method", "n"), ("p", 2, "B", "method", "B"), ("p", 3, "C", "method", "k")], f"project string, version long, {M}")
    versions = code.select("project", "version").distinct()
    there = findings.present(code, versions)
    made = findings.over_versions(design, code, versions, there)
    found = {(r.kind, r.element, r.member, r.valid_from, r.valid_to) for r in made.collect()}
    assert found == {
        ("extra_class", "D", None, 1, 2), ("missing_class", "A", None, 3, None), ("missing_class", "B", None, 1, 2), ("missing_class", "B", None, 3, None), ("missing_class", "C", None, 1, 3),
        ("missing_member", "A", "x", 1, 3), ("missing_member", "A", "m", 2, 3), ("extra_member", "A", "n", 2, 3),
    }
    rows = findings.per_version(made, design, None, versions, there)
    assert {r.version: (r.n_missing_class, r.n_extra_class, r.n_missing_member, r.n_extra_member, r.checks_total) for r in rows.collect()} == {1: (2, 1, 1, 0, 5), 2: (1, 0, 2, 1, 5), 3: (2, 0, 0, 0, 4)}
