"""Findings by delta against a full comparison of every version."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import compare, findings, replay

DESIGN, CODE = "project string, element string, member_kind string, member string", "project string, version long, element string, member_kind string, member string"


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(12)
    design = [(p, e, k, m) for p in "pq" for e in "ABC" for k, m in (("attribute", "x"), ("method", "run"), ("method", "stop")) if rng.random() < 0.8] + [("p", "Bare", None, None)]
    code = []
    for p in "pq":
        for version in (2, 3, 5, 8, 9):
            for e in ("A", "B", "C", "Z", "Bare"):
                if rng.random() < 0.7:
                    code.append((p, version, e, None, None))
                    code += [(p, version, e, k, m) for k, m in (("attribute", "x"), ("attribute", "y"), ("method", "run"), ("method", "__init__"), ("method", e), ("method", "stop")) if rng.random() < 0.5]
    versions = spark.createDataFrame([(p, v) for p in "pq" for v in (2, 3, 5, 8, 9)], "project string, version long")
    return spark.createDataFrame(design, DESIGN), spark.createDataFrame(code, CODE), versions


def test_counts_statuses_and_score_equal_a_full_comparison(spark, history):
    design, code, versions = history
    found = findings.over_versions(design, code, versions)
    got = {(r.project, r.version): r for r in findings.per_version(found, design, code, versions).collect()}
    each = design.join(versions, "project")
    elements = compare.compare_elements(each, code, "project", "version")
    members = compare.compare_members(each.where("member IS NOT NULL"), code.where("member IS NOT NULL"), "project", "version")
    # an element without listed members is matched as well
    matched = elements.where("state = 'matched'").select("project", "version", "element")
    left, right = each.where("member IS NOT NULL"), code.where("member IS NOT NULL")
    on = ["project", "version", "element", "member_kind", "member"]
    lacking = left.join(matched, on[:3], "left_semi").join(right, on, "left_anti").select(*on)
    beyond = right.join(matched, on[:3], "left_semi").join(left, on, "left_anti").select(*on)
    beyond = beyond.where("NOT (member_kind = 'method' AND (member IN ('__init__') OR member = element))")
    assert members.where("state = 'missing'").select(*on).exceptAll(lacking).count() == 0
    for key, r in got.items():
        here = lambda t: t.where((F.col("project") == key[0]) & (F.col("version") == key[1]))  # noqa: B023, E731
        e = {x.element: x.state for x in here(elements).collect()}
        assert (r.n_missing_class, r.n_extra_class) == (sum(s == "missing" for s in e.values()), sum(s == "extra" for s in e.values()))
        assert (r.n_missing_member, r.n_extra_member) == (here(lacking).count(), here(beyond).count())
        total = sum(s != "extra" for s in e.values()) + here(left.join(matched, on[:3], "left_semi")).count()
        assert r.checks_total == total and r.score == pytest.approx(100 * (total - r.n_missing_class - r.n_missing_member) / total if total else 0)
    status = {(r.project, r.version, r.element): r.status for r in findings.statuses(found, design, versions).collect()}
    assert len(status) == design.select("project", "element").distinct().count() * 5
    lacks, more = ({(r.project, r.version, r.element) for r in t.collect()} for t in (lacking, beyond))
    there = {(r.project, r.version, r.element) for r in matched.collect()}
    for key, said in status.items():
        assert said == ("absent" if key not in there else "partial" if key in lacks else "divergent" if key in more else "conforming")


def test_fingerprints_are_equal_just_where_findings_are(spark, history):
    design, code, versions = history
    found = findings.over_versions(design, code, versions)
    rows = findings.per_version(found, design, code, versions).collect()
    sets = {}
    for r in found.collect():
        for v in (2, 3, 5, 8, 9):
            if r.valid_from <= v and (r.valid_to is None or v < r.valid_to):
                sets.setdefault((r.project, v), {}).setdefault("extra_classes" if r.kind == "extra_class" else "missing_classes" if r.kind == "missing_class" else "element_differences", set()).add((r.kind, r.element, r.member_kind, r.member))
    for a in rows:
        for b in rows:
            for field in ("missing_classes", "extra_classes", "element_differences"):
                mine, theirs = (sets.get((x.project, x.version), {}).get(field, set()) for x in (a, b))
                assert (a[field] == b[field]) == (mine == theirs)
    seen = versions.withColumns({"text_hash": F.col("version").cast("string"), "structure_hash": F.lit("s"), "design_hash": F.lit("d")})
    truth = findings.per_version(found, design, code, versions).join(seen, ["project", "version"])
    out = replay.replay(truth, findings.FIELDS)
    assert out.where("gate_strategy = 'content' AND diverges_from_oracle").count() == 0
    assert out.where("gate_strategy = 'structural' AND missed_change").count() == out.where("gate_strategy = 'structural' AND diverges_from_oracle").count() > 0


def test_empty_code_and_empty_design(spark, history):
    design, code, versions = history
    none = findings.over_versions(design, code.limit(0), versions)
    rows = findings.per_version(none, design, code.limit(0), versions).collect()
    assert len(rows) == 10 and all(r.score == 0 and r.n_missing_class > 0 for r in rows)
    assert {r.status for r in findings.statuses(none, design, versions).collect()} == {"absent"}
    free = findings.over_versions(design.limit(0), code, versions)
    assert {r.kind for r in free.collect()} == {"extra_class"} and findings.statuses(free, design.limit(0), versions).count() == 0
