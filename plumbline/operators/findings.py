"""Findings of every version from facts, by what changed: the comparison of a design with a history of code.

Code members are coded as intervals of versions. A finding holds while its element or member is there or lacking, so findings
are intervals as well, worked out per element from the versions in which something about it changed; counts per version
are running sums over findings that begin and end, and fingerprints running exclusive ors. The work follows the changes and not
versions times members. ``whole`` is the same from a comparison of every version, as the oracle of a replay would do it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import compare, snapshots
from plumbline.sources import lineage

KINDS = ("missing_class", "extra_class", "missing_member", "extra_member")
#: Fields of a version's findings that a replay compares.
FIELDS = ("missing_classes", "extra_classes", "element_differences", "score")
_E, _M = ("element",), ("element", "member_kind", "member")


def _edges(intervals: DataFrame, *key: str) -> DataFrame:
    """(project, key, version, step): 1 where an interval begins, -1 where it ends."""
    ends = F.array_compact(F.array(F.struct(F.col("valid_from").alias("version"), F.lit(1).alias("step")), F.when(F.col("valid_to").isNotNull(), F.struct(F.col("valid_to").alias("version"), F.lit(-1).alias("step")))))
    return intervals.select("project", *key, F.explode(ends).alias("e")).select("project", *key, "e.version", "e.step")


def _spells(states: DataFrame, state: Column, *key: str) -> DataFrame:
    """(project, key, state, valid_from, valid_to): runs of versions over which ``state``, given where it may change, keeps its value."""
    line = Window.partitionBy("project", *key).orderBy("version")
    rows = states.withColumn("state", state).withColumns({"before": F.lag("state").over(line), "any": F.lag(F.lit(True)).over(line)})
    rows = rows.where("any IS NULL OR NOT before <=> state")
    return rows.withColumnsRenamed({"version": "valid_from"}).withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("project", *key).orderBy("valid_from"))).select("project", *key, "state", "valid_from", "valid_to")


def _named(table: DataFrame) -> DataFrame:
    """Members that may count as extra: no constructors."""
    made = F.col("member").isin(*compare.CONSTRUCTORS) | (F.col("member") == F.col("element"))
    return table.where(~((F.col("member_kind") == "method") & made))


def present(code: DataFrame, versions: DataFrame) -> DataFrame:
    """(project, element, valid_from, valid_to): the versions in which the code has an element, as a table."""
    none = F.lit(0).cast("bigint").alias("digest")
    return lineage.cut(snapshots.intervals(code.select("project", "version", *_E, none), versions, *_E).drop("digest"))


def over_versions(design: DataFrame, code: DataFrame, versions: DataFrame, there: DataFrame | None = None) -> DataFrame:
    """(project, kind, element, member_kind, member, valid_from, valid_to) of every finding.

    design(project, element, member_kind, member) stands for all versions; code has ``version`` as well; a NULL member only says
    that the element is there. ``versions`` lists (project, version), empty ones too. ``there`` is ``present``'s result where it is at hand.
    """
    none = F.lit(0).cast("bigint")
    there = present(code, versions) if there is None else there
    members = snapshots.intervals(code.where("member IS NOT NULL").select("project", "version", *_M, none.alias("digest")), versions, *_M).drop("digest")
    # members and the design meet in one shuffle by element: is the element designed, is the member
    marks = design.select("project", *_M, *(F.lit(None).cast(members.schema[c].dataType).alias(c) for c in ("valid_from", "valid_to")), F.lit(True).alias("designed"))
    members = members.withColumn("designed", F.lit(False)).unionByName(marks).where("project IS NOT NULL AND element IS NOT NULL").repartition("project", *_E)
    known = F.col("designed") & F.col("member_kind").isNotNull() & F.col("member").isNotNull()
    members = members.withColumns({"wanted": F.max("designed").over(Window.partitionBy("project", *_E)), "listed": F.max(known).over(Window.partitionBy("project", *_M))})
    members = lineage.cut(members.where("wanted AND NOT designed").drop("wanted", "designed"))
    wanted, listed = design.select("project", *_E).distinct(), design.where("member IS NOT NULL").select("project", *_M).distinct()
    first = versions.groupBy("project").agg(F.min("version").alias("version"))
    blank = [F.lit(None).cast("string").alias(c) for c in ("member_kind", "member")]
    extra = there.join(wanted, ["project", *_E], "left_anti").select("project", F.lit("extra_class").alias("kind"), "element", *blank, "valid_from", "valid_to")
    here = wanted.join(first, "project").withColumn("step", F.lit(0)).unionByName(_edges(there.join(wanted, ["project", *_E], "left_semi"), *_E))
    states = here.repartition("project", *_E).groupBy("project", *_E, "version").agg(F.sum("step").alias("step"))
    on = F.sum("step").over(Window.partitionBy("project", *_E).orderBy("version"))
    missing = _spells(states.withColumn("on", on), F.col("on") == 0, *_E).where("state").select("project", F.lit("missing_class").alias("kind"), "element", *blank, "valid_from", "valid_to")
    beyond = _named(members.where("NOT listed"))
    beyond = beyond.select("project", F.lit("extra_member").alias("kind"), *_M, "valid_from", "valid_to")
    both = _edges(there, *_E).join(listed, ["project", *_E]).select("project", *_M, "version", F.col("step").alias("e"), F.lit(0).alias("m"))
    both = both.unionByName(_edges(members.where("listed"), *_M).select("project", *_M, "version", F.lit(0).alias("e"), F.col("step").alias("m")))
    sums = both.repartition("project", *_M).groupBy("project", *_M, "version").agg(F.sum("e").alias("e"), F.sum("m").alias("m"))
    line = Window.partitionBy("project", *_M).orderBy("version")
    sums = sums.withColumns({"e": F.sum("e").over(line), "m": F.sum("m").over(line)})
    lacking = _spells(sums, (F.col("e") > 0) & (F.col("m") == 0), *_M).where("state").select("project", F.lit("missing_member").alias("kind"), *_M, "valid_from", "valid_to")
    return extra.unionByName(missing).unionByName(beyond).unionByName(lacking)


def _finding(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), "kind", "element", F.coalesce("member_kind", F.lit("")), F.coalesce("member", F.lit("")))


def per_version(findings: DataFrame, design: DataFrame, code: DataFrame, versions: DataFrame, there: DataFrame | None = None) -> DataFrame:
    """(project, version, counts of each kind, checks, passed, score, divergences, absences, and a fingerprint of each field's findings)."""
    weight = design.groupBy("project", "element").agg(F.count("member").alias("checks"))
    there = (present(code, versions) if there is None else there).join(weight, ["project", *_E])
    checks = _edges(there, "element", "checks").groupBy("project", "version").agg(F.sum(F.col("step") * F.col("checks")).alias("member_checks"))
    elements = weight.groupBy("project").agg(F.count("*").alias("class_checks"))
    steps = _edges(findings, "kind", "element", "member_kind", "member")
    sums = [F.sum(F.when(F.col("kind") == k, F.col("step")).otherwise(0)).alias(k) for k in KINDS]
    fields = {"missing_classes": ("missing_class",), "extra_classes": ("extra_class",), "element_differences": ("missing_member", "extra_member")}
    marks = [F.bit_xor(F.when(F.col("kind").isin(*k), _finding(salt)).otherwise(F.lit(0).cast("bigint"))).alias(f"{f}_{salt}") for f, k in fields.items() for salt in (1, 2)]
    moved = steps.groupBy("project", "version").agg(*sums, *marks)
    line = Window.partitionBy("project").orderBy("version")  # one row a version
    rows = versions.select("project", "version").distinct().join(moved, ["project", "version"], "left").join(checks, ["project", "version"], "left").join(elements, "project", "left")
    rows = rows.fillna(0)
    running = {c: F.sum(c).over(line) for c in (*KINDS, "member_checks")} | {f"{f}_{s}": F.bit_xor(f"{f}_{s}").over(line) for f in fields for s in (1, 2)}
    rows = rows.withColumns(running)
    total = F.col("class_checks") + F.col("member_checks")
    passed = total - F.col("missing_class") - F.col("missing_member")
    prints = [F.concat_ws(":", F.col(f"{f}_1").cast("string"), F.col(f"{f}_2").cast("string")).alias(f) for f in fields]
    return rows.select(
        "project", "version", *(F.col(k).alias(f"n_{k}") for k in KINDS), total.alias("checks_total"), passed.alias("checks_passed"),
        F.coalesce(100 * F.try_divide(passed, total), F.lit(0.0)).alias("score"), passed.alias("convergences"),
        (F.col("extra_class") + F.col("extra_member")).alias("divergences"), (F.col("missing_class") + F.col("missing_member")).alias("absences"), *prints,
    )


def statuses(findings: DataFrame, design: DataFrame, versions: DataFrame) -> DataFrame:
    """(project, version, element, status) of every designed element in every version: absent, partial, divergent or conforming.

    A status is worked out where an element's findings change and stands until the next change.
    """
    order = Window.partitionBy("project").orderBy("version")
    placed = versions.select("project", "version").distinct().withColumn("ord", F.row_number().over(order))
    wanted = design.select("project", "element").distinct()
    start = wanted.join(placed.where("ord = 1").select("project", "version"), "project").withColumns({"kind": F.lit(None).cast("string"), "step": F.lit(0)})
    steps = start.unionByName(_edges(findings.where("kind <> 'extra_class'"), "kind", "element"))
    kinds = ("missing_class", "missing_member", "extra_member")
    sums = steps.groupBy("project", "element", "version").agg(*(F.sum(F.when(F.col("kind") == k, F.col("step")).otherwise(0)).alias(k) for k in kinds))
    line = Window.partitionBy("project", "element").orderBy("version")
    now = sums.withColumns({k: F.sum(k).over(line) for k in kinds})
    status = F.when(F.col("missing_class") > 0, "absent").when(F.col("missing_member") > 0, "partial").when(F.col("extra_member") > 0, "divergent").otherwise("conforming")
    spells = _spells(now, status, "element")
    last = placed.groupBy("project").agg(F.max("ord").alias("last"))
    begin, end = (placed.select("project", F.col("version").alias(v), F.col("ord").alias(o)) for v, o in (("valid_from", "first"), ("valid_to", "next")))
    spells = spells.join(begin, ["project", "valid_from"]).join(end, ["project", "valid_to"], "left").join(last, "project")
    each = spells.select("project", "element", F.col("state").alias("status"), F.explode(F.sequence("first", F.coalesce(F.col("next") - 1, F.col("last")))).alias("ord"))
    return each.join(placed, ["project", "ord"]).select("project", "version", "element", "status")


def whole(design: DataFrame, code: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Element and member states of every version by a full comparison, for versions with any code."""
    keys = ("project", "version")
    each = design.join(code.select(*keys).distinct(), "project")
    elements = compare.compare_elements(each, code, *keys)
    return elements, compare.compare_members(each.where("member IS NOT NULL"), code.where("member IS NOT NULL"), *keys)
