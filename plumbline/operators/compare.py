"""Design against code: elements, members, relations, associations, layer rules, scores and findings.

Frames are keyed by (project, version) or any other list of keys; names identify elements within them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import count_if

#: Constructor names, which a design need not list.
CONSTRUCTORS = ("__init__", "__new__", "constructor", "__construct")


def compare_elements(design: DataFrame, code: DataFrame, *keys: str) -> DataFrame:
    """(keys, element, state) with state missing, extra or matched: one full outer join by name."""
    on = [*keys, "element"]
    left = design.select(*on).distinct().withColumn("d", F.lit(1))
    right = code.select(*on).distinct().withColumn("c", F.lit(1))
    state = F.when(F.col("c").isNull(), "missing").when(F.col("d").isNull(), "extra").otherwise("matched")
    return left.join(right, on, "full_outer").select(*on, state.alias("state"))


def compare_members(design: DataFrame, code: DataFrame, *keys: str) -> DataFrame:
    """State of each member of the elements on both sides; constructors never count as extra."""
    on, whole = [*keys, "element"], [*keys, "element", "member_kind", "member"]
    matched = design.select(*on).distinct().join(code.select(*on).distinct(), on)
    left = design.select(*whole).distinct().withColumn("d", F.lit(1))
    right = code.select(*whole).distinct().withColumn("c", F.lit(1))
    state = F.when(F.col("c").isNull(), "missing").when(F.col("d").isNull(), "extra").otherwise("matched")
    both = left.join(right, whole, "full_outer").select(*whole, state.alias("state")).join(matched, on, "left_semi")
    made = F.col("member").isin(*CONSTRUCTORS) | (F.col("member") == F.col("element"))
    return both.where(~((F.col("state") == "extra") & (F.col("member_kind") == "method") & made))


def project_code(classes: DataFrame, fields: DataFrame, methods: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Code facts in the shape of a design: elements (keys, element, element_type) and members (.., member, member_kind, type).

    classes(class, kind), fields(class, name, type), methods(class, name, returns). All but interfaces are classes; a
    field without a type is an Object, a method without one returns void. An empty type counts as none.
    """
    elements = classes.select(*keys, F.col("class").alias("element"), F.when(F.col("kind") == "interface", "interface").otherwise("class").alias("element_type"))
    given = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other)).alias("type")
    member = (*keys, F.col("class").alias("element"), F.col("name").alias("member"))
    left = fields.select(*member, F.lit("attribute").alias("member_kind"), given("type", "Object"))
    return elements, left.unionByName(methods.select(*member, F.lit("method").alias("member_kind"), given("returns", "void")))


def _related(associations: DataFrame) -> DataFrame:
    """Associations that do not say which relation they are count as plain associations."""
    return associations if "relation" in associations.columns else associations.withColumn("relation", F.lit("association"))


def relation_credits(relations: DataFrame, associations: DataFrame, *keys: str, score_associations: bool = True) -> DataFrame:
    """(keys, credit) for the score: 1 or 0 per checked relation; 1, 0.5 or 0 per association by its evidence, if those are scored at all."""
    out = relations.select(*keys, F.col("satisfied").cast("double").alias("credit"))
    if not score_associations:
        return out
    worth = F.when(F.col("evidence") == "strong", 1.0).when(F.col("evidence") == "weak", 0.5).otherwise(0.0)
    return out.unionByName(associations.select(*keys, worth.alias("credit")))


def conformance_score(elements: DataFrame, members: DataFrame, *keys: str, relations: DataFrame | None = None) -> DataFrame:
    """Checks, passed checks and score in percent, not rounded (0.0 without checks); relations(keys, credit) add one check each."""
    checks = elements.where("state <> 'extra'").select(*keys, (F.col("state") == "matched").cast("double").alias("credit"))
    checks = checks.unionByName(members.where("state <> 'extra'").select(*keys, (F.col("state") == "matched").cast("double").alias("credit")))
    if relations is not None:
        checks = checks.unionByName(relations.select(*keys, "credit"))
    out = checks.groupBy(*keys).agg(F.count("*").alias("checks_total"), F.sum("credit").alias("checks_passed"))
    return out.withColumn("score", F.coalesce(100 * F.try_divide("checks_passed", "checks_total"), F.lit(0.0)))


def reflexion_counts(elements: DataFrame, members: DataFrame, *keys: str) -> DataFrame:
    """Divergences (extra), absences (missing) and convergences (matched) over elements and members."""
    rows = elements.select(*keys, "state").unionByName(members.select(*keys, "state"))
    return rows.groupBy(*keys).agg(
        count_if(F.col("state") == "extra").alias("divergences"), count_if(F.col("state") == "missing").alias("absences"), count_if(F.col("state") == "matched").alias("convergences")
    )


def reflexion_with_relations(elements: DataFrame, members: DataFrame, relations: DataFrame, associations: DataFrame, *keys: str, score_associations: bool = False) -> DataFrame:
    """Divergences, absences and convergences with relations counted in, and the number of checks.

    An absence is also a relation without a counterpart or an association without evidence. Convergences are the whole part
    of the passed checks and, once more, all relations that are satisfied: an inheritance relation counts twice.
    """
    credits = relation_credits(relations, associations, *keys, score_associations=score_associations)
    score = conformance_score(elements, members, *keys, relations=credits).select(*keys, "checks_total", "checks_passed")
    rows = elements.select(*keys, "state").unionByName(members.select(*keys, "state"))
    counts = rows.groupBy(*keys).agg(*(count_if(F.col("state") == s).alias(s) for s in ("extra", "missing")))
    held = relations.select(*keys, "satisfied").unionByName(associations.select(*keys, (F.col("evidence") != "none").alias("satisfied")))
    held = held.groupBy(*keys).agg(count_if(F.col("satisfied")).alias("held"), count_if(~F.col("satisfied")).alias("broken"))
    out = score.join(counts, list(keys), "full_outer").join(held, list(keys), "full_outer").fillna(0)
    return out.select(
        *keys, F.col("extra").alias("divergences"), (F.col("missing") + F.col("broken")).alias("absences"),
        (F.floor("checks_passed") + F.col("held")).alias("convergences"), F.col("checks_total").cast("bigint").alias("checks_total"),
    )


def finding_keys(
    elements: DataFrame, members: DataFrame, *keys: str, relations: DataFrame | None = None, associations: DataFrame | None = None, violations: DataFrame | None = None
) -> DataFrame:
    """One string per finding, in the form kind:element[.member].

    Missing relations (satisfied is false), associations without evidence and layer violations (rule, file_path) are findings
    as well, so a change of these alone moves the fingerprint.
    """
    arrow = F.concat(F.col("source"), F.lit(" --"), F.col("relation"), F.lit("--> "), F.col("target"))
    more = []
    if relations is not None:
        more.append(relations.where("NOT satisfied").select(*keys, F.concat(F.lit("missing-relation:"), arrow).alias("finding")))
    if associations is not None:
        more.append(_related(associations).where("evidence = 'none'").select(*keys, F.concat(F.lit("no-evidence:"), arrow).alias("finding")))
    if violations is not None:
        more.append(violations.select(*keys, F.concat(F.lit("violation:"), F.col("rule"), F.lit("@"), F.col("file_path")).alias("finding")))
    first = elements.where("state <> 'matched'").select(*keys, F.concat_ws(":", "state", "element").alias("finding"))
    second = members.where("state <> 'matched'").select(*keys, F.concat(F.col("state"), F.lit("-"), F.col("member_kind"), F.lit(":"), F.col("element"), F.lit("."), F.col("member")).alias("finding"))
    out = first.unionByName(second)
    for findings in more:
        out = out.unionByName(findings)
    return out


def findings_fingerprint(findings: DataFrame, *keys: str) -> DataFrame:
    """16 hexadecimal digits that tell sets of findings apart whatever their order.

    Distinct findings are hashed in 4096 classes by their own hash and then the classes in order, so no task holds all findings of a key.
    """
    mark = F.sha2("finding", 256)
    rows = findings.select(*keys, "finding").where("finding IS NOT NULL").distinct().withColumn("part", F.substring(mark, 1, 3))
    parts = rows.groupBy(*keys, "part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("finding")), "\n"), 256).alias("digest"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda p: F.concat(p["part"], p["digest"])), "\n")
    return parts.groupBy(*keys).agg(F.substring(F.sha2(whole, 256), 1, 16).alias("fingerprint"))


def signature_differences(before: DataFrame, after: DataFrame, fields: tuple[str, ...], *keys: str) -> DataFrame:
    """Names of the signature fields in which two frames differ, NULL-safe."""
    old = before.select(*keys, *(F.col(f).alias(f"old_{f}") for f in fields))
    names = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"old_{f}")), F.lit(f)) for f in fields)))
    return after.join(old, list(keys)).select(*keys, F.array_join(names, ",").alias("changed_fields"))


def element_status(elements: DataFrame, members: DataFrame, *keys: str) -> DataFrame:
    """Every designed element: absent, partial (a member is missing), divergent (members only too many) or conforming."""
    on = [*keys, "element"]
    sums = members.groupBy(*on).agg(count_if(F.col("state") == "missing").alias("missing"), count_if(F.col("state") == "extra").alias("extra"))
    status = F.when(F.col("state") == "missing", "absent").when(F.col("missing") > 0, "partial").when(F.col("extra") > 0, "divergent").otherwise("conforming")
    return elements.where("state <> 'extra'").join(sums, on, "left").select(*on, status.alias("status"))


def check_relations(design: DataFrame, code: DataFrame, untyped: DataFrame, *keys: str) -> DataFrame:
    """Designed (source, target, relation) satisfied by the same code relation or by an untyped supertype; two equi joins and no OR."""
    pair = [*keys, "source", "target"]
    exact = code.select(*pair, "relation").distinct().withColumn("exact", F.lit(True))
    loose = untyped.select(*pair).distinct().withColumn("loose", F.lit(True))
    out = design.join(exact, [*pair, "relation"], "left").join(loose, pair, "left")
    return out.select(*pair, "relation", (F.col("exact").isNotNull() | F.col("loose").isNotNull()).alias("satisfied"))


def association_evidence(associations: DataFrame, fields: DataFrame, callables: DataFrame, elements: DataFrame, *keys: str) -> DataFrame:
    """Best evidence for each designed association (source, target, relation): strong, weak or none.

    Every row of ``associations`` is a check of its own: an association and a dependency of the same pair are two, and so are repeated rows.

    fields(element, pos, name, type); callables(element, pos, kind in param/return/instantiation, ref_pos, type). Candidates carry
    the order in which evidence counts: a typed field; per method a parameter, the return type, an instantiation;
    a field named like the target; a field name that begins with it. An absent source has none. Of a dotted type the last
    part counts.
    """
    last_part = F.substring_index("type", ".", -1)
    fields, callables = fields.withColumn("type", last_part), callables.withColumn("type", F.when(F.col("kind") == "instantiation", F.col("type")).otherwise(last_part))
    given = _related(associations)
    base = associations.select(*keys, "source", "target").distinct()
    from_field = base.join(fields.withColumnRenamed("element", "source"), [*keys, "source"])
    low, want = F.lower("name"), F.lower("target")

    def rank(*x):
        return F.struct(*((F.lit(v) if isinstance(v, int) else v).cast("bigint").alias(f"k{i}") for i, v in enumerate(x)))

    named = low.isin(want, F.concat(want, F.lit("s")), F.concat(want, F.lit("_list")))
    place = F.when(F.col("type") == F.col("target"), 1).when(named, 3).when(F.startswith(low, want), 4)  # a field counts by the best it gives
    fielded = from_field.withColumn("k", place).where("k IS NOT NULL")
    fielded = fielded.select(*keys, "source", "target", rank(F.col("k"), F.col("pos"), 0, 0).alias("rank"), F.when(F.col("k") == 1, "strong").otherwise("weak").alias("evidence"))
    uses = base.join(callables.withColumnRenamed("element", "source"), [*keys, "source"]).where(F.col("type") == F.col("target"))
    kind = F.when(F.col("kind") == "param", 0).when(F.col("kind") == "return", 1).otherwise(2)
    used = uses.select(*keys, "source", "target", rank(2, F.col("pos"), kind, F.col("ref_pos")).alias("rank"), F.when(F.col("kind") == "instantiation", "weak").otherwise("strong").alias("evidence"))
    best = fielded.unionByName(used).groupBy(*keys, "source", "target").agg(F.min_by("evidence", "rank").alias("evidence"))
    present = elements.select(*keys, F.col("element").alias("source")).distinct().withColumn("here", F.lit(True))
    out = given.join(best, [*keys, "source", "target"], "left").join(present, [*keys, "source"], "left")
    return out.select(*keys, "source", "target", "relation", F.when(F.col("here"), F.coalesce("evidence", F.lit("none"))).otherwise("none").alias("evidence"))


def layer_violations(evidence: DataFrame, rules: DataFrame, *keys: str) -> DataFrame:
    """Files of a layer with evidence of a forbidden one: rules(rule, source_marker, forbidden_marker) are a handful and are broadcast."""
    rules = rules.select("rule", F.lower("source_marker").alias("source_marker"), F.lower("forbidden_marker").alias("forbidden_marker"))
    match = F.contains(F.lower("file_path"), F.col("source_marker")) & F.contains(F.lower("evidence"), F.col("forbidden_marker"))
    found = evidence.join(F.broadcast(rules), match)
    return found.groupBy(*keys, "rule", "file_path").agg(F.array_join(F.array_sort(F.collect_set("forbidden_marker")), ",").alias("markers"))


#: The sentence of each finding and the advice that follows from some; %s are element and member, or the relation.
SENTENCES = {
    "missing": "Class '%s' appears in the UML design but not in the code.",
    "extra": "Class '%s' exists in the code but not in the UML design.",
    "relation": "Relationship not implemented: %s",
    "association": "Association has no supporting evidence in the code: %s",
    "method": "%s.%s() is designed but not implemented.",
    "attribute": "%s.%s is designed but not implemented.",
}
ADVICE = {
    "missing": "Implement the missing classes, or remove them from the diagram if the design moved on.",
    "extra": "Add the undocumented classes to the UML model so the diagram stays authoritative.",
    "association": "Give each modelled association a typed field or signature so it is visible in the code.",
    None: "No structural divergence detected by the deterministic checker.",
}


def _gaps(elements: DataFrame, members: DataFrame, keys: tuple[str, ...], relations: DataFrame | None, associations: DataFrame | None) -> DataFrame:
    """(keys, kind, gap) of every gap."""
    arrow = F.concat(F.col("source"), F.lit(" --"), F.col("relation"), F.lit("--> "), F.col("target"))
    state, kind = F.col("state"), F.col("member_kind")
    named = F.when(state == "missing", F.format_string(SENTENCES["missing"], "element")).otherwise(F.format_string(SENTENCES["extra"], "element"))
    out = elements.where("state <> 'matched'").select(*keys, state.alias("kind"), named.alias("gap"))
    lacks = F.when(kind == "method", F.format_string(SENTENCES["method"], "element", "member")).otherwise(F.format_string(SENTENCES["attribute"], "element", "member"))
    out = out.unionByName(members.where("state = 'missing'").select(*keys, kind.alias("kind"), lacks.alias("gap")))
    if relations is not None:
        out = out.unionByName(relations.where("NOT satisfied").select(*keys, F.lit("relation").alias("kind"), F.format_string(SENTENCES["relation"], arrow).alias("gap")))
    if associations is not None:
        out = out.unionByName(_related(associations).where("evidence = 'none'").select(*keys, F.lit("association").alias("kind"), F.format_string(SENTENCES["association"], arrow).alias("gap")))
    return out


def gap_sentences(elements: DataFrame, members: DataFrame, *keys: str, relations: DataFrame | None = None, associations: DataFrame | None = None) -> DataFrame:
    """A sentence per gap: classes on one side only, designed members, relations and associations without a counterpart. Members beyond the design are none."""
    return _gaps(elements, members, keys, relations, associations).select(*keys, "gap")


def recommendations(elements: DataFrame, members: DataFrame, *keys: str, relations: DataFrame | None = None, associations: DataFrame | None = None) -> DataFrame:
    """(keys, place, recommendation): what follows from the kinds of gaps there are, or one row that says there is nothing, for every key of elements."""
    kinds = _gaps(elements, members, keys, relations, associations).where(F.col("kind").isin(*(k for k in ADVICE if k))).select(*keys, "kind").distinct()
    told = F.coalesce(F.expr(f"map({', '.join(repr(k) + ', ' + str(i) for i, k in enumerate(k for k in ADVICE if k))})[kind]"), F.lit(len(ADVICE) - 1))
    text = F.element_at(F.array(*(F.lit(v) for v in ADVICE.values())), F.col("place") + 1)
    every = elements.select(*keys).distinct().join(kinds, list(keys), "left")
    return every.select(*keys, told.cast("int").alias("place")).select(*keys, "place", text.alias("recommendation"))
