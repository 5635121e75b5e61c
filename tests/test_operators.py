"""Scenarios and properties on small frames."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import columns as fn
from plumbline.operators import compare, gate, graph, resolve, statistics, survival


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rates_are_null_without_a_denominator(spark):
    low, high = fn.wilson(F.col("k"), F.col("n"))
    out = spark.createDataFrame([(0, 0), (3, 10)], "k long, n long").select(fn.rate(F.col("k"), F.col("n")), low, high).collect()
    assert tuple(out[0]) == (None, None, None)
    assert out[1][1] < 0.3 < out[1][2]


def test_exact_paired_test_stays_finite(spark):
    data = [(0, 0), (1, 5), (3, 3), (700, 900), (1500, 1500)]
    got = [r[0] for r in spark.createDataFrame(data, "a long, b long").select(fn.exact_paired_p(F.col("a"), F.col("b"))).collect()]
    for (a, b), p in zip(data, got):
        n = a + b
        want = 1.0 if n == 0 else min(1.0, 2 * float(sum(math.comb(n, k) for k in range(min(a, b) + 1)) / 2**n)) if n < 900 else None
        assert want is None or p == pytest.approx(want, rel=1e-9)
        assert 0 <= p <= 1


def test_type_heads_and_callees(spark):
    said = ["List[Order]", "Dict[str, Order]", "Order<T>", "'Order'", "Order | None", "int"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "t string").select(fn.type_head(F.col("t"))).collect()]
    assert got == ["Order", "Dict", "Order", "Order", "Order", "int"]
    said = ["list[Order]", "Array<T>", "Map<String, Order>", ": Set<Order>", "Optional[List[Order]]", "List[A | B]", "  ", '"Order"', "Callable(x)"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "t string").select(fn.type_head(F.col("t"))).collect()]
    assert got == ["Order", "T", "Map", "Order", "List[Order", "A", None, "Order", "Callable"]
    calls = ["self.repo.save()", "a->b", "X::y", "f", "9x", "a." + "b" * 300, "f(" + "x" * 300 + ")", "$this->save()", "f()"]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(c,) for c in calls], "t string").select(fn.callee(F.col("t"))).collect()]
    assert got == [("self.repo", "save"), ("a", "b"), ("X", "y"), (None, "f"), None, None, (None, "f"), ("this", "save"), (None, "f")]


def test_module_keys(spark):
    got = spark.createDataFrame([("a/b/__init__.py",)], "p string").select(fn.module_keys(F.col("p"))).first()[0]
    assert got == sorted({"a/b/__init__.py", "a/b/__init__", "a.b.__init__", "b/__init__", "b.__init__", "__init__", "a/b", "a.b"})
    said = ["'./lib/api.ts'", "../../x.py", "..\\y.js", "a.b", "m.mjs"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "t string").select(fn.module_name(F.col("t"))).collect()]
    assert got == ["lib/api", "x", "y", "a.b", "m"]


def _graph(spark, names):
    nodes = spark.createDataFrame([("p", n, k) for n, k in names], "project string, node string, kind string")
    edges = spark.createDataFrame([("p", a[0], b[0], "calls") for a, b in zip(names, names[1:])], "project string, src string, dst string, relation string")
    return nodes, edges


def test_shape_and_renames(spark):
    old, old_edges = _graph(spark, [("A", "class"), ("B", "method"), ("C", "method")])
    new, new_edges = _graph(spark, [("A", "class"), ("X", "method"), ("C", "method")])
    assert rows(graph.isomorphic(old, new, old_edges, new_edges)) == [("p", True)]
    assert rows(graph.renames(old, new, old_edges, new_edges)) == [("p", "B", "X")]
    other, other_edges = _graph(spark, [("A", "class"), ("X", "class"), ("C", "method")])
    assert rows(graph.isomorphic(old, other, old_edges, other_edges)) == [("p", False)]
    assert rows(graph.isomorphic(old, new, old_edges, new_edges, most=2)) == [("p", None)]


def test_diff_of_a_version_with_itself_is_empty(spark):
    nodes = spark.createDataFrame([("p", v, n, "class", "1") for v in (1, 2) for n in "AB"], "project string, version long, node string, kind string, signature string")
    assert graph.diff_nodes(nodes).where("change <> 'unchanged'").count() == 0
    assert graph.diff_nodes(nodes).count() == 2


def test_impact_grows_with_radius(spark):
    nodes, edges = _graph(spark, [(c, "class") for c in "ABCDE"])
    nodes, edges = (t.withColumn("version", F.lit(1)) for t in (nodes, edges))
    seeds = spark.createDataFrame([("p", 1, "C"), ("p", 1, "unknown")], "project string, version int, node string")
    sizes = [graph.impact(edges, nodes, seeds, r).count() for r in range(4)]
    assert sizes == [1, 3, 5, 5]


def test_gate_order_of_reasons(spark):
    snaps = [("p", 0, "t0", "s0", "d", 0, None), ("p", 1, "t1", "s0", "d", 0, None), ("p", 2, "t2", "s1", "d", 3, True), ("p", 3, "t2", "s1", "e", 0, None), ("p", 4, "t2", "s1", "e", 0, None)]
    df = spark.createDataFrame(snaps, "project string, version long, text_hash string, structure_hash string, design_hash string, delta_size long, isomorphic boolean")
    got = {(r.version, r.gate_strategy): (r.fired, r.reason) for r in gate.decide(df).collect()}
    assert got[0, "isomorphism"] == (True, "first version")
    assert [got[1, g][0] for g in gate.STRATEGIES] == [True, True, False, False]  # a comment changed
    assert [got[2, g][0] for g in gate.STRATEGIES] == [True, True, True, False]  # renamed consistently
    assert all(got[3, g] == (True, "design changed") for g in gate.STRATEGIES)
    assert [got[4, g][0] for g in gate.STRATEGIES] == [True, False, False, False]


def test_association_evidence(spark):
    ass = spark.createDataFrame([("O", "Repo"), ("O", "Item"), ("O", "Log"), ("O", "Net"), ("Gone", "Repo")], "source string, target string")
    fields = spark.createDataFrame([("O", 0, "repo", "Repo"), ("O", 1, "items", "Object"), ("O", 2, "logger", "Object")], "element string, pos int, name string, type string")
    calls = spark.createDataFrame([("O", 0, "instantiation", 0, "Item"), ("O", 0, "return", 0, "Item")], "element string, pos int, kind string, ref_pos int, type string")
    elements = spark.createDataFrame([("O",)], "element string")
    got = {(r.source, r.target): r.evidence for r in compare.association_evidence(ass, fields, calls, elements).collect()}
    assert got == {("O", "Repo"): "strong", ("O", "Item"): "strong", ("O", "Log"): "weak", ("O", "Net"): "none", ("Gone", "Repo"): "none"}


def test_call_cascade_does_not_fall_through(spark):
    sites = [("s1", "f", "O", "self.repo", "save", False, None), ("s2", "f", "O", "self.repo", "missing", False, None), ("s3", "f", "O", None, "helper", False, None), ("s4", "f", "O", "self", "base_method", False, None), ("s5", "f", "O", None, "twice", False, None), ("s6", "f", "O", None, "Repo", True, None)]
    sites = spark.createDataFrame(sites, "site string, file string, class string, receiver string, name string, instantiation boolean, local_type string")
    classes = spark.createDataFrame([("O", "f"), ("Repo", "g"), ("Base", "g")], "class string, file string")
    methods = spark.createDataFrame([("Repo", "save", "Repo.save", 0), ("Base", "base_method", "Base.m", 0), ("Repo", "twice", "Repo.twice", 1), ("Base", "twice", "Base.twice", 1)], "class string, name string, method_id string, pos int")
    fields = spark.createDataFrame([("O", "repo", "Repo")], "class string, field string, type string")
    bases = spark.createDataFrame([("O", "Base", 0)], "class string, base string, pos int")
    functions = spark.createDataFrame([("f", "helper", "f.helper")], "file string, name string, function_id string")
    imports = spark.createDataFrame([], "file string, symbol string, target string")
    keyed = [t.withColumn("project", F.lit(1)) for t in (sites, classes, methods, fields, bases, functions, imports)]
    got = {r.site: (r.bucket, r.target) for r in resolve.resolve_calls(*keyed, "project").collect()}
    assert got == {"s1": ("field", "Repo.save"), "s2": ("external", None), "s3": ("same_file", "f.helper"), "s4": ("self", "Base.m"), "s5": ("self", "Base.twice"), "s6": ("instantiation", "Repo")}


def test_call_cascade_bare_calls_imports_and_types_by_last_part(spark):
    sites = [
        ("own", "f", "A", None, "m", False, None), ("file class", "f", None, None, "B", False, None), ("imported class", "f", None, None, "Far", False, None),
        ("module", "f", None, "mod.x", "go", False, None), ("module class", "f", None, "mod", "Far", False, None), ("two", "f", None, None, "two", False, None),
        ("lone", "f", None, None, "Lone", False, None), ("local", "f", None, "v.x", "m", False, "pkg.A"), ("local lacks", "f", None, "v", "none", False, "pkg.A"),
        ("static", "f", None, "A", "m", False, None), ("twins", "f", None, None, "Twin", True, None), ("nothing", "f", "A", "self", "gone", False, None), ("null", "f", None, None, None, None, None),
    ]
    sites = spark.createDataFrame(sites, "site string, file string, class string, receiver string, name string, instantiation boolean, local_type string")
    classes = spark.createDataFrame([("A", "f", "A"), ("f/B", "f", "B"), ("Far", "g", "Far"), ("Lone", "h", "Lone"), ("t1", "h", "Twin"), ("t2", "i", "Twin")], "class string, file string, class_name string")
    methods = spark.createDataFrame([("A", "m", "A.m", 0), ("f/B", "two", "B.two", 0)], "class string, name string, method_id string, pos int")
    fields = spark.createDataFrame([], "class string, field string, type string")
    bases = spark.createDataFrame([("A", "A", 0), ("A", "Twin", 1)], "class string, base string, pos int")
    functions = spark.createDataFrame([("g", "go", "g.go"), ("h", "two", "h.two")], "file string, name string, function_id string")
    imports = spark.createDataFrame([("f", "mod", "g"), ("f", "Far", "g")], "file string, symbol string, target string")
    got = {r.site: (r.bucket, r.target) for r in resolve.resolve_calls(sites, classes, methods, fields, bases, functions, imports).collect()}
    assert got == {
        "own": ("self", "A.m"), "file class": ("instantiation", "f/B"), "imported class": ("instantiation", "Far"), "module": ("import", "g.go"), "module class": ("import", "Far"), "two": ("ambiguous", None),
        "lone": ("instantiation", "Lone"), "local": ("local", "A.m"), "local lacks": ("external", None), "static": ("static", "A.m"), "twins": ("external", None), "nothing": ("external", None), "null": ("external", None),
    }


def test_implementation_graph(spark):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    nodes, edges = resolve.implementation_graph(
        frame([("f",)], "file string"), frame([("A", "f", "class"), ("I", "f", "interface")], "class string, file string, kind string"), frame([("A", "A.m"), ("A", "A.n")], "class string, method_id string"),
        frame([("A", "I", "implements"), ("A", "Nowhere", "extends")], "class string, base string, relation string"),
        frame([("A.m", "A.n", "calls"), ("A.m", "A.m", "calls"), ("A.m", "I", "instantiates"), ("A.m", "lost", "calls"), ("A", "I", "calls")], "src string, dst string, relation string"),
        functions=frame([("f", "f.go")], "file string, function_id string"),
    )
    assert {tuple(r) for r in nodes.collect()} == {("f", "module"), ("A", "class"), ("I", "interface"), ("A.m", "method"), ("A.n", "method"), ("f.go", "function")}
    assert {tuple(r) for r in edges.collect()} == {("f", "A", "contains"), ("f", "I", "contains"), ("A", "A.m", "contains"), ("A", "A.n", "contains"), ("f", "f.go", "contains"), ("A", "I", "calls"), ("A.m", "A.n", "calls"), ("A.m", "I", "instantiates")}


def test_supertypes(spark):
    b = [("A", False, "B", "unknown", 0), ("A", False, "I", "unknown", 1), ("A", False, "C", "unknown", 2), ("J", True, "I", "unknown", 0)]
    bases = spark.createDataFrame(b, "class string, is_interface boolean, base string, base_kind string, pos int").withColumn("project", F.lit(1))
    interfaces = spark.createDataFrame([(1, "I"), (1, "J")], "project int, name string")
    got = {r["class"]: (r.extends, r.implements, r.untyped_supertypes) for r in resolve.split_supertypes(bases, interfaces, "project").collect()}
    assert got == {"A": ("B", ["I"], ["C"]), "J": ("I", [], [])}


def test_element_survival_example(spark):
    said = {"A": ["conforming", "conforming", "divergent", "divergent"], "B": ["conforming", "absent", "absent", "absent"], "C": ["conforming"] * 4, "D": ["partial"] * 4}
    data = [("p", e, i, s) for e, seq in said.items() for i, s in enumerate(seq)]
    out = survival.element_survival(spark.createDataFrame(data, "project string, element string, commit_index long, status string"), "project").first()
    assert (out.at_risk, out.deviating_at_freeze, out.events, out.window) == (3, 1, 2, 4)
    assert out.survival_at_end == pytest.approx(1 / 3) and out.half_life == 2 and out.censored_beyond is None
    frame = spark.createDataFrame(data, "project string, element string, commit_index long, status string")
    assert {r.element: r.commit_index for r in survival.first_deviations(frame).collect()} == {"B": 1, "A": 2}
    few = frame.where("element IN ('A', 'C')").unionByName(frame.where("element = 'C'").withColumn("element", F.lit("C2")))
    out = survival.element_survival(few, "project").first()
    assert out.half_life is None and out.censored_beyond == 3
    late = frame.where("element = 'A'").withColumn("commit_index", F.col("commit_index") + 5)
    assert survival.element_survival(late, "project").first().half_life == 2  # from the element's first commit
    none = survival.element_survival(frame.where("element = 'D'"), "project").first()
    assert none.at_risk == 0 and none.survival_at_end is None


def test_drift_rate_needs_two_points(spark):
    rows = [("p", 0, "always", 1, 1), ("q", 0, "always", 1, None), ("q", 2, "always", None, 4), ("q", 3, "always", None, None)]
    runs = spark.createDataFrame(rows, "project string, commit_index long, gate_strategy string, divergences long, absences long")
    assert {r.project: r.drift_rate for r in statistics.drift_rate(runs).collect()} == {"p": None, "q": 1.5}


def test_horizons_equal_a_loop(spark):
    import random

    draw = random.Random(3)
    data = [(p, "g", i, draw.random() < 0.5) for p in range(4) for i in range(40)]
    served = spark.createDataFrame([(*d, d[3]) for d in data], "project long, gate_strategy string, commit_index long, diverges_from_oracle boolean, missed_change boolean")
    want = set()
    for p, _, i, bad in data:
        mine = [d[3] for d in data if d[0] == p]
        if bad and not (i and mine[i - 1]):
            want.add((p, i, next((j - i for j in range(i + 1, 40) if not mine[j]), None)))
    assert {(r.project, r.commit_index, r.horizon) for r in survival.recovery_horizons(served).collect()} == want


def test_confusion_of_labelled_deviations(spark):
    kinds = [("positive", True, True)] * 9 + [("structural", True, True), ("structural", True, False)] + [("negative", False, False)] * 5
    data = [(g, g in ("always", "content") or s, c) for g in ("always", "content", "structural") for _, s, c in kinds]
    got = {r.gate: (r.tp, r.fn, r.fp, r.tn) for r in statistics.confusion(spark.createDataFrame(data, "gate string, fired boolean, changed boolean"), "gate").collect()}
    assert got == {"always": (10, 0, 6, 0), "content": (10, 0, 6, 0), "structural": (10, 0, 1, 5)}


def test_survival_never_rises(spark):
    for data in ([(1, True), (1, False), (3, True)], [(5, False)], [(2, True)] * 4):
        curve = [r.survival for r in survival.kaplan_meier(spark.createDataFrame(data, "time long, event boolean")).orderBy("time").collect()]
        assert all(0 <= b <= a + 1e-12 for a, b in zip([1.0, *curve], curve))
