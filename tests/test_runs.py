"""Runs of versions: one shuffle by key gives intervals, steps and sizes."""

from pyspark.sql import functions as F

from plumbline.operators import graph, runs, snapshots

ROWS = [(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (2, "a", "x"), (2, "b", "y"), (4, "b", "y"), (5, "a", "z"), (5, "c", None), (7, "c", None)]


def _nodes(spark):
    nodes = spark.createDataFrame([("p", v, n, "class", s) for v, n, s in ROWS], "project string, version long, node string, kind string, signature string")
    return nodes, spark.createDataFrame([("p", v) for v in (1, 2, 4, 5, 7, 8)], "project string, version long")


def test_steps_and_sizes_follow_from_runs(spark):
    nodes, versions = _nodes(spark)
    found = runs.node_runs(nodes, versions, kept=("signature",))
    steps = {tuple(r) for r in runs.steps(found, "node").collect()}
    assert steps == {tuple(r) for r in graph.diff_nodes(nodes, versions=versions).where("change <> 'unchanged'").collect()} and len(steps) == 7
    assert {r.version: r.n for r in runs.sizes(found, versions, "n").collect()} == {1: 2, 2: 2, 4: 1, 5: 2, 7: 1, 8: 0}
    kept = {(r.node, r.valid_from): (r.valid_to, r.signature) for r in found.collect()}
    assert kept == {("a", 1): (4, "x"), ("b", 1): (2, "x"), ("b", 2): (5, "y"), ("a", 5): (7, "z"), ("c", 5): (8, None)}


def test_intervals_take_one_shuffle_by_key(spark):
    nodes, versions = _nodes(spark)
    plan = snapshots.node_intervals(nodes, versions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert nodes.where(F.col("version") == 8).count() == 0
