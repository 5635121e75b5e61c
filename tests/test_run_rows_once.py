"""Run rows from runs of versions that are at hand, and the impact of seeds that are known."""

from plumbline.operators import graph, replay, runs


def test_run_rows_from_runs_at_hand(spark):
    nodes = spark.createDataFrame([("p", v, n, "class", s) for v, n, s in ((1, "a", "x"), (1, "b", "x"), (2, "a", "y"), (2, "b", "x"), (2, "c", "x"), (3, "c", "x"))], "project string, version long, node string, kind string, signature string")
    edges = spark.createDataFrame([("p", 1, "a", "b"), ("p", 2, "a", "b"), ("p", 3, "c", "c")], "project string, version long, src string, dst string")
    snaps = spark.createDataFrame([("p", v, "t", "s") for v in (1, 2, 3)], "project string, version long, text_hash string, structure_hash string")
    found = {"nodes": runs.node_runs(nodes, snaps), "edges": runs.edge_runs(edges, snaps)}
    rows = sorted(map(tuple, replay.run_rows(snaps, nodes, edges, strategies=("structural",), runs=found).select("version", *replay.DELTAS, "impact_nodes").collect()))
    assert rows == [(1, 2, 0, 0, 0, 0, 2), (2, 1, 0, 1, 0, 0, 3), (3, 0, 2, 0, 1, 1, 0)]
    seeds = runs.steps(found["nodes"], "node").where("change <> 'removed'")
    near = {tuple(r) for r in graph.impact(edges, nodes, seeds, 1, known=True).collect()}
    assert near == {tuple(r) for r in graph.impact(edges, nodes, seeds, 1).collect()} == {("p", 2, "a", 0), ("p", 2, "b", 1), ("p", 2, "c", 0)}
