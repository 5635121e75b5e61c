"""Graphs go through one shuffle."""

from plumbline.operators import shapes

NODES, EDGES = "project string, version long, node string, kind string", "project string, version long, src string, dst string, relation string"


def _tables(spark, graphs):
    """Graphs of one project, version by version: (number of nodes, edges, name of a node)."""
    nodes = [("p", v, name(i), "class") for v, (n, _, name) in enumerate(graphs) for i in range(n)]
    edges = [("p", v, name(a), name(b), "calls") for v, (_, e, name) in enumerate(graphs) for a, b in e]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def test_one_shuffle_by_graph(spark):
    nodes, edges = _tables(spark, [(2, [(0, 1)], lambda i: f"a{i}")])
    assert shapes.measured(nodes, edges)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
