"""Renames in graphs of any size."""

from plumbline.operators import shapes

NODES, EDGES = "project string, version long, node string, kind string", "project string, version long, src string, dst string, relation string"


def _tables(spark, graphs):
    """Graphs of one project, version by version: (number of nodes, edges, name of a node)."""
    nodes = [("p", v, name(i), "class") for v, (n, _, name) in enumerate(graphs) for i in range(n)]
    edges = [("p", v, name(a), name(b), "calls") for v, (_, e, name) in enumerate(graphs) for a, b in e]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def test_renames_in_more_than_400_nodes(spark):
    chain = [(i, i + 1) for i in range(999)]
    nodes, edges = _tables(spark, [(1000, chain, lambda i: f"a{i}"), (1000, chain, lambda i: f"{'ab'[i % 3 == 0]}{i}")])
    assert {(r.node, r.new_node) for r in shapes.renamed(nodes, edges).collect()} == {(f"a{i}", f"b{i}") for i in range(0, 1000, 3)}
