"""Shape isomorphism where only the colours tell two graphs apart."""

from plumbline.operators import graph


def test_graphs_of_equal_counts_with_different_colours_are_not_alike(spark):
    nodes = spark.createDataFrame([("p", n, "class") for n in "abcd"], "project string, node string, kind string")
    path, star = (
        spark.createDataFrame([("p", s, d, "calls") for s, d in pairs], "project string, src string, dst string, relation string") for pairs in (("ab", "bc", "cd"), ("ab", "ac", "ad"))
    )
    assert [tuple(r) for r in graph.isomorphic(nodes, nodes, path, star).collect()] == [("p", False)]
    assert [tuple(r) for r in graph.isomorphic(nodes, nodes, star, star).collect()] == [("p", True)]
