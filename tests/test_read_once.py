"""Inputs that are yet to be derived are read once, small tables of versions are broadcast, and parsing is spread over tasks."""

import pytest

from plumbline.operators import graph, history, responses, snapshots


@pytest.fixture()
def counted(spark):
    def wrap(df):
        seen = spark.sparkContext.accumulator(0)

        def work(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(work, df.schema), seen

    return wrap


def test_the_commits_of_a_mainline_are_read_once(spark, counted):
    commits, seen = counted(spark.createDataFrame([("p", i, i - 1 if i else None) for i in range(9)], "project string, sha long, parent0 long"))
    found = history.mainline(commits, spark.createDataFrame([("p", 8)], "project string, sha long"))
    assert {(r.sha, r.depth) for r in found.collect()} == {(i, 8 - i) for i in range(9)} and seen.value == 9


def test_the_edges_of_layers_and_of_an_impact_are_read_once(spark, counted):
    pairs = [("p", 0, a, b) for a, b in ("ab", "bc", "cd")]
    nodes = spark.createDataFrame([("p", 0, n) for n in "abcd"], "project string, version long, node string")
    edges, seen = counted(spark.createDataFrame(pairs, "project string, version long, src string, dst string"))
    assert {(r.node, r.layer) for r in graph.layers(edges, nodes, "project", "version").collect()} == set(zip("abcd", range(4), strict=True)) and seen.value == 3
    edges, seen = counted(spark.createDataFrame(pairs, "project string, version long, src string, dst string"))
    found = graph.impact(edges, nodes, nodes.where("node = 'b'"), 1)
    assert {(r.node, r.hops) for r in found.collect()} == {("b", 0), ("a", 1), ("c", 1)} and seen.value == 3


def test_few_versions_are_broadcast(spark):
    rows = spark.createDataFrame([("p", v, "a", 0) for v in (1, 2, 4)], "project string, version long, node string, digest long")
    found = snapshots.intervals(rows, rows.select("project", "version"), "node")
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.valid_from, r.valid_to) for r in found.collect()] == [(1, None)]


def test_responses_are_parsed_in_many_tasks(spark):
    raw = spark.createDataFrame([(1, '{"a": 1}')], "k long, response string").coalesce(1)
    assert "Repartition" in responses.read(raw)._jdf.queryExecution().optimizedPlan().toString()
