"""Canonical forms are worked out once for all that is made of them, and lineage is cut by tables."""

import glob
import os

from plumbline.operators import shapes
from plumbline.sources import lineage

NODES, EDGES = "project string, version long, node string, kind string", "project string, version long, src string, dst string, relation string"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_renames_and_sameness_come_from_one_reading(spark):
    nodes = spark.createDataFrame([("p", v, f"{m}{i}", "class") for v, m in ((0, "a"), (1, "b")) for i in range(4)], NODES)
    edges = spark.createDataFrame([("p", v, f"{m}{i}", f"{m}{i + 1}", "calls") for v, m in ((0, "a"), (1, "b")) for i in range(3)], EDGES)
    measured = shapes.measured(nodes, edges, names=True)
    assert _plan(measured).count("MapInArrow") == 1
    found = lineage.cut(measured)
    same, new = shapes.same_as_before(nodes, edges, found=found), shapes.renamed(nodes, edges, found=found)
    assert "MapInArrow" not in _plan(same) + _plan(new)
    assert [tuple(r) for r in same.collect()] == [("p", 1, True)]
    assert sorted(tuple(r) for r in new.collect()) == [("p", 1, f"a{i}", f"b{i}") for i in range(4)]


def test_an_edge_to_no_node_makes_no_renames(spark):
    nodes = spark.createDataFrame([("p", v, f"{m}{i}", "class") for v, m in ((0, "a"), (1, "b")) for i in range(2)], NODES)
    edges = spark.createDataFrame([("p", 0, "a0", "a1", "calls"), ("p", 1, "b0", "b1", "calls"), ("p", 1, "b0", "gone", "calls")], EDGES)
    assert shapes.renamed(nodes, edges).count() == 0


def test_lineage_is_cut_by_a_table(spark):
    before = set(glob.glob(f"{lineage.folder(spark)[5:]}/*") if lineage.folder(spark).startswith("file:") else glob.glob(f"{lineage.folder(spark)}/*"))
    kept = lineage.cut(spark.range(100_000).selectExpr("id % 3 AS a", "'a long text that repeats' AS b"))
    (path,) = kept.inputFiles()[:1]
    size = sum(os.path.getsize(f) for f in (x.removeprefix("file://") for x in kept.inputFiles()))
    assert kept.count() == 100_000 and path.endswith(".parquet") and size < 100_000 * 8 and os.path.dirname(path.removeprefix("file://")) not in before
