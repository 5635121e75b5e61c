"""Shapes of graphs of any size: no graph goes undecided for its number of nodes or of refinements."""

import random

import duckdb
import numpy as np

from plumbline.operators import shapes
from plumbline.plans.oracles import SQL
from plumbline.plans.queries import QUERIES

NODES, EDGES = "project string, version long, node string, kind string", "project string, version long, src string, dst string, relation string"


def _tables(spark, graphs):
    """Graphs of one project, version by version: (number of nodes, edges, name of a node)."""
    nodes = [("p", v, name(i), "class") for v, (n, _, name) in enumerate(graphs) for i in range(n)]
    edges = [("p", v, name(a), name(b), "calls") for v, (_, e, name) in enumerate(graphs) for a, b in e]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def test_more_than_400_nodes_are_compared(spark):
    rings = lambda *sizes: [(sum(sizes[:k]) + i, sum(sizes[:k]) + (i + 1) % n) for k, n in enumerate(sizes) for i in range(n)]
    place = random.Random(1).sample(range(601), 601)
    graphs = [(601, rings(300, 301), lambda i: f"a{i}"), (601, rings(300, 301), lambda i: f"b{place[i]}"), (601, rings(299, 302), lambda i: f"a{i}"), (601, rings(302, 299), lambda i: f"c{i}")]
    said = {r.version: r.isomorphic for r in shapes.same_as_before(*_tables(spark, graphs)).collect()}
    assert said == {1: True, 2: False, 3: True}


def _form(n, edges, perm):
    rows = sorted({(perm[a], perm[b]) for a, b in edges})
    src, dst = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    return shapes.Shapes().form(np.zeros(n, np.uint64), src, dst, np.zeros(len(src), np.uint64))[0]


def test_dense_and_regular_graphs_take_no_end_of_branches():
    rng = random.Random(2)
    matched = [(a, b) for a in range(120) for b in range(120) if a != b and a // 2 != b // 2]
    threes = [(a, b) for a in range(120) for b in range(120) if a != b and a // 3 != b // 3]
    torus = [(20 * i + j, 20 * ((i + x) % 20) + (j + y) % 20) for i in range(20) for j in range(20) for x, y in ((0, 1), (1, 0), (0, 19), (19, 0))]
    forms = []
    for n, edges in ((120, matched), (120, threes), (400, torus), (600, [(i, (i + 1) % 600) for i in range(600)])):
        forms.append(_form(n, edges, list(range(n))))
        assert forms[-1] == _form(n, edges, rng.sample(range(n), n))
    assert len(set(forms)) == 4


def test_loops_are_no_edges_between_tied_nodes():
    loops, pair = [(0, 0), (1, 1)], [(0, 1), (1, 0)]
    assert _form(2, loops, [0, 1]) == _form(2, loops, [1, 0]) != _form(2, pair, [0, 1])


def test_many_graphs_together_and_alone_have_the_same_shapes(spark):
    ring = [(i, (i + 1) % 5) for i in range(5)]
    nodes, edges = _tables(spark, [(5, ring, lambda i: f"a{i}"), (5, ring[:4], lambda i: f"a{i}"), (5, [*ring, *ring], lambda i: f"b{i}")])
    together = sorted((r.version, r.n_edges, r.shape) for r in shapes.measured(nodes, edges).collect())
    alone = [(v, r.n_edges, r.shape) for v in range(3) for r in shapes.measured(nodes.where(f"version = {v}"), edges.where(f"version = {v}")).collect()]
    assert together == alone and [n for _, n, _ in alone] == [5, 4, 5] and alone[0][2] == alone[2][2] != alone[1][2]


def test_same_shape_of_large_projects_is_what_the_sql_says(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT * REPLACE (o_custkey % 3 AS o_custkey) FROM '/root/testdata/sf0.001/orders.parquet') TO '{tmp_path}/orders.parquet'")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet'")
        want = con.execute(SQL["c16_same_shape"]).fetchall()
    got = [tuple(r) for r in QUERIES["c16_same_shape"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {r[2] for r in want} == {True, False}
