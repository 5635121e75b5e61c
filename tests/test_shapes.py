"""Canonical forms against permutations, and graphs that refinement alone does not tell apart."""

import itertools
import random

import numpy as np
import pytest

from plumbline.operators import shapes

NODES, EDGES = "project string, version long, node string, kind string", "project string, version long, src string, dst string, relation string"


def _form(n, edges, kinds=None, perm=None):
    perm = perm or list(range(n))
    kind = np.zeros(n, np.uint64)
    kind[perm] = kinds or [0] * n
    rows = sorted((perm[a], perm[b], r) for a, b, r in edges)
    return shapes.Shapes().form(kind, *(np.array([r[k] for r in rows], t) for k, t in enumerate((np.int64, np.int64, np.uint64))))


def _isomorphic(n, one, kinds, other, other_kinds):
    one, other = set(one), set(other)
    return len(one) == len(other) and any(
        all(kinds[i] == other_kinds[p[i]] for i in range(n)) and {(p[a], p[b], r) for a, b, r in one} == other for p in itertools.permutations(range(n))
    )


def _ring(at, n):
    return [(at + i, at + (i + 1) % n, 0) for i in range(n)]


def _both_ways(edges):
    return [x for a, b, r in edges for x in ((a, b, r), (b, a, r))]


@pytest.mark.parametrize("seed", range(4))
def test_equal_forms_are_isomorphism_on_small_graphs(seed):
    rng = random.Random(seed)
    for _ in range(150):
        n = rng.randint(1, 5)
        pairs = [{(rng.randrange(n), rng.randrange(n)): int(rng.random() < 0.2) for _ in range(rng.randint(0, 6))} for _ in range(2)]
        one, other = ([(a, b, r) for (a, b), r in p.items()] for p in pairs)
        kinds = [int(rng.random() < 0.2) for _ in range(n)]
        other_kinds = kinds
        if rng.random() < 0.5:
            p = rng.sample(range(n), n)
            other, other_kinds = [(p[a], p[b], r) for a, b, r in one], [kinds[p.index(i)] for i in range(n)]
        mine, theirs = _form(n, one, kinds), _form(n, other, other_kinds)
        alike = _isomorphic(n, one, kinds, other, other_kinds)
        assert (mine[0] == theirs[0]) == alike
        if alike:
            to = dict(zip(mine[1].tolist(), theirs[1].tolist(), strict=True))
            assert {(to[a], to[b], r) for a, b, r in one} == set(other)


def test_graphs_that_colours_alone_do_not_tell_apart():
    assert _form(6, _ring(0, 6))[0] == _form(6, _ring(0, 6), perm=[3, 1, 5, 0, 2, 4])[0] != _form(6, _ring(0, 3) + _ring(3, 3))[0]
    assert _form(8, _both_ways(_ring(0, 8)))[0] != _form(8, _both_ways(_ring(0, 4) + _ring(4, 4)))[0]
    cells = [(i, j) for i in range(4) for j in range(4)]
    rook = [(4 * a + b, 4 * c + d, 0) for a, b in cells for c, d in cells if (a == c) != (b == d)]
    steps = ((0, 1), (0, 3), (1, 0), (3, 0), (1, 1), (3, 3))
    twisted = [(4 * a + b, 4 * ((a + x) % 4) + (b + y) % 4, 0) for a, b in cells for x, y in steps]
    shuffled = random.Random(0).sample(range(16), 16)
    assert _form(16, rook)[0] != _form(16, twisted)[0] == _form(16, twisted, perm=shuffled)[0]


def test_large_graphs_are_decided():
    rng = random.Random(5)
    for n, edges in ((400, [x for i in range(100) for x in _ring(4 * i, 4)]), (400, [(0, i, 0) for i in range(1, 400)]), (400, _both_ways([(i, (i - 1) // 2, 0) for i in range(1, 400)]))):
        assert _form(n, edges)[0] == _form(n, edges, perm=rng.sample(range(n), n))[0]
    assert shapes.Shapes(branches=3).form(np.zeros(6, np.uint64), *(np.array(c, t) for c, t in zip(zip(*_ring(0, 6), strict=True), (np.int64, np.int64, np.uint64), strict=True))) is None


def test_versions(spark):
    graphs = {0: _ring(0, 6), 1: _ring(0, 6), 2: _ring(0, 3) + _ring(3, 3), 3: _ring(0, 3) + _ring(3, 3), 5: []}
    name = {0: "abcdef", 1: "uvwxyz", 2: "abcdef", 3: "fedcba", 5: "abcdef"}
    nodes = spark.createDataFrame([("p", v, n, None) for v in graphs for n in name[v]] + [("q", 0, "a", "x"), ("q", 1, "a", "y")], NODES)
    edges = spark.createDataFrame([("p", v, name[v][a], name[v][b], "calls") for v, g in graphs.items() for a, b, _ in g], EDGES)
    said = {(r.project, r.version): r.isomorphic for r in shapes.same_as_before(nodes, edges).collect()}
    assert said == {("p", 1): True, ("p", 2): False, ("p", 3): True, ("p", 5): False, ("q", 1): False}
    assert {r.isomorphic for r in shapes.same_as_before(nodes, edges, branches=1).where("version = 1 AND project = 'p'").collect()} == {None}
    assert {r.isomorphic for r in shapes.same_as_before(nodes, edges, most=5).where("version = 1 AND project = 'p'").collect()} == {None}
    found = {(r.version, r.node): r.new_node for r in shapes.renamed(nodes, edges).collect()}
    old, new = ({(name[v][a], name[v][b]) for a, b, _ in graphs[v]} for v in (0, 1))
    assert {(found[1, a], found[1, b]) for a, b in old} == new and {v for v, _ in found} <= {1, 3}
    empty = shapes.same_as_before(nodes.limit(0), edges.limit(0), versions=spark.createDataFrame([("e", 0), ("e", 1)], "project string, version long"))
    assert [r.isomorphic for r in empty.collect()] == [True]
    assert shapes.same_as_before(nodes.limit(0), edges.limit(0)).count() == 0
