"""Interval coding and the snapshot store against whole recomputation, in several splits of the input."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import gate, graph, replay, snapshots
from plumbline.streaming import jobs

KINDS = {
    "nodes": "project string, version long, node string, kind string, signature string",
    "edges": "project string, version long, src string, dst string, relation string",
    "snapshots": "project string, version long, text_hash string, structure_hash string, design_hash string, score double",
}


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(4)
    rows = {p: [] for p in KINDS}
    for project in ("p", "q"):
        for version in (1, 2, 4, 5, 7):
            here = [n for n in "abcdef" if rng.random() < 0.7]
            rows["nodes"] += [(project, version, n, "class", str(rng.randint(0, 1))) for n in here]
            rows["edges"] += [(project, version, a, b, "calls") for a in here for b in here if rng.random() < 0.3]
            rows["snapshots"].append((project, version, f"t{rng.randint(0, 1)}", f"s{rng.randint(0, 1)}", f"d{version // 4}", float(version)))
    return {p: spark.createDataFrame(r, KINDS[p]) for p, r in rows.items()}


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_any_two_versions_differ_by_a_range_filter(spark, history):
    nodes, edges = snapshots.node_intervals(history["nodes"], history["snapshots"]), snapshots.edge_intervals(history["edges"], history["snapshots"])
    for a, b in ((1, 7), (2, 5), (5, 2), (4, 4), (1, 3)):
        got = {r.project: r for r in snapshots.diff(nodes, edges, history["snapshots"], a, b).collect()}
        for project in ("p", "q"):
            at = {v: {r.node: r.signature for r in history["nodes"].where((F.col("project") == project) & (F.col("version") == v)).collect()} for v in (a, b)}
            have = {r.version for r in history["snapshots"].where(F.col("project") == project).collect()}
            r = got[project]
            assert r.retained == (a in have and b in have)
            if not r.retained:
                assert (r.added, r.score_to, r.added_nodes) == (None, None, None)
                continue
            assert r.added == sorted(at[b].keys() - at[a].keys()) and r.removed == sorted(at[a].keys() - at[b].keys())
            assert r.changed == sorted(n for n in at[a].keys() & at[b].keys() if at[a][n] != at[b][n])
            assert (r.score_from, r.score_to, r.changed_nodes) == (a, b, len(r.changed))
    assert [len(r.added) for r in snapshots.diff(nodes, edges, history["snapshots"], 7, 1, most=0).collect()] == [0, 0]


@pytest.mark.parametrize("splits", [((1, 2, 4, 5, 7),), ((1,), (2, 4), (5, 7)), ((1, 2), (2, 4), (1, 5), (7,))])
def test_the_store_equals_a_run_over_everything(spark, history, tmp_path, splits):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"), buckets=3, project="string")
    into = jobs.into_store(store)
    rows = jobs.as_rows(**history)
    for number, some in enumerate(splits):
        for _ in range(2 if number == 1 else 1):
            into(rows.where(F.col("version").isin(*some)), number)
    want = replay.run_rows(history["snapshots"], history["nodes"], history["edges"])
    assert _rows(store.runs().select(*want.columns)) == _rows(want)
    assert _rows(store.node_history().select("project", "node", "valid_from", "valid_to")) == _rows(snapshots.node_intervals(history["nodes"], history["snapshots"]).select("project", "node", "valid_from", "valid_to"))
    assert _rows(store.edge_history().drop("digest")) == _rows(snapshots.edge_intervals(history["edges"], history["snapshots"]).drop("digest"))
    assert store.versions().count() == 10 and store.late().count() == 2 * (sum(map(len, splits)) - 5)
    parents = {(r.project, r.version): r.parent_version for r in store.versions().collect()}
    assert len(splits) > 1 or [parents["p", v] for v in (1, 2, 4, 5, 7)] == [None, 1, 2, 4, 5]
    assert {r.retained for r in store.diff(1, 7).collect()} == {True} and {r.retained for r in store.diff(1, 7, keep=3).collect()} == {False}


def test_numbering_and_empty_batches(spark, history, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"), buckets=2, project="string")
    nothing = {p: t.limit(0) for p, t in history.items()}
    store.append(**nothing, batch=0, number=True)
    assert store.versions().count() == 0 and store.node_history().count() == 0
    for batch, some in ((1, "version < 4"), (2, "version >= 4"), (2, "version >= 4")):
        store.append(**{p: t.where(some) for p, t in history.items()}, batch=batch, number=True)
    rows = {(r.project, r.version): (r.parent_version, r.score) for r in store.versions().collect()}
    assert [rows["q", v] for v in range(1, 6)] == [(None, 1.0), (1, 2.0), (2, 4.0), (3, 5.0), (4, 7.0)] and len(rows) == 10


def test_one_shuffle_diff_equals_the_definition(spark, history):
    got = {(r.project, r.version, r.node): r.change for r in graph.diff_nodes(history["nodes"], versions=history["snapshots"]).collect()}
    at = {}
    for r in history["nodes"].collect():
        at.setdefault((r.project, r.version), {})[r.node] = r.signature
    want = {}
    for p in ("p", "q"):
        for old, new in ((1, 2), (2, 4), (4, 5), (5, 7)):
            a, b = at.get((p, old), {}), at.get((p, new), {})
            for n in a.keys() | b.keys():
                want[p, new, n] = "added" if n not in a else "removed" if n not in b else "unchanged" if a[n] == b[n] else "changed"
    assert got == want
    assert gate.STRATEGIES  # the store's default policies
