"""Streaming forms of the gate, the ledger metrics, changed files and the snapshot diff."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.functions.columns import count_if
from plumbline.operators.snapshots import SnapshotStore
from plumbline.sources import lineage
from plumbline.sources.files import changed_files

DECISIONS = "project string, version long, gate_strategy string, fired boolean, late boolean"


_HASHES = "text string, structure string, design string"


class GateProcessor(StatefulProcessor):
    """The gate of one project: its last version, and the versions of a batch until their turn comes, both in the state store.

    Rows of a batch go to the store as they come, so that a backlog is held there and not in the worker; the versions are then
    taken in order, one at a time. A version that is not above the last one changes nothing and is marked late.
    """

    def __init__(self, ttl_ms: int | None = None, rows: int = 5000):
        self.ttl, self.rows = ttl_ms, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"version long, {_HASHES}", self.ttl)
        self.waiting = handle.getMapState("waiting", "version long", _HASHES, self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get() if self.last.exists() else None
        late, due = [], set()
        for frame in rows:
            for version, *hashes in frame[["version", "text_hash", "structure_hash", "design_hash"]].itertuples(index=False, name=None):
                if version in due or (last is not None and version <= last[0]):
                    late.append((key[0], int(version), "late", False, True))
                else:
                    due.add(int(version))
                    self.waiting.updateValue((int(version),), tuple(None if h is None else str(h) for h in hashes))
            if late:
                yield _decisions(late)
                late = []
        out = []
        for version in sorted(due):
            now = (version, *self.waiting.getValue((version,)))
            self.waiting.removeKey((version,))
            forced = last is None or now[3] != last[3]
            for gate, fired in (("always", True), ("content", forced or now[1] != last[1]), ("structural", forced or now[2] != last[2])):
                out.append((key[0], version, gate, bool(fired), False))
            last = now
            if len(out) >= self.rows:
                yield _decisions(out)
                out = []
        if due:
            self.last.update(last)
        if out:
            yield _decisions(out)

    def close(self) -> None:
        pass


def _decisions(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["project", "version", "gate_strategy", "fired", "late"])


def stream_gate(snapshots: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Decisions for a stream of (project, version, text_hash, structure_hash, design_hash); state lies in the RocksDB store.

    With ``ttl_ms``, a project that has been silent for so long is forgotten: its next version counts as the first.
    """
    snapshots.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = snapshots.select(F.col("project").cast("string").alias("project"), F.col("version").cast("bigint").alias("version"), "text_hash", "structure_hash", "design_hash")
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return keyed.groupBy("project").transformWithStateInPandas(statefulProcessor=GateProcessor(ttl_ms), outputStructType=DECISIONS, outputMode="Append", timeMode=mode)


def stream_metrics(runs: DataFrame) -> DataFrame:
    """Running counts and tokens per project and gate (update mode)."""
    ran = F.col("gate_allowed_llm")
    return runs.groupBy("project", "gate_strategy").agg(F.count("*").alias("runs"), count_if(ran).alias("reanalyses"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))


def hourly_metrics(runs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same per hour of event time, with a watermark."""
    return runs.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 hour"), "project").agg(F.count("*").alias("runs"), count_if(F.col("gate_allowed_llm")).alias("reanalyses"))


def stream_changed_files(events: DataFrame) -> DataFrame:
    return changed_files(events)


def as_rows(nodes: DataFrame, edges: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Whole snapshots as the rows of one stream: ``part`` tells what a row is of."""
    tables = {"nodes": nodes, "edges": edges, "snapshots": snapshots}
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (t.withColumn("part", F.lit(p)) for p, t in tables.items()))


def into_store(store: SnapshotStore) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: adds a batch of ``as_rows`` to the store, with the run rows of its versions.

    All rows of a version come in one batch. The work follows the batch and the buckets it touches; a batch that is
    delivered again overwrites what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = lineage.cut(batch)
        parts = {p: batch.where(F.col("part") == p) for p in ("nodes", "edges", "snapshots")}
        store.append(
            parts["nodes"].select("project", "version", "node", "kind", "signature"),
            parts["edges"].select("project", "version", "src", "dst", "relation"),
            parts["snapshots"].select("project", "version", "text_hash", "structure_hash", "design_hash", "score"),
            number,
        )

    return write
