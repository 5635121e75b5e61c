"""Versions of graphs coded as intervals, and a store of them that grows batch by batch.

A node (or edge) that stays the same over versions is one row with the version it is valid from and the version it is
valid to (exclusive, NULL while it lasts). Any two kept versions then differ by the rows that cover just one of them:
a range filter, with no join of the table with itself.

``SnapshotStore`` keeps closed intervals in a log that is only appended to, and open ones, with the hashes of each
project's last version, beside it: by buckets of projects, a new generation of a bucket whenever a batch touches it. So
a batch costs work in proportion to itself and to the buckets it touches, not to the history. Everything a batch writes lies
in folders of its number: run again, it writes the same rows in the same place and adds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import gate, graph, replay
from plumbline.operators.runs import EDGE, KEYS, NODE, digest, edge_intervals, edge_runs, intervals, node_intervals, node_runs, sizes
from plumbline.sources import lineage

__all__ = ["SnapshotStore", "covers", "diff", "edge_intervals", "intervals", "node_intervals"]

def covers(version: int) -> Column:
    return (F.col("valid_from") <= version) & (F.col("valid_to").isNull() | (F.col("valid_to") > version))


def _changes(table: DataFrame, a: int, b: int, *key: str) -> DataFrame:
    """(project, key, change) between two versions: added, removed or changed."""
    at_a, at_b = covers(a), covers(b)
    moved = table.where(at_a != at_b).withColumns({"a": F.when(at_a, F.struct("digest")), "b": F.when(at_b, F.struct("digest"))})
    both = moved.groupBy("project", *key).agg(F.max("a").alias("a"), F.max("b").alias("b")).where("NOT a <=> b")  # back to what it was is no change
    return both.select("project", *key, F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise("changed").alias("change"))


def diff(nodes: DataFrame, edges: DataFrame, versions: DataFrame, a: int, b: int, most: int = 200) -> DataFrame:
    """One row per project: what changed from version ``a`` to ``b``, counted, with the first ``most`` node ids of each kind and both scores.

    ``nodes`` and ``edges`` are intervals, ``versions`` has (project, version, score). A project that does not keep both
    versions is marked not retained and has NULL for the rest.
    """
    kept = versions.groupBy("project").agg(*(F.max(F.when(F.col("version") == v, F.struct("score"))).alias(n) for n, v in (("from", a), ("to", b))))
    moved = _changes(nodes, a, b, *NODE)
    place = F.row_number().over(Window.partitionBy("project", "change").orderBy("node"))
    moved = moved.withColumn("place", place)
    lists = moved.groupBy("project").agg(
        *(F.count_if(F.col("change") == c).alias(f"{c}_nodes") for c in ("added", "removed", "changed")),
        *(F.array_sort(F.collect_list(F.when((F.col("change") == c) & (F.col("place") <= most), F.col("node")))).alias(c) for c in ("added", "removed", "changed")),
    )
    edge = _changes(edges, a, b, *EDGE).groupBy("project").agg(*(F.count_if(F.col("change") == c).alias(f"{c}_edges") for c in ("added", "removed")))
    out = kept.join(lists, "project", "left").join(edge, "project", "left")
    retained = F.col("from").isNotNull() & F.col("to").isNotNull()
    counts = [F.when(retained, F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in replay.DELTAS]
    names = [F.when(retained, F.coalesce(c, F.array().cast("array<string>"))).alias(c) for c in ("added", "removed", "changed")]
    return out.select("project", retained.alias("retained"), *counts, *names, F.when(retained, F.col("from.score")).alias("score_from"), F.when(retained, F.col("to.score")).alias("score_to"))


class SnapshotStore:
    """Graph snapshots of many projects under one path. Tables given to ``append`` hold whole versions.

    nodes(project, version, node, kind, signature), edges(project, version, src, dst, relation),
    snapshots(project, version, text_hash, structure_hash, design_hash, score). A version whose number is not above its
    project's last one changes nothing and is listed as late. With ``number``, versions are given in any numbering and
    stored as the project's last version + 1, + 2 and so on. ``project`` is the type of project keys.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, radius: int = 1, strategies: tuple[str, ...] = gate.STRATEGIES, project: str = "bigint"):
        self.spark, self.path, self.buckets, self.radius, self.strategies, self.project = spark, path, buckets, radius, strategies, project

    SCHEMAS = {
        "nodes": "project {0}, node string, kind string, signature string, since bigint",
        "edges": "project {0}, src string, dst string, relation string, since bigint",
        "snapshots": "project {0}, version bigint, text_hash string, structure_hash string, design_hash string, score double",
    }

    def _schema(self, text: str) -> str:
        return text.format(self.project)

    def _bucket(self, table: DataFrame) -> DataFrame:
        return table.withColumn("bucket", F.pmod(F.xxhash64("project"), F.lit(self.buckets)).cast("int"))

    def _read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """The rows of all batches, or of those before one."""
        schema = self._schema(schema)
        if not lineage.exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.path}/{name}")
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")

    def generations(self, before: int | None = None) -> dict[int, int]:
        """The last batch that wrote each bucket: at most one entry a bucket."""
        if not lineage.exists(self.spark, f"{self.path}/touched"):
            return {}
        seen = self.spark.read.schema("bucket int, batch bigint").parquet(f"{self.path}/touched")
        seen = seen if before is None else seen.where(F.col("batch") < before)
        return {r["bucket"]: r["batch"] for r in seen.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}

    def open(self, part: str, before: int | None = None, only: set[int] | None = None) -> DataFrame:
        """What is valid now, or before a batch, of all buckets or of some."""
        paths = [f"{self.path}/open_{part}/batch={b}/bucket={k}" for k, b in self.generations(before).items() if only is None or k in only]
        paths = [p for p in paths if lineage.exists(self.spark, p)]
        schema = self._schema(self.SCHEMAS[part])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, table: DataFrame, name: str, batch: int, *by: str) -> None:
        writer = (table.hint("rebalance", *by) if by else table).write.mode("overwrite")  # a bucket of many rows is written by several tasks
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{name}/batch={batch}")

    def append(self, nodes: DataFrame, edges: DataFrame, snapshots: DataFrame, batch: int, number: bool = False) -> DataFrame:
        """Adds a batch; its run rows (decision, sizes of delta and impact) per version and policy."""
        given = {"nodes": nodes, "edges": edges, "snapshots": snapshots}
        given["snapshots"] = lineage.cut(self._bucket(given["snapshots"]))
        touched = {r["bucket"] for r in given["snapshots"].select("bucket").distinct().collect()}  # at most ``buckets``
        had = {p: self.open(p, batch, touched) for p in self.SCHEMAS}
        last = had["snapshots"].select("project", F.col("version").alias("last"))
        numbers = given["snapshots"].join(last, "project", "left").select("project", "version", "last")
        if number:
            place = F.row_number().over(Window.partitionBy("project").orderBy("version"))
            numbers = numbers.withColumn("stored", F.coalesce("last", F.lit(0)) + place)
        else:
            numbers = numbers.withColumn("stored", F.col("version")).where("last IS NULL OR version > last")
        numbers = lineage.cut(numbers.select(*KEYS, F.col("stored").cast("bigint").alias("stored")))
        fresh = {p: t.drop("bucket").join(numbers, list(KEYS)).drop("version").withColumnRenamed("stored", "version") for p, t in given.items()}
        late = given["snapshots"].join(numbers, list(KEYS), "left_anti").select(*KEYS)
        held = {p: had[p].join(last, "project").withColumnRenamed("last", "version") for p in ("nodes", "edges")} | {"snapshots": had["snapshots"]}
        every = {p: held[p].unionByName(fresh[p], allowMissingColumns=True) for p in given}
        every |= {p: lineage.cut(every[p]) for p in ("snapshots", "edges")}  # read more than once
        stored = fresh["snapshots"].select(*KEYS)
        versions = every["snapshots"].select(*KEYS)
        found = {"nodes": lineage.cut(node_runs(every["nodes"], versions, kept=("kind", "signature"))), "edges": lineage.cut(edge_runs(every["edges"], versions, kept=("relation",)))}
        runs = replay.run_rows(every["snapshots"], every["nodes"], every["edges"], radius=self.radius, strategies=self.strategies, runs=found)
        runs = lineage.cut(runs.join(stored, list(KEYS), "left_semi"))
        for part, key, kept in (("nodes", NODE, ("kind", "signature")), ("edges", EDGE, ("relation",))):
            self._write(found[part].where("valid_to IS NOT NULL").select("project", *key, "digest", "valid_from", "valid_to"), f"closed_{part}", batch)
            self._write(self._bucket(found[part].where("valid_to IS NULL").select("project", *key, *kept, F.col("valid_from").alias("since"))), f"open_{part}", batch, "bucket")
        newest = Window.partitionBy("project").orderBy(F.desc("version"))
        self._write(self._bucket(every["snapshots"].withColumn("k", F.row_number().over(newest)).where("k = 1").drop("k")), "open_snapshots", batch, "bucket")
        self._write(self._index(every["snapshots"], found, stored), "versions", batch)
        self._write(late, "late", batch)
        self._write(runs, "runs", batch)
        self._write(given["snapshots"].select("bucket").distinct(), "touched", batch)  # last: with it the batch is there
        return runs

    def _index(self, snapshots: DataFrame, found: dict, stored: DataFrame) -> DataFrame:
        counts = [sizes(found[p], snapshots, n) for p, n in (("nodes", "node_count"), ("edges", "edge_count"))]
        parent = F.lag("version").over(Window.partitionBy("project").orderBy("version"))
        rows = reduce(lambda t, s: t.join(s, list(KEYS), "left"), counts, snapshots.withColumn("parent_version", parent))
        rows = rows.join(stored, list(KEYS), "left_semi")
        return rows.select(*KEYS, "parent_version", "text_hash", "structure_hash", "design_hash", "score", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("node_count", "edge_count")))

    VERSIONS = "project {0}, version bigint, parent_version bigint, text_hash string, structure_hash string, design_hash string, score double, node_count bigint, edge_count bigint"

    def versions(self) -> DataFrame:
        return self._read("versions", self.VERSIONS)

    def late(self) -> DataFrame:
        return self._read("late", "project {0}, version bigint")

    def runs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/runs").drop("batch")

    def node_history(self) -> DataFrame:
        closed = self._read("closed_nodes", "project {0}, node string, digest bigint, valid_from bigint, valid_to bigint")
        still = self.open("nodes").select("project", "node", digest(*graph.TRACKED).alias("digest"), F.col("since").alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"))
        return closed.unionByName(still)

    def edge_history(self) -> DataFrame:
        closed = self._read("closed_edges", "project {0}, src string, dst string, digest bigint, valid_from bigint, valid_to bigint")
        still = self.open("edges").select("project", "src", "dst", F.lit(0).cast("bigint").alias("digest"), F.col("since").alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"))
        return closed.unionByName(still)

    def diff(self, a: int, b: int, most: int = 200, keep: int | None = None) -> DataFrame:
        """``diff`` of two stored versions; with ``keep``, only each project's newest so many count as kept."""
        kept = self.versions() if keep is None else gate.keep_newest(self.versions(), keep)
        return diff(self.node_history(), self.edge_history(), kept.select(*KEYS, "score"), a, b, most)
