"""Exact n-gram Jaccard self-join of documents in the metric space of their shingle sets.

Jaccard distance is a metric, so pivots can divide the work: a set belongs to the Voronoi region of
its nearest pivot and is copied to the region of another pivot when it is no more than twice the
threshold farther from it; two linked sets then share a region. Inside a region two sets can only be
linked when their distances to its pivot differ by no more than the threshold (the window). Regions
that are still large are divided again.

Unrelated texts are all at distance 1 from each other and from any document, so document pivots cannot
divide a whole corpus: every document would be copied to every region. The outermost regions therefore
come from the other metric of sets, the size of their difference. Linked sets of given sizes
differ in at most k elements, and so do what is left of them without any given shingles. Shingles are dealt into k + 1 + s classes by hash, so at least s + 1
classes hold the same shingles in both sets. The hash of a class's shingles is a region key, and the least
set of a key is the pivot of all who share it. Shingles that a sample shows to be common (passages that many documents hold) are in
no class, so that they alone bring no sets together. Sizes are dealt into ranges, with keys made for a
set's own range and, where a linked set may be smaller, for the one below. A class without shingles
makes no key; s is chosen so that few sets have more than s such classes, and those get their first shingles as keys
as well, rare ones before common ones, as many as guarantee a shared one, so no link is lost.

Components are formed early: every set is first measured against the least of its pivots. Each region
that still holds several components is then settled by pivot, window and recursion: one that a task
can hold is compared there; a larger one is divided among the sets nearest to the mean of its parts, as new
pivots, and one that pivots do not divide any further is compared part against part. No step holds
more than two parts in a task. Sketches (counts of a set's shingles in buckets) go ahead of the sets: the sum of
their differences never exceeds the size of the difference of the sets, so a set that no sketch allows
to be linked to another component is not shipped.

Equal sets are one node. A node is a 64-bit hash of the set; a second, independent hash tells sets apart whose
first ones are equal, and such sets are named by both. Shingles inside two compared sets are told apart by 64 bits.

Corner cases: a text without words has the empty set, links with nothing and is its own component;
fewer words than the shingle length give one shingle of all of them; rows that repeat a doc_id are documents
of their own with the same id (equal sets share a component anyway); a null doc_id takes part, and
is a component's id only where no other is. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import textbytes as tb
from plumbline.llm.components import merged
from plumbline.llm.saved import saved

_U = np.uint64
#: Sets in a region that one task compares by itself, and shingles they may have together.
REGION, REGION_SHINGLES = 400, 4_000_000
_WIDE = 2  # threshold ratios in a range of sizes
#: Levels of division; parts of a region whose middle sets become pivots.
DEPTH, PIVOTS = 4, 16
#: Sets whose two hashes tell them apart only together; the expected number is below 10 for 10^10 sets.
TWINS = 10_000


def size_ranges(num: int, den: int, top: int) -> np.ndarray:
    """Least sizes of the ranges."""
    starts = [1]
    while starts[-1] <= top:
        starts.append(max(starts[-1] + 1, int(starts[-1] / (num / den) ** _WIDE) + 1))
    return np.array(starts)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of a run, sorted by row, then hash."""
    lower = tb.LOWER[buf]
    _, _, hashes, row = tb.words(lower, offs, ~tb.IS_SPACE)
    found, at = tb.shingles(hashes, row, len(offs) - 1, k)
    order = np.lexsort((found, at))
    found, at = found[order], at[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (at[1:] != at[:-1])
    return found[new], at[new]


def set_hashes(found: np.ndarray, at: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every row's set."""
    n = np.bincount(at, minlength=n_rows).astype(_U)
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(n_rows, _U)
        np.add.at(total, at, tb.mix(found ^ _U(salt)))
        out.append(tb.mix(total + n))
    return out[0], out[1]


def node_ids(found: np.ndarray, at: np.ndarray, n_rows: int, twins: np.ndarray) -> np.ndarray:
    """The node of every row's set: its first hash, or a hash of both where that stands for several sets (``twins``, sorted)."""
    first, second = set_hashes(found, at, n_rows)
    both = np.isin(first, twins) if len(twins) else np.zeros(n_rows, bool)
    return np.where(both, tb.mix(first + tb.mix(second)), first).view(np.int64)


@lru_cache(maxsize=4096)
def spare(differ: int, least: int) -> int:
    """Classes to have beyond differ + 1, so that few sets of ``least`` shingles or more have more empty ones than that."""
    s = 1
    while (empty := (differ + 1 + s) * math.exp(-least / (differ + 1 + s))) + 2 * math.sqrt(empty) > s and s <= differ:
        s += 1
    return s


def region_keys(found: np.ndarray, at: np.ndarray, n_rows: int, num: int, den: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) such that linked rows share a key; shingles in common (sorted) are left out of the classes."""
    n = np.bincount(at, minlength=n_rows)
    starts = size_ranges(num, den, int(n.max(initial=1)))
    own = np.searchsorted(starts, n, "right") - 1
    rare = ~np.isin(found, common) if len(common) else np.ones(len(found), bool)
    rows_, shingles_ = at[rare], found[rare]
    keys, rows = [], []
    odd = np.zeros(n_rows, bool)
    below = (own > 0) & (-(-n * num // den) < starts[np.maximum(own, 0)])
    bounds = np.append(starts, 2 * starts[-1])
    differ = (den - num) * (bounds[1:] - 1 + (bounds[1:] - 1) * den // num) // (den + num)
    extra = np.array([spare(int(d), int(s)) for d, s in zip(differ, starts, strict=True)])
    for instance, has in ((own, n > 0), (own - 1, below)):
        instance = np.maximum(instance, 0)
        classes = np.where(has, differ[instance] + 1 + extra[instance], 0)
        base = np.concatenate([[0], np.cumsum(classes)])
        use = has[rows_]
        row, shingle = rows_[use], shingles_[use]
        slot = base[row] + ((shingle >> _U(7)) % classes[row].astype(_U)).astype(np.int64)
        total = np.zeros(base[-1], _U)
        np.add.at(total, slot, tb.mix(shingle))
        filled = np.bincount(slot, minlength=base[-1]) > 0
        owner = np.repeat(np.arange(n_rows), classes)
        number = np.arange(base[-1]) - base[owner]
        empty = np.bincount(owner[~filled], minlength=n_rows)
        odd |= has & (empty > extra[instance])
        tag = tb.mix(number.astype(_U) + (instance[owner].astype(_U) << _U(32)))
        keys.append(tb.mix(total + tag)[filled])
        rows.append(owner[filled])
    if odd.any():  # the first shingles, the rare ones before the common: as many as guarantee a shared one
        use = odd[at]
        row, shingle = at[use], found[use]
        order = np.lexsort((shingle, ~rare[use], row))
        row, shingle = row[order], shingle[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < n[row] + (-n[row] * num // den) + 1  # n - ceil(n * num / den) + 1
        keys.append(tb.mix(shingle[first] ^ _U(0xC2B2AE3D27D4EB4F)))
        rows.append(row[first])
    return np.concatenate(keys), np.concatenate(rows)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def sets_table(docs: DataFrame, k: int, twins: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, node (null if the set is empty), check (the second hash)."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for start, end, buf, offs in tb.runs(batch.column("text")):
                found, at = shingle_sets(buf, offs, k)
                count = np.bincount(at, minlength=end - start)
                node = pa.array(node_ids(found, at, end - start, twins), mask=count == 0)
                check = _signed(set_hashes(found, at, end - start)[1])
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), pa.array(count.astype(np.int64)), node, check], ["doc_id", "n_shingles", "node", "check"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, node bigint, check bigint")


#: One in SAMPLED documents is looked at to find shingles, and keys, that more than one in COMMON of them hold.
SAMPLED, COMMON, SALTS = 64, 10_000, 64
#: Holders in the sample that a common shingle, and a common key, has at least.
HOLDERS, KEY_HOLDERS = 3, 32


def sampled(docs: DataFrame) -> DataFrame:
    return docs.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(SAMPLED)) == 0)


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of shingles that several documents of the sample, and more than one in COMMON of them, hold: at most COMMON times the shingles of a document."""

    def run(batches):
        for batch in batches:
            for _, _, buf, offs in tb.runs(batch.column("text")):
                yield pa.RecordBatch.from_arrays([_signed(shingle_sets(buf, offs, k)[0])], ["shingle"])

    part = sampled(docs)
    least = max(HOLDERS, -(-part.select("doc_id").count() // COMMON))
    found = part.select("text").mapInArrow(run, "shingle bigint").groupBy("shingle").count().where(F.col("count") >= least)
    return np.sort(found.select("shingle").toPandas()["shingle"].to_numpy(np.int64).view(_U))


def keyed_sets(docs: DataFrame, k: int, num: int, den: int, twins: np.ndarray, common: Broadcast) -> DataFrame:
    """(key, node) rows; equal sets in one Arrow batch give theirs once."""

    def run(batches):
        for batch in batches:
            seen: set = set()
            for start, end, buf, offs in tb.runs(batch.column("text")):
                found, at = shingle_sets(buf, offs, k)
                node = node_ids(found, at, end - start, twins)
                fresh = np.zeros(end - start, bool)
                for r, x in enumerate(node.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[r] = True
                use = fresh[at]
                keys, row = region_keys(found[use], at[use], end - start, num, den, common.value)
                yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(node[row])], ["key", "node"])

    return docs.select("text").mapInArrow(run, "key bigint, node bigint")


def meetings(docs: DataFrame, k: int, num: int, den: int, twins: np.ndarray, shingles: int = 0) -> DataFrame:
    """(pivot, node): the holders of every key that several sets hold with the least of them, itself left out.

    The keys are shuffled once and looked at in windows. Keys that a sample shows to be held by very many
    documents are salted, and their least holders found by a grouped aggregation over what the salts leave. ``shingles``: about how many there are.
    """
    part = sampled(docs)
    usual = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, k))
    counted = keyed_sets(part, k, num, den, twins, usual).groupBy("key").agg(F.countDistinct("node").alias("n"))
    least = max(KEY_HOLDERS, -(-part.select("doc_id").count() // COMMON))
    common = saved(counted.where(F.col("n") >= least).select("key", F.lit(True).alias("hot")), 0)
    # at most COMMON times the keys of a document: a bounded table
    rows = keyed_sets(docs, k, num, den, twins, usual).join(F.broadcast(common), "key", "left")
    rows = rows.select("key", "node", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS)) + 1).otherwise(0).alias("salt"))
    group = Window.partitionBy("key", "salt")
    rows = rows.withColumns({"pivot": F.min("node").over(group), "last": F.max("node").over(group)})
    rows = saved(rows.where("salt > 0 OR (pivot <> last AND node <> pivot)").select(F.when(F.col("salt") > 0, F.col("key")).alias("key"), "node", "pivot").distinct(), shingles)
    cells = rows.where("key IS NULL").select("pivot", "node")
    if not common.isEmpty():
        hot = rows.where("key IS NOT NULL")
        tops = hot.groupBy("key").agg(F.min("pivot").alias("top"), F.max("node").alias("last")).where("top <> last")
        cells = cells.unionByName(hot.join(F.broadcast(tops), "key").where("top <> node").select(F.col("top").alias("pivot"), "node"))
    return saved(cells.distinct(), rows.count())


#: Ids that are sent to every executor; more are joined by shuffle.
SENT = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """ids (a saved table), marked for broadcast if they are few enough by count."""
    return F.broadcast(ids) if ids.count() <= SENT else ids


def bucket_counts(found: np.ndarray, buckets: int = 0) -> np.ndarray:
    """A set's shingles counted in buckets, modulo 256: a power of two of them, two to four shingles each, unless given."""
    if not buckets:
        buckets = min(max(32, 1 << (len(found) // 4).bit_length()), 8192)
    return np.bincount(((found >> _U(40)) & _U(buckets - 1)).astype(np.int64), minlength=buckets).astype(np.uint8)


def folded(counts: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket counts brought down to fewer buckets."""
    return counts.reshape(-1, buckets).sum(0, dtype=np.uint8)


def hashed_sets(docs: DataFrame, k: int, twins: np.ndarray) -> DataFrame:
    """node, hashes (sorted uint64 bytes), n and sketch (n in four bytes, then the bucket counts) of every non-empty text."""

    def run(batches):
        for batch in batches:
            for start, end, buf, offs in tb.runs(batch.column("text")):
                found, at = shingle_sets(buf, offs, k)
                n = end - start
                cut = np.searchsorted(at, np.arange(n + 1))
                keep = np.flatnonzero(np.diff(cut))
                own = [found[cut[r] : cut[r + 1]] for r in keep]
                raw = [x.astype("<u8").tobytes() for x in own]
                light = [np.array([len(x)], "<u4").tobytes() + bucket_counts(x).tobytes() for x in own]
                yield pa.RecordBatch.from_arrays([pa.array(node_ids(found, at, n, twins)[keep]), pa.array(raw, pa.binary()), pa.array(np.diff(cut)[keep].astype(np.int64)), pa.array(light, pa.binary())], ["node", "hashes", "n", "sketch"])

    return docs.select("text").mapInArrow(run, "node bigint, hashes binary, n bigint, sketch binary")


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def distance(a: np.ndarray, b: np.ndarray) -> float:
    both = shared(a, b)
    return 1 - both / (len(a) + len(b) - both)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    la, lb = len(a), len(b)
    if min(la, lb) * den < num * max(la, lb):
        return False
    both = shared(a, b)
    return den * both >= num * (la + lb - both)


def possible(counts: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the sets counted in others [set, bucket] could be linked to the one of ``counts``."""
    differ = np.abs((others - counts).view(np.int8).astype(np.int16)).sum(1, dtype=np.int64)
    return differ * (den + num) <= (den - num) * (sizes + n)


def link_all(nodes: list[int], sets: list[np.ndarray], labels: list[int], num: int, den: int, left: int | None = None) -> list[tuple[int, int]]:
    """Edges that connect all nodes linked inside a region; the first node is its pivot, equal labels are connected already.

    With ``left`` given, only pairs of one of the first ``left`` nodes and one of the others count.
    """
    label = np.unique(np.array(labels), return_inverse=True)[1]
    if label.max(initial=0) == 0:
        return []
    eps = 1 - num / den + 1e-9
    far = np.array([distance(sets[0], s) for s in sets])
    order = np.argsort(far, kind="stable")
    near = np.searchsorted(far[order], far[order] + eps, "right")
    sizes = np.array([len(s) for s in sets])
    buckets = len(bucket_counts(sets[int(sizes.argmin())]))
    counts = np.stack([bucket_counts(s, buckets) for s in sets])
    side = np.arange(len(nodes)) < (left or 0)
    edges = []
    for i, a in enumerate(order):
        other = order[i + 1 : near[i]]
        other = other[(label[other] != label[a]) & ((left is None) | (side[other] != side[a]))]
        if len(other):
            other = other[possible(counts[a], sizes[a], counts[other], sizes[other], num, den)]
        for b in other:
            if label[b] != label[a] and linked(sets[a], sets[b], num, den):
                label[label == label[b]] = label[a]
                edges.append((nodes[a], nodes[b]))
    return edges


def _grouped(batches, key: str, kind: str):
    """(key, [(node, side, label, payload)]) from batches sorted by key; payloads are views of the batch they came in."""
    now, rows = None, []
    for batch in batches:
        rows = [(n, s, c, h.copy()) for n, s, c, h in rows]
        raw = batch.column("payload")
        at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8)
        for i, (k, node, side, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in (key, "node", "side", "label")), strict=True)):
            if k != now and rows:
                yield now, rows
                rows = []
            now = k
            rows.append((node, side, label, data[at[i] : at[i + 1]].view(kind)))
    if rows:
        yield now, rows


def _sketched(group) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and bucket counts of a group's sketches, brought to one number of buckets."""
    sizes = np.array([int(g[3][:4].view("<u4")[0]) for g in group])
    buckets = min(len(g[3]) for g in group) - 4
    return sizes, np.stack([folded(g[3][4:], buckets) for g in group])


#: Rows with sketches and with sets in a task, about.
SKETCHES, WHOLE = 20_000, 2_000


def _dealt(rows: DataFrame, sets: DataFrame, key: str, payload: str) -> DataFrame:
    """rows(key, node, side[, label]), a saved table, with their sets or sketches, whole groups in a task, side 0 first."""
    n = rows.count()
    tasks = max(12, -(-n // (WHOLE if payload == "hashes" else SKETCHES)))
    rows = rows if "label" in rows.columns else rows.withColumn("label", F.lit(None).cast("bigint"))
    rows = F.broadcast(rows) if n <= SENT else rows
    full = rows.join(sets.select("node", F.col(payload).alias("payload")), "node").select(key, "node", "side", "label", "payload")
    return full.repartition(key).sortWithinPartitions(key, "side", "node").coalesce(tasks)


def _batch(rows, *columns: tuple[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], [n for n, _ in columns])


_EDGE = (("u", pa.int64()), ("v", pa.int64()))
_ROW = (("block", pa.int64()), ("node", pa.int64()), ("side", pa.int32()), ("label", pa.int64()))
_ROWS = "block bigint, node bigint, side int, label bigint"


def hopeful(rows: DataFrame, sets: DataFrame, num: int, den: int, across: bool = False) -> DataFrame:
    """Those of rows(block, node, side, label) whose sketches allow a link to another label in the block, and its side 0; across: only those that allow one between the sides."""

    def run(batches):
        for block, group in _grouped(batches, "block", "u1"):
            sizes, counts = _sketched(group)
            label = np.array([g[2] for g in group])
            side = np.array([g[1] for g in group])
            keep = np.zeros(len(group), bool)
            for i in range(int((side == 0).sum()) if across else len(group) - 1):
                other = np.flatnonzero((label[i + 1 :] != label[i]) & (not across or side[i + 1 :] != side[i])) + i + 1
                if len(other) and (hit := other[possible(counts[i], sizes[i], counts[other], sizes[other], num, den)]).size:
                    keep[i] = keep[hit] = True
            if keep.any():
                yield _batch([(block, g[0], g[1], g[2]) for g, k in zip(group, keep, strict=True) if k or (g[1] == 0 and not across)], *_ROW)

    return _dealt(rows, sets, "block", "sketch").mapInArrow(run, _ROWS)


def compare(rows: DataFrame, sets: DataFrame, num: int, den: int, across: bool = False) -> DataFrame:
    """Edges inside the blocks of rows(block, node, side, label), each small enough for a task; across: between sides 0 and 1 only."""

    def run(batches):
        for _, group in _grouped(batches, "block", "<u8"):
            node, side, label, own = zip(*group, strict=True)
            if pairs := link_all(list(node), list(own), list(label), num, den, side.count(0) if across else None):
                yield _batch(pairs, *_EDGE)

    return _dealt(rows, sets, "block", "hashes").mapInArrow(run, "u bigint, v bigint")


def first_edges(cells: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges between nodes and the least of their pivots: rows in blocks of about REGION, the pivot in each."""
    n = cells.count()
    pairs = saved(cells.groupBy("node").agg(F.min("pivot").alias("pivot")), n)
    total = saved(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / REGION).alias("blocks")), n)
    block = F.xxhash64("pivot", "number")
    heads = total.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("number"), "pivot").select(block.alias("block"), F.col("pivot").alias("node"), F.lit(0).alias("side"))
    dealt = pairs.join(few(total), "pivot").withColumn("number", F.pmod(F.xxhash64("node"), F.col("blocks"))).select(block.alias("block"), "node", F.lit(1).alias("side"))
    rows = saved(heads.unionByName(dealt))

    def sketch(batches):
        for block_, group in _grouped(batches, "block", "u1"):
            if len(group) > 1:
                sizes, counts = _sketched(group)
                keep = possible(counts[0], sizes[0], counts, sizes, num, den)
                if keep[1:].any():
                    yield _batch([(block_, g[0], g[1], None) for g, k in zip(group, keep, strict=True) if k], *_ROW)

    def whole(batches):
        for _, group in _grouped(batches, "block", "<u8"):
            if pairs_ := [(g[0], group[0][0]) for g in group[1:] if linked(g[3], group[0][3], num, den)]:
                yield _batch(pairs_, *_EDGE)

    rows = saved(_dealt(rows, sets, "block", "sketch").mapInArrow(sketch, _ROWS))
    return _dealt(rows, sets, "block", "hashes").mapInArrow(whole, "u bigint, v bigint")


def middles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(block, pivot): of every block of members(block, node, side) the node whose sketch is nearest to their mean."""

    def run(batches):
        for block, group in _grouped(batches, "block", "u1"):
            _, counts = _sketched(group)
            away = np.abs(counts - counts.mean(0)).sum(1)
            yield _batch([(block, group[int(away.argmin())][0])], ("block", pa.int64()), ("pivot", pa.int64()))

    return _dealt(members, sets, "block", "sketch").mapInArrow(run, "block bigint, pivot bigint")


def measure(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Distances (block, node, pivot, away) of side 1 to the pivots, side 0, in every block of rows(block, node, side)."""

    def run(batches):
        for block, group in _grouped(batches, "block", "<u8"):
            pivots = [g for g in group if g[1] == 0]
            if out := [(block, node, p[0], distance(own, p[3])) for node, side, _, own in group if side == 1 for p in pivots]:
                yield _batch(out, ("block", pa.int64()), ("node", pa.int64()), ("pivot", pa.int64()), ("away", pa.float64()))

    return _dealt(rows, sets, "block", "hashes").mapInArrow(run, "block bigint, node bigint, pivot bigint, away double")


def still_open(regions: DataFrame, named: DataFrame, sizes: DataFrame, eps: float) -> DataFrame:
    """regions(region, pivot, node, away) that hold several components, with label, the label of most members (main) and the chunks they take.

    Of a region whose distances are known, members of the main component go when their distance to the pivot
    differs by more than the threshold from those of all members of others.
    """
    n = regions.count()
    out = regions.join(few(named), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root").join(sizes, "node")
    shares = saved(out.groupBy("region", "label").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")), n)
    several = shares.groupBy("region").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("labels"), F.sum("k").alias("m"), F.sum("n").alias("n"))
    several = saved(several.where("labels > 1"), n)
    others = shares.join(few(several.select("region", "main")), "region").where("label <> main").groupBy("region").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    chunks = F.greatest(F.ceil(F.col("m") / REGION), F.ceil(F.col("n") / REGION_SHINGLES)).cast("bigint")
    bounds = saved(several.join(others, "region").select("region", "main", "m", chunks.alias("chunks"), "low", "high"), n)
    out = out.drop("n").join(few(bounds), "region")
    near = F.col("away").isNull() | F.col("away").between(F.col("low") - eps - 1e-9, F.col("high") + eps + 1e-9)
    return saved(out.where((F.col("label") != F.col("main")) | (F.col("node") == F.col("pivot")) | near).drop("low", "high"))


def divided(large: DataFrame, sets: DataFrame, eps: float, level: int) -> tuple[DataFrame, DataFrame]:
    """Voronoi regions (region, pivot, node, away) of large ones around new pivots, with the window of twice the threshold, and edges to the pivots."""
    n = large.count()
    number = F.pmod(F.xxhash64("node", F.lit(level)), F.col("chunks"))
    members = saved(large.select("region", F.xxhash64("region", number).alias("block"), number.alias("number"), "node", F.lit(1).alias("side")))
    blocks = few(saved(members.groupBy("region", "block").agg(F.first("number").alias("number")), n))
    found = middles(saved(members.where(F.col("number") < PIVOTS).select("block", "node", "side")), sets).join(blocks, "block").select("region", "pivot")
    pivots = saved(found.unionByName(large.where("node = pivot").select("region", "pivot")).distinct(), n)
    heads = blocks.join(few(pivots), "region").select("block", F.col("pivot").alias("node"), F.lit(0).alias("side"))
    rows = saved(heads.unionByName(members.select("block", "node", "side")), n)
    away = saved(measure(rows, sets).join(blocks, "block").select("region", "node", "pivot", "away"))
    edges = away.where((F.col("away") <= eps + 1e-12) & (F.col("node") != F.col("pivot"))).select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    home = saved(away.groupBy("region", "node").agg(F.min("away").alias("home")), n)
    cells = away.join(few(home), ["region", "node"]).where(F.col("away") - F.col("home") <= 2 * eps + 1e-9)
    return saved(cells.select(F.xxhash64("region", "pivot", F.lit(level)).alias("region"), "pivot", "node", "away").distinct(), n), edges


def by_parts(large: DataFrame) -> DataFrame:
    """rows(block, node, side, label): of every region, each part of the sets outside the main component with each part of all."""
    n = large.count()
    outer = large.where("label <> main")
    parts = F.greatest(F.ceil(F.count("*") / REGION), F.least(F.first("chunks"), F.count("*"))).cast("bigint").alias("parts")
    parts = few(saved(outer.groupBy("region").agg(parts), n))
    block = F.xxhash64("region", "part", "number")
    steps = lambda column: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(column) - 1))
    left = outer.join(parts, "region").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("number", steps("chunks"))
    right = large.join(parts, "region").withColumn("number", F.pmod(F.xxhash64("node", F.lit(5)), F.col("chunks"))).withColumn("part", steps("parts"))
    return left.select(block.alias("block"), "node", F.lit(0).alias("side"), "label").unionByName(right.select(block.alias("block"), "node", F.lit(1).alias("side"), "label"))


def settle(cells: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root) of all nodes that links inside cells(pivot, node), a saved table, connect."""
    eps = 1 - num / den
    named = merged(None, saved(first_edges(cells, sets, num, den)))
    sizes = few(sets.select("node", "n"))
    regions = cells.unionByName(cells.select("pivot", F.col("pivot").alias("node")).distinct()).select(F.col("pivot").alias("region"), "pivot", "node", F.lit(None).cast("double").alias("away"))
    divides = True
    for level in range(DEPTH + 1):
        found = still_open(regions, named, sizes, eps)
        small = found.where("chunks <= 1").select(F.col("region").alias("block"), "node", (F.col("node") != F.col("pivot")).cast("int").alias("side"), "label")
        edges = saved(compare(saved(hopeful(saved(small), sets, num, den)), sets, num, den))
        large = saved(found.where("chunks > 1"))
        if not (n := large.count()):
            return merged(named, edges)
        if level == DEPTH or not divides:
            return merged(named, saved(edges.unionByName(compare(saved(hopeful(saved(by_parts(large)), sets, num, den, across=True)), sets, num, den, across=True))))
        cells_, near = divided(large, sets, eps, level)
        # windows may copy all members to all pivots: then the regions stay as they are, with what the pivots have linked
        divides = cells_.count() <= 2 * n
        regions = cells_ if divides else large.select("region", "pivot", "node", "away")
        named = merged(named, saved(edges.unionByName(near)))
    return named


def join_components(docs: DataFrame, shingle: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id per row, where num/den is the least similarity of a link."""
    twins = np.zeros(0, _U)
    for _ in range(2):
        table = saved(sets_table(docs, shingle, twins))
        n, shingles = table.agg(F.count("*"), F.sum("n_shingles")).first()
        nodes = table.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs"), (F.min("check") != F.max("check")).alias("twin"))
        nodes = saved(nodes, n)
        found = [r.node for r in nodes.where("twin").limit(TWINS + 1).collect()]
        if not found:
            break
        twins = np.sort(np.array(found, np.int64).view(_U))
    else:
        raise ValueError("sets that neither hash tells apart, or too many that one does not")
    cells = meetings(docs, shingle, num, den, twins, shingles or 0)
    wanted = cells.select("node").unionByName(cells.select(F.col("pivot").alias("node"))).distinct()
    wanted = saved(nodes.join(wanted, "node").select(F.col("least").alias("doc_id")), n)
    mine = docs.alias("d").join(few(wanted).alias("w"), F.expr("d.doc_id <=> w.doc_id"), "left_semi")
    sets = saved(hashed_sets(mine, shingle, twins))
    if sets.count() > wanted.count():  # rows that repeat a doc_id or a text
        sets = saved(sets.dropDuplicates(["node"]))
    named = settle(cells, sets, num, den)
    named = saved(named.unionByName(named.select(F.col("root").alias("node"), "root").distinct()), named.count())
    # a node of one document and no link has that document's own id
    told = nodes.join(few(named), "node", "left").where("docs > 1 OR root IS NOT NULL").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = saved(told.groupBy("root").agg(F.min("least").alias("component_id")), n)
    told = few(saved(told.join(few(ids), "root").select("node", "component_id")))
    return table.join(told, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
