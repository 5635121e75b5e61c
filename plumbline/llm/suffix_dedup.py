"""Removal of repeated byte strings with suffix-array shards.

Every byte of a document that lies in a string of ``length`` bytes which also starts earlier (in a
document with a smaller doc_id, or earlier in the same one) goes; strings are judged on the input.

A whole corpus is not one array. Each string (window) of ``length`` bytes is assigned to an anchor inside it: the
leftmost least hash among its 20-byte grams, so equal windows have equal anchors at equal places.
Neighbouring windows with one anchor are a piece. Pieces meet by anchor in one shuffle:
* equal pieces: all but the earliest are repeats, decided at once, already inside an Arrow batch
  before the shuffle, so a passage that a third of all documents hold arrives once a batch;
* different pieces with one anchor, each by its earliest copy, may share some of their windows, if what
  stands next to the anchor on one side is the same (a window reaches at least 40 bytes to one side of its
  anchor; 24-bit hashes of both neighbourhoods travel with a piece). The bytes of those
  that do are fetched and go to suffix-array shards, whole anchors together: induced sorting orders a
  shard's suffixes, the permuted common prefixes cut the order into groups that agree in ``length``
  bytes or more, and in each group every start but the earliest is a repeat.
An anchor with more than ``SHARD_PIECES`` different pieces, too many for a task, has its windows
compared by 128-bit hash with a grouped aggregation instead.

Corner cases: null texts are empty; texts shorter than ``length`` keep all bytes; rows that repeat
a doc_id with another text are ordered among each other by a hash of the text, and equal rows are kept or cut alike, judged
as one document; a null doc_id comes before all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textbytes as tb
from plumbline.llm.saved import saved
from plumbline.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 100
GRAM = 20
SHARD_BYTES = 1 << 20
SHARD_PIECES = 20_000
_U = np.uint64
_COLUMNS = ("kind", "anchor", "piece", "doc", "copy", "start", "count")
_SCHEMA = "kind int, anchor bigint, piece bigint, doc bigint, copy bigint, start bigint, count bigint"
REPEAT, CANDIDATE = 1, 0


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values (block minima from both sides)."""
    n = len(values)
    if n < width:
        return values[:0]
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, _U)
    full[:n] = values
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def pieces(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH):
    """(row, first window's start in the row, windows and neighbourhoods packed, anchor hash, piece hash) of the pieces of a run.

    Packed: windows in the low 8 bits, then 24 bits each for the left and the right neighbourhood, 0 where the text ends before.
    """
    n = len(buf)
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(_U), empty.astype(_U)
    prefix = tb.prefix_hash(buf)
    at = np.arange(n - GRAM + 1)
    grams = tb.span_hash(prefix, at, at + GRAM)
    anchor = (_least((grams & _U(0xFFFFFFFF00000000)) | at.astype(_U), length - GRAM + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offs)
    windows = np.maximum(size - length + 1, 0)
    row = np.repeat(np.arange(len(size)), windows)
    if not len(row):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(_U), empty.astype(_U)
    start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + offs[row]
    mine = anchor[start]
    new = np.ones(len(row), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(row)))
    row, start, mine = row[first], start[first], mine[first]
    whole = tb.mix(tb.span_hash(prefix, start, start + count + length - 1) + (mine - start).astype(_U))
    side = (length - GRAM) // 2
    packed = count.astype(_U)
    for far, near, has, shift in ((mine - side, mine + GRAM, mine - side >= offs[row], 8), (mine, mine + GRAM + side, mine + GRAM + side <= offs[row + 1], 32)):
        around = np.zeros(len(mine), _U)
        around[has] = 1 + (tb.span_hash(prefix, far[has], near[has]) >> _U(41))
        packed |= around << _U(shift)
    return row, start - offs[row], packed.view(np.int64), grams[mine], whole


def _batch(kind, anchor, piece, doc, copy, start, count) -> pa.RecordBatch:
    arrays = [pa.array(np.asarray(kind, np.int32)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (anchor, piece, doc, copy, start, count))]
    return pa.RecordBatch.from_arrays(arrays, list(_COLUMNS))


def _spread(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    return tb.mix(doc.view(_U) * _U(31) + start.view(_U))


def piece_rows(docs: DataFrame, length: int) -> DataFrame:
    """Pieces of docs(doc, copy, text): the earliest of equal ones in a batch as CANDIDATE, joined runs of all others as REPEAT."""

    def run(batches):
        for batch in batches:
            docs_, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "copy"))
            parts = []
            for first, _, buf, offs in tb.runs(batch.column("text")):
                row, start, count, anchor, whole = pieces(buf, offs, length)
                parts.append((row + first, start, count, anchor, whole))
            if not parts or not sum(len(p[0]) for p in parts):
                continue
            row, start, count, anchor, whole = (np.concatenate(c) for c in zip(*parts, strict=True))
            doc, copy = docs_[row], copies[row]
            order = np.lexsort((start, copy, doc, whole, anchor))
            a, w = anchor[order], whole[order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
            lead = np.zeros(len(order), bool)
            lead[order[new]] = True
            yield _batch(np.zeros(lead.sum()), anchor[lead], whole[lead], doc[lead], copy[lead], start[lead], count[lead])
            count = count & 0xFF
            rest = np.flatnonzero(~lead)  # still in text order
            if len(rest):
                joined = np.ones(len(rest), bool)
                joined[1:] = (np.diff(rest) != 1) | (row[rest[1:]] != row[rest[:-1]])
                head = np.flatnonzero(joined)
                total = np.add.reduceat(count[rest], head)
                h = rest[head]
                yield _batch(np.ones(len(h)), _spread(doc[h], start[h]), np.zeros(len(h), np.int64), doc[h], copy[h], start[h], total)

    return docs.mapInArrow(run, _SCHEMA)


def decide(rows: DataFrame) -> DataFrame:
    """Pieces gathered by anchor: REPEAT rows, and as CANDIDATE the earliest copies of different pieces with one anchor."""

    def alike(cols):
        """Pieces whose anchor is shared by a different piece with the same neighbourhood on one side."""
        keep = np.zeros(len(cols[0]), bool)
        for shift in (8, 32):
            around = (cols[5].view(_U) >> _U(shift)) & _U(0xFFFFFF)
            _, inverse, size = np.unique(tb.mix(cols[0].view(_U) ^ tb.mix(around)), return_inverse=True, return_counts=True)
            keep |= (size[inverse] > 1) & (around > 0)
        cols = [c[keep] for c in cols]
        cols[5] = cols[5] & 0xFF
        return cols

    def run(batches):
        held: list[np.ndarray] | None = None  # earliest copies of the anchor that goes on into the next batch
        last = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in _COLUMNS]
            done = cols[0] == REPEAT
            if done.any():
                yield _batch(*(c[done] for c in cols))
            cols = [c[~done] for c in cols[1:]]
            anchor, piece = cols[0], cols[1]
            if not len(anchor):
                continue
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
            if last is not None:
                new[0] = (anchor[0], piece[0]) != last
            last = (anchor[-1], piece[-1])
            if not new.all():
                again = [c[~new] for c in cols]
                again[5] = again[5] & 0xFF
                yield _batch(np.ones(len(again[0])), *again)
            cols = [c[new] for c in cols]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            stays = cols[0] == anchor[-1]
            held = [c[stays] for c in cols]
            cols = [c[~stays] for c in cols]
            if len(cols[0]):
                cols = alike(cols)
                if len(cols[0]):
                    yield _batch(np.zeros(len(cols[0])), *cols)
        if held is not None:
            held = alike(held)
            if len(held[0]):
                yield _batch(np.zeros(len(held[0])), *held)

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "piece", "doc", "copy", "start")
    return dealt.mapInArrow(run, _SCHEMA)


_SLICES = "anchor bigint, doc bigint, copy bigint, start bigint, count bigint, raw binary"


def slices(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted pieces (anchor, doc, copy, start, count)."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, copy, text, asked in zip(*(batch.column(c) for c in ("doc", "copy", "text", "asked")), strict=True):
                raw = (text.as_py() or "").encode()
                for x in asked.as_py():
                    out.append((x["anchor"], doc.as_py(), copy.as_py(), x["start"], x["count"], raw[x["start"] : x["start"] + x["count"] + length - 1]))
            if out:
                types = (*[pa.int64()] * 5, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["anchor", "doc", "copy", "start", "count", "raw"])

    asked = wanted.groupBy("doc", "copy").agg(F.collect_list(F.struct("anchor", "start", "count")).alias("asked"))  # bounded by the document
    return docs.join(asked, ["doc", "copy"]).select("doc", "copy", "text", "asked").mapInArrow(run, _SLICES)


def shard_repeats(rows: list[tuple], length: int) -> list[tuple]:
    """(doc, copy, start, count) of repeated windows among pieces (doc, copy, start, count, raw) of one shard."""
    rows = sorted(rows, key=lambda r: r[:3])
    text = b"".join(r[4] for r in rows)
    sizes = np.array([len(r[4]) for r in rows])
    base = np.cumsum(sizes) - sizes
    counts = np.array([r[3] for r in rows])
    owner = np.repeat(np.arange(len(rows)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    spot = base[owner] + inner
    order = np.array(suffix_array(text))
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(common_prefixes(text, order, length)[order] < length)
    mine = group[spot]
    _, first = np.unique(mine, return_index=True)
    again = np.ones(len(spot), bool)
    again[first] = False
    hit = np.flatnonzero(again)
    if not len(hit):
        return []
    cut = np.ones(len(hit), bool)
    cut[1:] = (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])
    head = np.flatnonzero(cut)
    run = np.diff(np.append(head, len(hit)))
    return [(*rows[owner[h]][:2], int(rows[owner[h]][2] + inner[h]), int(c)) for h, c in zip(hit[head], run, strict=True)]


def shards(pieces_: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """REPEAT rows from suffix arrays over whole anchors, about shard_bytes at a time."""

    def run(batches):
        held, size, anchor = [], 0, None
        for batch in batches:
            out = []
            for a, *rest in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "copy", "start", "count", "raw")), strict=True):
                if a != anchor and size >= shard_bytes:
                    out += shard_repeats(held, length)
                    held, size = [], 0
                anchor = a
                held.append(tuple(rest))
                size += len(rest[4])
            if out:
                yield _found(out)
        if held and (out := shard_repeats(held, length)):
            yield _found(out)

    def _found(out):
        doc, copy, start, count = (np.array(c, np.int64) for c in zip(*out, strict=True))
        return _batch(np.ones(len(doc)), doc, doc, doc, copy, start, count)

    dealt = pieces_.repartition("anchor").sortWithinPartitions("anchor", "doc", "copy", "start")
    return dealt.mapInArrow(run, _SCHEMA)


def hashed_windows(pieces_: DataFrame, length: int) -> DataFrame:
    """REPEAT rows for anchors with too many different pieces: windows compared by hash, grouped with partial sums."""

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                digests = [hashlib.blake2b(x["raw"][i : i + length], digest_size=16).digest() for i in range(x["count"])]
                n = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array([x["doc"]] * n, pa.int64()), pa.array([x["copy"]] * n, pa.int64()), pa.array(range(x["start"], x["start"] + n), pa.int64())],
                    ["window", "doc", "copy", "start"],
                )

    rows = saved(pieces_.mapInArrow(run, "window binary, doc bigint, copy bigint, start bigint"))
    first = rows.groupBy("window").agg(F.min(F.struct("doc", "copy", "start")).alias("first"))
    again = rows.join(first, "window").where(F.struct("doc", "copy", "start") > F.col("first"))
    return again.select(F.lit(REPEAT).alias("kind"), F.col("doc").alias("anchor"), F.col("doc").alias("piece"), "doc", "copy", "start", F.lit(1).cast("bigint").alias("count"))


def repeats(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(doc, copy, start, count): ranges of window starts that repeat an earlier window of docs(doc, copy, text)."""
    if not 2 * GRAM <= length <= 255:
        raise ValueError("strings of 40 to 255 bytes")  # windows of a piece are counted in 8 bits
    found = saved(decide(piece_rows(docs, length)))
    candidates = found.where(F.col("kind") == CANDIDATE).select("anchor", "doc", "copy", "start", "count")
    cut = slices(docs, candidates, length)
    crowd = candidates.groupBy("anchor").count().where(F.col("count") > shard_pieces).select("anchor")
    out = found.where(F.col("kind") == REPEAT)
    if crowd.limit(1).count():
        cut = saved(cut)
        out = out.unionByName(hashed_windows(cut.join(crowd, "anchor", "left_semi"), length))
        cut = cut.join(crowd, "anchor", "left_anti")
    return out.unionByName(shards(cut, length, shard_bytes)).select("doc", "copy", "start", "count")


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, binary) of docs(doc_id, text)."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc"), "doc_id", "text")
    repeated = base.groupBy("doc").count().where("count > 1").limit(1).count() > 0
    base = base.withColumn("copy", F.xxhash64(F.coalesce("text", F.lit(""))) if repeated else F.lit(0).cast("bigint"))
    one = base.select("doc", "copy", "text")
    one = one.dropDuplicates(["doc", "copy"]) if repeated else one
    ranges = repeats(one, length).groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "count")).alias("ranges"))  # bounded by the document

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, ranges_ in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("ranges").to_pylist(), strict=True):
                raw, kept, at, gone, spans, end = (text.as_py() or "").encode(), [], 0, 0, 0, -1
                for start, stop in sorted((x["start"], x["start"] + x["count"] + length - 1) for x in ranges_ or ()):
                    if start > end:
                        kept.append(raw[at:start])
                        spans += 1
                    gone += stop - max(start, end) if stop > end else 0
                    end = max(end, stop)
                    at = end
                kept.append(raw[at:])
                out.append((doc, len(raw), gone, spans, b"".join(kept)))
            if out:
                types = (*[pa.int64()] * 4, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = base.join(ranges, ["doc", "copy"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
