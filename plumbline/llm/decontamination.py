"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive benchmark words. The two last words of a window position are
its block: a shift table says how far the search may jump for a block, blocks with shift zero
select a bucket of windows, and a direct comparison confirms an occurrence. Texts are scanned as
words, so a window may start at any word and separators do not matter.

Results in the corner cases: a null or empty text, or one without words, has no words and no hits;
an item without words is never found; an item with fewer words than a window is one window;
repeated rows are judged each for itself; other columns are passed through untouched unless they
carry the name of a result column, in which case the result replaces them.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.saved import saved

WINDOW = 13
#: Benchmark characters whose tables one pass over the documents holds in memory.
PASS_CHARS = 16_000_000

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def item_words(text: str | None) -> list[bytes]:
    """A-Z in lower case, then the maximal runs of digits, a-z and characters beyond ASCII."""
    return text.encode().translate(_FOLD).split() if text else []


class _Windows:
    """Shift table and buckets for the windows of items that share a window length, as numpy arrays.

    A block is the last two words of a window position (the only one of one-word windows) as one number, ``keys`` are the blocks
    in order. ``shift`` says for a hash of a block how far a search may jump: the least of the blocks that share it. Windows lie in buckets by their last block, inside a bucket by a hash
    of their words: ``order`` is both in one number, ``starts`` where each begins in ``words``, ``owner`` whose it is.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], size: int, base: int):
        self.size, self.block, self.base = size, min(2, size), base
        self.span = np.arange(size)
        self.factors = np.cumprod(np.full(size, 0x9E3779B97F4A7C15, np.uint64))
        self.words = np.concatenate([w for _, w in items])
        lengths = np.array([len(w) for _, w in items])
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(self.words)) - np.repeat(first, lengths)
        owner = np.repeat(np.array([i for i, _ in items]), lengths)
        ends = np.flatnonzero(place >= self.block - 1)
        keys = self.blocks(self.words)[ends - self.block + 1]
        self.keys, rank = np.unique(keys, return_inverse=True)
        self.bits = np.uint64(64 - min(24, 2 + len(self.keys).bit_length()))
        self.shift = np.full(1 << (64 - int(self.bits)), size - self.block + 1, np.min_scalar_type(size))
        np.minimum.at(self.shift, self.hashed(keys), np.maximum(0, size - 1 - place[ends]).astype(self.shift.dtype))
        whole = place[ends] >= size - 1
        starts = ends[whole] - size + 1
        order = self.ordered(rank[whole].reshape(-1), self.words, starts)
        by = np.argsort(order, kind="stable")
        self.order, self.starts, self.owner = order[by], starts[by], owner[starts[by]]

    def blocks(self, ids: np.ndarray) -> np.ndarray:
        return ids[:-1] * self.base + ids[1:] if self.block == 2 else ids

    def hashed(self, keys: np.ndarray) -> np.ndarray:
        return keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.bits

    def ordered(self, rank: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        mixed = np.empty(len(starts), np.uint64)
        for at in range(0, len(starts), 65536):
            some = ids[starts[at : at + 65536, None] + self.span].astype(np.uint64)
            mixed[at : at + 65536] = (some * self.factors).sum(axis=1)
        return (rank.astype(np.uint64) << np.uint64(40)) | (mixed >> np.uint64(24))

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Where windows begin in a text, and the owners of these windows."""
        n, found = len(ids), set()
        if n < self.size:
            return np.empty(0, np.int64), found
        keys = self.blocks(ids)
        jumps = self.shift[self.hashed(keys)].tobytes() if self.shift.dtype == np.uint8 else self.shift[self.hashed(keys)].tolist()
        at, back, stops = self.size - 1, self.block - 1, []
        while at < n:
            jump = jumps[at - back]
            if jump:
                at += jump
            else:
                stops.append(at)
                at += 1
        ends = np.array(stops, np.int64)
        rank = np.minimum(np.searchsorted(self.keys, keys[ends - back]), len(self.keys) - 1)
        same = self.keys[rank] == keys[ends - back]
        if not same.any():
            return np.empty(0, np.int64), found
        starts = ends[same] - self.size + 1
        want = self.ordered(rank[same], ids, starts)
        low = np.searchsorted(self.order, want)
        likely = self.order[np.minimum(low, len(self.order) - 1)] == want
        hits = []
        for start, k, w in zip(starts[likely].tolist(), low[likely].tolist(), want[likely], strict=True):
            text = ids[start : start + self.size]
            while k < len(self.order) and self.order[k] == w:
                if np.array_equal(self.words[self.starts[k] : self.starts[k] + self.size], text):
                    found.add(int(self.owner[k]))
                    hits.append(start)
                k += 1
        return np.array(hits, np.int64), found


class WuManber:
    """The windows of (item, text) pairs, grouped by window length, over numbered words. Made once on the driver from one block of
    items and broadcast: about 60 bytes a benchmark word, and its distinct words once."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.names: list[str | None] = []
        sizes: dict[int, list[tuple[int, np.ndarray]]] = {}
        names: dict[str | None, int] = {}
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in item_words(text)], np.int64)
            if len(ids):
                sizes.setdefault(min(window, len(ids)), []).append((names.setdefault(item, len(names)), ids))
        self.names = list(names)
        self.groups = [_Windows(found, size, len(self.number) + 1) for size, found in sorted(sizes.items())]

    def scan(self, words: list[bytes]) -> tuple[bytearray, set[str | None]]:
        """A mark for every word inside an occurrence, and the items whose windows occur."""
        ids = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        marks, items = bytearray(len(words)), set()
        for group in self.groups:
            starts, owners = group.occurrences(ids)
            for start in starts.tolist():
                marks[start : start + group.size] = b"\x01" * group.size
            items.update(self.names[i] for i in owners)
        return marks, items


def _runs(marks: bytearray) -> list[int]:
    """Flat start, end pairs of the marked runs."""
    out, at = [], marks.find(1)
    while at >= 0:
        end = marks.find(0, at)
        end = len(marks) if end < 0 else end
        out += [at, end]
        at = marks.find(1, end)
    return out


def _pass(docs: DataFrame, tables) -> DataFrame:
    """Adds what one block of items hits to hit_runs and hit_items."""
    names = [x for x in docs.columns if x not in ("n_words", "hit_runs", "hit_items")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)

    def scan(batches):
        search = tables.value
        for batch in batches:
            if not batch.num_rows:
                continue
            n_words, runs, found = [], [], []
            had = batch.column("hit_runs").to_pylist(), batch.column("hit_items").to_pylist()
            for text, old_runs, old_items in zip(batch.column("text"), *had, strict=True):
                words = item_words(text.as_py())
                marks, ids = search.scan(words)
                for s, e in zip(old_runs[::2], old_runs[1::2], strict=True):
                    marks[s:e] = b"\x01" * (e - s)
                n_words.append(len(words))
                runs.append(_runs(marks))
                found.append(sorted(ids.union(old_items), key=lambda x: (x is not None, x or "")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in names), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))],
                [*names, "n_words", "hit_runs", "hit_items"],
            )

    return docs.mapInArrow(scan, f"{schema}, n_words bigint, hit_runs array<bigint>, hit_items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_chars: int = PASS_CHARS) -> DataFrame:
    """docs plus n_words, n_hit, hit_runs (flat word start, end pairs), hit_items (sorted) and contaminated.

    The benchmark is sized first. Up to ``pass_chars`` characters its tables are broadcast once; a
    larger one is dealt into blocks of about that size, and the documents go through one pass per
    block, each saved in the shared folder, so neither the driver nor a task ever holds more than one
    block. A document is contaminated when it has a hit and 20 * n_hit >= n_words. Items without an id are one item,
    NULL, before all others in hit_items; rows that repeat an item_id add their windows to it.
    """
    spark: SparkSession = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // pass_chars))
    out = docs.drop("n_words", "n_hit", "hit_runs", "hit_items", "contaminated")
    out = out.withColumns({"hit_runs": F.array().cast("array<bigint>"), "hit_items": F.array().cast("array<string>")})
    for block in range(blocks):
        mine = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        tables = WuManber([(r["item"], r["text"]) for r in mine.toLocalIterator()], window)
        out = _pass(out, spark.sparkContext.broadcast(tables))
        if blocks > 1:
            out = saved(out)
    hit = F.aggregate(
        F.sequence(F.lit(0), F.floor(F.size("hit_runs") / 2).cast("int") - 1),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc + F.get("hit_runs", 2 * i + 1) - F.get("hit_runs", 2 * i),
    )
    out = out.withColumn("n_hit", F.when(F.size("hit_runs") > 0, hit).otherwise(F.lit(0).cast("bigint")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
