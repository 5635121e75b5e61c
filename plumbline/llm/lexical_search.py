"""Ranked lexical search by pair-bound MaxScore over a document-partitioned index.

``build_index`` writes one row per block of documents: their ids and lengths, the block's terms and each term's
postings (document of the block, occurrences). It holds every term of every document and no text, needs no shuffle, and
serves any set of queries. ``search`` takes the queries in passes of bounded size:

1. document frequencies of the pass's terms, summed over the index, give their weights;
2. ``pair_lists`` keeps what the pass needs of each block and precomputes term pairs: every query's terms, heaviest
   first, are taken two by two, and for each pair and block the documents that hold both are listed, with the largest
   impact of both together and of either alone. The larger of the two bounds the pair, and is less than the sum of the
   two terms' own maxima wherever their best documents differ;
3. a block is skipped for a query when the sum of its pair bounds is below the tenth best score known; otherwise pairs
   are split as in MaxScore, by least bound first: those that cannot reach that score even together are only looked up
   for documents found through the others, largest first, and a document is given up as soon as what is left cannot
   lift it. The tenth best score starts from documents of the pair lists that were scored in step 2, one a block, and
   rises as a task goes through its blocks. Only what falls strictly below it is left out, so ties are decided by id.

Scores (64-bit integers, division rounds down): N documents with a term, L occurrences of all terms, n of a document,
df documents with a term, tf occurrences: w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 100 - B + (B n N) div L with
B = 90, and a document's score sums w (10^9 tf div (1000 tf + 8 m)) over a query's terms, once each.

A task holds one block (about ``BLOCK_BYTES`` of text, or one longer text) and one pass of queries; the driver holds one
pass of queries and the frequencies of its terms. Corner cases: null, empty and wordless texts are in no count and
in no result; queries without terms, or whose terms no document holds, give no rows; rows that repeat an item_id are one
query of all their terms, a null item_id likewise; repeated documents are ranked each for itself, rows of equal score by
doc_id, null last; an empty table on either side gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import textbytes as tb
from plumbline.llm.saved import saved

BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 16_384
#: Characters of queries whose lists one pass holds.
PASS_CHARS = 2_000_000
TOP, B = 10, 90
_NO_ID = np.iinfo(np.int64).max

_FOLD = np.full(256, 32, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _FOLD[_b] = _b
_FOLD[65:91] = np.arange(97, 123)

_INDEX = "doc_ids binary, sizes binary, docs_with bigint, occurrences bigint, terms array<string>, starts binary, docs binary, counts binary"
_LISTS = (
    "doc_ids binary, sizes binary, codes binary, starts binary, docs binary, counts binary, "
    "bounds binary, joint_starts binary, joint_docs binary, joint_max binary, seeds array<bigint>"
)


def _types(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
    return [(n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))]


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    types = _types(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], [n for n, _ in types])


def _rows(batch: pa.RecordBatch, names) -> Iterator[dict]:
    """The rows of a batch; term lists stay Arrow arrays."""
    for i in range(batch.num_rows):
        yield {n: v.values if n == "terms" else v.as_py() for n, v in ((n, batch.column(n)[i]) for n in names)}


def _terms(buf: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of a run of rows and the row of each."""
    folded = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(np.ascontiguousarray(offs)), pa.py_buffer(_FOLD[buf]))
    parts = pc.split_pattern(folded, " ")
    words, row = parts.flatten(), pc.list_parent_indices(parts)
    filled = pc.greater(pc.binary_length(words), 0)
    return words.filter(filled), row.filter(filled).to_numpy(zero_copy_only=False)


def query_terms(text: str | None) -> set[str]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return {w.decode() for w in _FOLD[raw].tobytes().split()}


def _index_blocks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        for first, end, buf, offs in tb.runs(batch.column("text"), BLOCK_BYTES):
            for a in range(0, end - first, BLOCK_DOCS):
                b = min(a + BLOCK_DOCS, end - first)
                part = offs[a : b + 1]
                words, row = _terms(buf[part[0] : part[-1]], part - part[0])
                coded = words.dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                key, count = np.unique(code * (b - a) + row, return_counts=True)
                sizes = np.bincount(row, minlength=b - a)
                starts = np.searchsorted(key, np.arange(len(coded.dictionary) + 1) * (b - a))
                yield _batch(_INDEX, [(
                    ids[first + a : first + b].astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), int((sizes > 0).sum()), int(sizes.sum()),
                    coded.dictionary.to_pylist(), starts.astype("<i4").tobytes(), (key % (b - a)).astype("<u2").tobytes(), count.astype("<i4").tobytes(),
                )])


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all documents, as a saved table of blocks."""
    return saved(docs.select("doc_id", "text").mapInArrow(_index_blocks, _INDEX))


class Queries:
    """A pass of queries: numbered terms, pairs of terms, and each query's pairs in one flat list."""

    def __init__(self, items: dict, weights: dict[str, int], documents: int, occurrences: int):
        self.documents, self.occurrences = documents, occurrences
        self.items = [i for i in items if items[i] & weights.keys()]
        self.terms = sorted(set().union(*(items[i] for i in self.items)) & weights.keys())
        number = {t: k for k, t in enumerate(self.terms)}
        self.weight = np.array([weights[t] for t in self.terms], np.int64)
        pairs: dict[tuple[int, int], int] = {}
        self.pairs_of, self.first = [], [0]
        for item in self.items:
            mine = sorted((number[t] for t in items[item] if t in number), key=lambda k: (-self.weight[k], k))
            mine += [-1] * (len(mine) % 2)
            self.pairs_of += [pairs.setdefault(p, len(pairs)) for p in zip(mine[::2], mine[1::2], strict=True)]
            self.first.append(len(self.pairs_of))
        self.pairs = list(pairs)
        self.pairs_of = np.array(self.pairs_of, np.int64)
        self.first = np.array(self.first)


class Block:
    """Postings of a block with their impacts for the terms of a pass."""

    def __init__(self, queries: Queries, sizes, codes, starts, docs, counts):
        n = sizes.astype(np.int64)
        m = 100 - B + (B * n * queries.documents) // max(1, queries.occurrences)
        tf = counts.astype(np.int64)
        weight = np.repeat(queries.weight[codes], np.diff(starts))
        self.docs = docs
        self.impact = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
        self.begin = np.zeros(len(queries.terms) + 1, np.int64)  # the last stands for the missing half of a pair
        self.end = np.zeros(len(queries.terms) + 1, np.int64)
        self.begin[codes], self.end[codes] = starts[:-1], starts[1:]
        self.n = len(sizes)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.begin[term], self.end[term]
        return self.docs[a:b], self.impact[a:b]

    def look_up(self, term: int, docs: np.ndarray) -> np.ndarray:
        """Impacts of a term in some of the documents."""
        mine, impact = self.postings(term)
        if not len(mine):
            return np.zeros(len(docs), np.int64)
        at = np.minimum(np.searchsorted(mine, docs), len(mine) - 1)
        return np.where(mine[at] == docs, impact[at], 0)


def _kept(queries: Queries, row: dict):
    """What a block holds of the pass's terms: codes, starts, docs, counts."""
    code = pc.index_in(row["terms"], value_set=pa.array(queries.terms, pa.string()))
    have = np.flatnonzero(pc.is_valid(code).to_numpy(zero_copy_only=False))
    code = code.fill_null(0).to_numpy(zero_copy_only=False)[have].astype(np.int64)
    starts = np.frombuffer(row["starts"], "<i4").astype(np.int64)
    size = starts[have + 1] - starts[have]
    at = np.arange(int(size.sum())) + np.repeat(starts[have] - (np.cumsum(size) - size), size)
    return code, np.append(0, np.cumsum(size)), np.frombuffer(row["docs"], "<u2")[at], np.frombuffer(row["counts"], "<i4")[at]


def _seed(queries: Queries, block: Block, item: int, joint) -> int:
    """The full score of the query's most promising document of a pair list: a score that some document has."""
    best = max((joint[p] for p in queries.pairs_of[queries.first[item] : queries.first[item + 1]]), default=(0, 0))
    if not best[0]:
        return 0
    doc = np.array([best[1]])
    return sum(int(block.look_up(t, doc)[0]) for p in queries.pairs_of[queries.first[item] : queries.first[item + 1]] for t in queries.pairs[p])


def _list_blocks(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        queries: Queries = shared.value
        for batch in batches:
            for row in _rows(batch, ("doc_ids", "sizes", "terms", "starts", "docs", "counts")):
                kept = _kept(queries, row)
                block = Block(queries, np.frombuffer(row["sizes"], "<i4"), *kept)
                bounds, joint_max, lists, joint = np.zeros(len(queries.pairs), np.int64), np.zeros(len(queries.pairs), np.int64), [], []
                for p, (a, b) in enumerate(queries.pairs):
                    (da, ia), (db, ib) = block.postings(a), block.postings(b)
                    both, in_a, in_b = np.intersect1d(da, db, assume_unique=True, return_indices=True) if len(da) and len(db) else (da[:0], [], [])
                    alone = max(ia.max(initial=0), ib.max(initial=0))
                    if len(both):
                        sums = ia[in_a] + ib[in_b]
                        top = int(sums.argmax())
                        joint_max[p] = sums[top]
                        joint.append((int(sums[top]), int(both[top])))
                    else:
                        joint.append((int(alone), int(da[ia.argmax()] if len(da) and ia.max() == alone else db[ib.argmax()])) if alone else (0, 0))
                    bounds[p] = max(alone, joint_max[p])
                    lists.append(both)
                seeds = [_seed(queries, block, i, joint) for i in range(len(queries.items))]
                sizes = np.append(0, np.cumsum([len(x) for x in lists]))
                flat = np.concatenate(lists) if lists else np.zeros(0)
                code, starts, docs, counts = kept
                yield _batch(_LISTS, [(
                    row["doc_ids"], row["sizes"], code.astype("<i4").tobytes(), starts.astype("<i4").tobytes(), docs.tobytes(), counts.tobytes(),
                    bounds.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), flat.astype("<u2").tobytes(), joint_max.astype("<i8").tobytes(), seeds,
                )])

    return run


class Best:
    """The best TOP documents of every query of a pass so far, and the score to reach."""

    def __init__(self, floor: np.ndarray):
        self.floor = floor.copy()
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in floor]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        have, had = self.rows[item]
        scores, ids = np.concatenate([have, scores]), np.concatenate([had, ids])
        order = np.lexsort((ids, -scores))[:TOP]
        self.rows[item] = scores[order], ids[order]
        if len(order) == TOP:
            self.floor[item] = max(self.floor[item], scores[order[-1]])


def score_block(queries: Queries, block: Block, ids: np.ndarray, bounds: np.ndarray, best: Best) -> int:
    """Adds a block's documents to ``best``; the number of queries that the block was not skipped for."""
    of = bounds[queries.pairs_of]
    total = np.add.reduceat(of, queries.first[:-1])
    open_ = np.flatnonzero((total > 0) & (total >= best.floor))
    for item in open_:
        a, b = queries.first[item], queries.first[item + 1]
        order = np.argsort(of[a:b], kind="stable")
        bound, pairs, floor = of[a:b][order], queries.pairs_of[a:b][order], int(best.floor[item])
        below = np.cumsum(bound)
        split = int(np.searchsorted(below, max(floor, 1), "left"))  # pairs before it cannot reach the floor together
        score, seen = np.zeros(block.n, np.int64), np.zeros(block.n, bool)
        for p in pairs[split:]:
            for term in queries.pairs[p]:
                docs, impact = block.postings(term)
                score[docs] += impact
                seen[docs] = True
        left = int(below[split - 1]) if split else 0
        docs = np.flatnonzero(seen & (score + left >= floor))
        for k in range(split - 1, -1, -1):
            if not len(docs):
                break
            for term in queries.pairs[pairs[k]]:
                score[docs] += block.look_up(term, docs)
            left -= int(bound[k])
            docs = docs[score[docs] + left >= floor]
        docs = docs[score[docs] > 0]
        if len(docs):
            best.add(item, score[docs], ids[docs])
    return len(open_)


def _search_blocks(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        queries, floor = shared.value
        best = Best(floor)
        names = ["doc_ids", "sizes", "codes", "starts", "docs", "counts", "bounds"]
        kinds = dict(zip(names, ("<i8", "<i4", "<i4", "<i4", "<u2", "<i4", "<i8"), strict=True))
        for batch in batches:
            for row in _rows(batch, names):
                x = {n: np.frombuffer(row[n], kinds[n]) for n in names}
                block = Block(queries, x["sizes"], x["codes"], x["starts"].astype(np.int64), x["docs"], x["counts"])
                score_block(queries, block, x["doc_ids"], x["bounds"], best)
        out = [(i, None if d == _NO_ID else int(d), int(s)) for i, (scores, ids) in enumerate(best.rows) for s, d in zip(scores, ids, strict=True)]
        if out:
            item, doc, score = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["query", "doc_id", "score"])

    return run


def _frequencies(index: DataFrame, terms: set[str]) -> dict[str, int]:
    """The documents that hold each of the terms (of one pass)."""
    wanted = index.sparkSession.sparkContext.broadcast(pa.array(sorted(terms), pa.string()))

    def run(batches):
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for row in _rows(batch, ("terms", "starts")):
                at = pc.index_in(row["terms"], value_set=wanted.value)
                have = pc.is_valid(at).to_numpy(zero_copy_only=False)
                total[at.filter(pa.array(have)).to_numpy(zero_copy_only=False)] += np.diff(np.frombuffer(row["starts"], "<i4"))[have]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([wanted.value.take(pa.array(some)), pa.array(total[some])], ["term", "df"])

    found = index.select("terms", "starts").mapInArrow(run, "term string, df bigint")
    return {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def pair_lists(index: DataFrame, queries: Queries) -> DataFrame:
    """The pass's part of every block, with pair lists, pair bounds and a score that some document has, per query."""
    shared = index.sparkSession.sparkContext.broadcast(queries)
    return saved(index.mapInArrow(_list_blocks(shared), _LISTS))


def _floors(lists: DataFrame, queries: int) -> np.ndarray:
    """For each query the TOP-th largest seed; seeds of different blocks are different documents."""
    seeds = lists.select(F.posexplode("seeds").alias("query", "score")).where("score > 0")
    ranked = seeds.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("rank") <= TOP)
    floor = np.zeros(queries, np.int64)
    for r in ranked.where(F.col("rank") == TOP).collect():
        floor[r["query"]] = r["score"]
    return floor


def search(index: DataFrame, items: DataFrame, pass_chars: int = PASS_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP documents with a score above 0 of every query."""
    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum("docs_with"), F.lit(0)), F.coalesce(F.sum("occurrences"), F.lit(0))).first()
    kind = items.schema["item_id"].dataType.simpleString()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-chars // pass_chars))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for k in range(passes):
        mine = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        texts: dict = {}
        for r in mine.select("item_id", "text").toLocalIterator():
            texts.setdefault(r["item_id"], set()).update(query_terms(r["text"]))
        df = _frequencies(index, set().union(*texts.values()))
        weights = {t: math.floor(1000 * math.log((2 * total[0] + 2) / (2 * n + 1))) for t, n in df.items()}
        queries = Queries(texts, weights, *total)
        if not queries.items:
            continue
        lists = pair_lists(index, queries)
        shared = spark.sparkContext.broadcast((queries, _floors(lists, len(queries.items))))
        found = lists.mapInArrow(_search_blocks(shared), "query int, doc_id bigint, score bigint")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
        names = spark.createDataFrame(list(enumerate(queries.items)), f"query int, item_id {kind}")
        ranked = ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # one row per query of the pass
        out = out.unionByName(saved(ranked) if passes > 1 else ranked)
    return out
