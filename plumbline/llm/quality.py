"""Document quality by supervised subword embeddings.

Every document is the average of learned vectors of its hashed word n-grams and character n-grams;
a softmax over two classes reads that average. Vectors and output layer are trained by plain numpy
stochastic gradient descent. The n-grams are: words (split at white space, as written), the word
pair, for which all pairs of equal words share one vector, characters in threes, and the shape of a
word (which of upper case, lower case, digits and other characters it has).

Sample bound (the only bounded step; scoring covers all documents): ``per_class`` documents of each
class, chosen by hash and weighted back to the classes' shares. Corner cases: a null or empty text
scores the bias alone; when a class has no rows, all documents score the other class's share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textbytes as tb
from plumbline.llm.linear_text import Csr, score, sparse_rows
from plumbline.llm.sampling import first_by_hash, held_out

BUCKETS = 1 << 16
DIMENSIONS = 16
_KIND = np.full(256, 8, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 4, 0


def features(buf: np.ndarray, offs: np.ndarray):
    """(row, bucket, weight); the n-grams of one kind weigh 1 together in each row."""
    n_rows = len(offs) - 1
    starts, ends = tb.spans(~tb.IS_SPACE[buf], offs)
    row = tb.rows_of(starts, offs)
    word = tb.span_hash(tb.prefix_hash(buf), starts, ends)
    top = np.uint64(BUCKETS - 1)
    out = [(row, (word & top).astype(np.int32))]
    if len(word) > 1:
        pair = np.flatnonzero(row[1:] == row[:-1])
        same = word[pair] == word[pair + 1]
        both = tb.mix(word[pair] * np.uint64(0x9E3779B97F4A7C15) + word[pair + 1])
        out.append((row[pair], np.where(same, 7, (both & top).astype(np.int32)).astype(np.int32)))
    if len(starts):
        shape = np.bitwise_or.reduceat(_KIND[buf], starts)
        out.append((row, (shape.astype(np.int32) + 16 * np.minimum(ends - starts, 31)).astype(np.int32)))
    if len(buf) >= 3:
        three = np.arange(len(buf) - 2)
        at = np.repeat(np.arange(n_rows), np.diff(offs))
        inside = at[:-2] == at[2:]
        code = buf[:-2].astype(np.uint64) << np.uint64(16) | buf[1:-1].astype(np.uint64) << np.uint64(8) | buf[2:].astype(np.uint64)
        out.append((at[three[inside]], ((tb.mix(code[inside]) >> np.uint64(9)) & top).astype(np.int32)))
    weight = [(1 / np.maximum(np.bincount(r, minlength=n_rows), 1))[r] for r, _ in out]
    return np.concatenate([r for r, _ in out]), np.concatenate([b for _, b in out]), np.concatenate(weight)


def fit(x: Csr, label: np.ndarray, weight: np.ndarray, epochs: int = 6, rate: float = 2.0, batch: int = 16, seed: int = 1):
    """Trains vectors and softmax by SGD and folds them into one weight per bucket and a bias for class 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    out, bias = rng.normal(0, 0.3, (DIMENSIONS, 2)), np.zeros(2)
    share = np.clip(np.average(label, weights=weight), 1e-3, 1 - 1e-3) if len(label) else 0.5
    bias[:] = np.log([1 - share, share])
    todo = len(label) > 0 and 0 < label.sum() < len(label)
    for epoch in range(epochs if todo else 0):
        step = rate * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(x.n), max(1, x.n // batch)):
            take = np.concatenate([np.arange(x.starts[r], x.starts[r + 1]) for r in rows])
            local = np.repeat(np.arange(len(rows)), x.starts[rows + 1] - x.starts[rows])
            index, value = x.index[take], x.value[take, None]
            part = vectors[index] * value
            mean = np.zeros((len(rows), DIMENSIONS))
            np.add.at(mean, local, part)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), label[rows]] -= 1
            p *= weight[rows, None] / len(rows)
            back = p @ out.T
            out -= 0.2 * step * (mean.T @ p)
            bias -= 0.2 * step * p.sum(0)
            np.add.at(vectors, index, -step * len(rows) * value * back[local])
    gain = out[:, 1] - out[:, 0]
    return (vectors @ gain if todo else np.zeros(BUCKETS)), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1200, epochs: int = 6):
    """(weights, bias) learned from the labelled rows outside the held-out fold; a doc_id labelled both ways counts as 1."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    totals = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    parts = [first_by_hash(known.where(F.col("quality") == q), per_class, 3 + q).withColumn("label", F.lit(q)) for q in (0, 1)]
    chosen = {r["doc_id"]: r["label"] for r in parts[0].union(parts[1]).collect()}
    ids = docs.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id bigint")  # at most 2 * per_class
    found = sparse_rows(docs.join(F.broadcast(ids), "doc_id", "left_semi"), features).collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["buckets"])))
    label = np.array([chosen[r["doc_id"]] for r in found], int)
    seen = np.bincount(label, minlength=2)
    all_known = max(1, totals.get(0, 0) + totals.get(1, 0))
    weight = np.array([totals.get(q, 0) / all_known / max(seen[q], 1) for q in (0, 1)])[label] * len(label) if len(label) else np.zeros(0)
    return fit(Csr(found), label, weight, epochs)


def score_quality(docs: DataFrame, model, name: str = "score") -> DataFrame:
    """docs plus the probability that the document's quality label is 1."""
    return score(docs, features, *model, name=name)
