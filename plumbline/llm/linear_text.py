"""What the two text classifiers share: hashed sparse features in tasks, collected samples, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textbytes as tb

#: (bytes, row offsets) -> (row, bucket, weight) of every feature occurrence, weights of a row summing to about 1 per kind.
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def sparse_rows(docs: DataFrame, features: Features) -> DataFrame:
    """doc_id, buckets (int32 bytes), weights (float32 bytes), one row per document."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column("doc_id")
            for start, end, buf, offs in tb.runs(batch.column("text")):
                row, bucket, weight = features(buf, offs)
                key = row.astype(np.int64) << 32 | bucket
                key, inverse = np.unique(key, return_inverse=True)
                total = np.bincount(inverse, weight, len(key)).astype("<f4")
                cut = np.searchsorted(key, np.arange(end - start + 1, dtype=np.int64) << 32)
                code = (key & 0xFFFFFFFF).astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, end - start),
                        pa.array([code[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                        pa.array([total[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    ],
                    ["doc_id", "buckets", "weights"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, buckets binary, weights binary")


class Csr:
    """A small sparse matrix gathered from ``sparse_rows``; products go over it in blocks of rows, so they need little memory."""

    def __init__(self, rows: list):
        self.starts = np.cumsum([0, *(len(r["buckets"]) // 4 for r in rows)])
        self.index = np.frombuffer(b"".join(bytes(r["buckets"]) for r in rows), "<i4")
        self.value = np.frombuffer(b"".join(bytes(r["weights"]) for r in rows), "<f4")
        self.n = len(rows)

    def _blocks(self, rows: int = 256):
        for a in range(0, self.n, rows):
            b = min(a + rows, self.n)
            s, e = self.starts[a], self.starts[b]
            yield a, b, self.index[s:e], self.value[s:e], np.repeat(np.arange(b - a), np.diff(self.starts[a : b + 1]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        parts = [np.bincount(row, value * w[index], b - a) for a, b, index, value, row in self._blocks()]
        return np.concatenate(parts) if parts else np.zeros(0)

    def gradient(self, per_row: np.ndarray, buckets: int) -> np.ndarray:
        out = np.zeros(buckets)
        for a, b, index, value, row in self._blocks():
            out += np.bincount(index, value * per_row[a:b][row], buckets)
        return out


def score(docs: DataFrame, features: Features, weights: np.ndarray, bias: float, name: str = "score") -> DataFrame:
    """docs plus the logistic score of bias + the weighted sum of a document's features (empty text: the bias alone)."""
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), float(bias)))
    kept = [f for f in docs.schema.fields if f.name != name]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]):
        w, b = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            out = np.empty(batch.num_rows)
            for start, end, buf, offs in tb.runs(batch.column("text")):
                row, bucket, weight = features(buf, offs)
                out[start:end] = np.bincount(row, weight * w[bucket], end - start)
            out = 1 / (1 + np.exp(-np.clip(out + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out)], [*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, f"{schema}, `{name}` double")

