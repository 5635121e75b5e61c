"""Toxicity by non-negative positive-unlabelled learning.

A document is the densities of its words and of its words' first 3 to 8 bytes, hashed into buckets.
A linear scorer is fitted in numpy from confirmed toxic documents and from unlabelled ones with the
class-prior-corrected risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)): while the second term
is negative, only that term is stepped back, which is what keeps a flexible model from fitting it
below zero. Labels other than "confirmed toxic" serve for one number only, the class prior.

Sample bounds (the only bounded step; scoring covers all documents): ``positives`` and ``unlabelled``
documents, chosen by hash. Corner cases: a null or empty text scores the bias alone; no confirmed
toxic row at all gives weight zero everywhere and the prior as score; repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textbytes as tb
from plumbline.llm.linear_text import Csr, score, sparse_rows
from plumbline.llm.sampling import first_by_hash, held_out

BUCKETS = 1 << 18
#: Words that every text counts as having besides its own, so that one word of a very short text says little.
SMOOTH = 10
PREFIXES = (3, 4, 5, 6, 7, 8)


def features(buf: np.ndarray, offs: np.ndarray):
    """Whole words and word beginnings, each worth 1 / (words of the row + SMOOTH)."""
    buf = tb.LOWER[buf]
    starts, ends = tb.spans(tb.IS_ALNUM[buf], offs)
    row = tb.rows_of(starts, offs)
    prefix = tb.prefix_hash(buf)
    each = 1 / (np.bincount(row, minlength=len(offs) - 1) + SMOOTH)
    rows, buckets = [row], [(tb.span_hash(prefix, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int32)]
    for k in PREFIXES:
        longer = np.flatnonzero(ends - starts > k)
        s = starts[longer]
        rows.append(row[longer])
        buckets.append(((tb.span_hash(prefix, s, s + k) >> np.uint64(20)) & np.uint64(BUCKETS - 1)).astype(np.int32))
    row = np.concatenate(rows)
    return row, np.concatenate(buckets), each[row]


def fit_nnpu(positive: Csr, unlabelled: Csr, prior: float, buckets: int = BUCKETS, steps: int = 150, rate: float = 0.1, sparsity: float = 5e-3, least: int = 8):
    """(weights, bias) of the scorer that lowers the non-negative risk with the logistic loss.

    Buckets are scaled by their root mean square over the unlabelled sample, those in fewer than
    ``least`` positive documents stay at zero, and proximal steps with momentum keep the rest sparse.
    """
    w, b = np.zeros(buckets), float(np.log(prior / (1 - prior)))
    if not (positive.n and unlabelled.n):
        return w, b
    rms = np.sqrt(np.bincount(unlabelled.index, unlabelled.value**2, buckets) / unlabelled.n)
    scale = (np.bincount(positive.index, minlength=buckets) >= min(least, positive.n)) / (rms + 1e-3)
    speed, speed_b = np.zeros(buckets), 0.0
    for _ in range(steps):
        zp, zu = positive.dot(w * scale) + b, unlabelled.dot(w * scale) + b
        pp, pu = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
        rest = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        up, uu = prior * pp / positive.n, pu / unlabelled.n  # d of prior * R_p(-) and of R_u(-)
        if rest >= 0:
            gp, gu = prior * (pp - 1) / positive.n - up, uu
        else:
            gp, gu = up, -uu
        speed = 0.9 * speed - rate * scale * (positive.gradient(gp, buckets) + unlabelled.gradient(gu, buckets))
        w = w + speed
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity, 0)
        speed_b = 0.9 * speed_b - rate * (gp.sum() + gu.sum())
        b += speed_b
    return w * scale, float(b)


def train(docs: DataFrame, labels: DataFrame, positives: int = 1500, unlabelled: int = 4000, steps: int = 150):
    """(weights, bias) learned from the rows outside the held-out fold."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & ~held_out())
    totals = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    prior = min(max((totals["t"] or 0) / max(totals["n"], 1), 1e-3), 0.5)
    pos = first_by_hash(known.where("toxic = 1"), positives, 1).withColumn("kind", F.lit(1))
    unl = first_by_hash(docs.where(~held_out()), unlabelled, 2).withColumn("kind", F.lit(0))
    chosen = F.broadcast(pos.union(unl))  # at most positives + unlabelled ids
    kinds: dict = {}
    for r in chosen.collect():
        kinds.setdefault(r["doc_id"], []).append(r["kind"])
    found = sparse_rows(docs.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi"), features).collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["buckets"])))
    positive, others = (Csr([r for r in found if kind in kinds[r["doc_id"]]]) for kind in (1, 0))
    del found
    return fit_nnpu(positive, others, prior, steps=steps)


def score_toxicity(docs: DataFrame, model, name: str = "score") -> DataFrame:
    """docs plus a toxicity score from 0 to 1."""
    return score(docs, features, *model, name=name)
