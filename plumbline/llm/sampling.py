"""Bounded, reproducible training samples and the fold rule of the labelled queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id"):
    """True for the fold whose labels are never learned from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def first_by_hash(ids: DataFrame, limit: int, salt: int) -> DataFrame:
    """At most ``limit`` of the ids, in the order of a salted hash: the same rows on every run."""
    order = F.xxhash64(F.col("doc_id"), F.lit(salt))
    return ids.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(order, "doc_id").limit(limit)
