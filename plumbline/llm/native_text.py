"""Column expressions on word arrays: no Python runs on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with ``value`` evaluated once per row, also where lambdas inside ``body`` use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column, between: str) -> Column:
    """The non-empty parts of ``text`` between matches of a regular expression; null is empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), between), lambda w: w != "")


def shingle_hashes(words: Column, k: int) -> Column:
    """64-bit hashes of all k-word shingles in text order; 1 to k-1 words count as one shingle, none give an empty array."""

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        whole = F.array(F.aggregate(hashes, n.cast("bigint"), lambda acc, h: F.xxhash64(acc, h)))
        many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(hashes[i + j] for j in range(k))))
        return F.when(n >= k, many).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)
