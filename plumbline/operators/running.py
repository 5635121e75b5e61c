"""Running values over groups of any size: no task holds a whole group.

The order is cut into blocks of about equal size at quantiles of all rows, as many as there are shuffle partitions. Windows run within a
group's blocks, and one row per group and block carries the value on from block to block. Any bounds give the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def blocks(rows: DataFrame, order: str) -> DataFrame:
    """rows with ``_block``, which never falls as ``order`` rises; equal values share a block, NULL comes first. An order that is no number is one block."""
    if not isinstance(rows.schema[order].dataType, NumericType):
        return rows.withColumn("_block", F.lit(0))
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.approxQuantile(order, [i / many for i in range(1, many)], 1 / (4 * many)) if many > 1 else []
    bounds = sorted({float(b) for b in found} - {float("inf"), float("-inf")})
    if not bounds:
        return rows.withColumn("_block", F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_at", outputCol="_block", handleInvalid="keep")
    placed = cut.transform(rows.withColumn("_at", F.col(order).cast("double"))).drop("_at")
    return placed.withColumn("_block", F.when(F.col(order).isNull(), -1).otherwise(F.col("_block").cast("int")))


def running(
    rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None, first: dict[str, Column] | None = None,
) -> DataFrame:
    """rows with more columns, in the order of ``order`` within ``keys`` (NULL is a key too); rows of equal order come in any order.

    sums: totals up to the row and with it, NULL counting as 0; last: the last value that is not NULL, the row's own included;
    before: the same without the row's own; after: the next value that is not NULL after the row; first: the first that is not NULL up to the row. An order that is no number takes a task a group.
    """
    sums, last, before, after, first = sums or {}, last or {}, before or {}, after or {}, first or {}
    placed, at = blocks(rows, order), F.col(order)
    # a value's order where there is a value: the block of NULL orders has no order, and any of its values will do
    edge = lambda by, v: F.coalesce(by(v, F.when(v.isNotNull(), at)), F.any_value(v, ignoreNulls=F.lit(True)))
    totals = placed.groupBy(*keys, "_block").agg(
        F.count("*").alias("_rows"), *(F.sum(c).alias(n) for n, c in sums.items()), *(edge(F.max_by, c).alias(n) for n, c in (last | before).items()), *(edge(F.min_by, c).alias(n) for n, c in (after | first).items())
    )
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    starts = totals.select(
        *(F.col(k).alias(f"_{k}") for k in keys), F.col("_block").alias("_of"), *(F.sum(n).over(ahead).alias(f"_{n}") for n in sums),
        *(F.last(n, ignorenulls=True).over(ahead).alias(f"_{n}") for n in last | before), *(F.first(n, ignorenulls=True).over(behind).alias(f"_{n}") for n in after),
        *(F.first(n, ignorenulls=True).over(ahead).alias(f"_{n}") for n in first),
    )
    order_in = Window.partitionBy(*keys, "_block").orderBy(order)
    upto, past = order_in.rowsBetween(Window.unboundedPreceding, 0), order_in.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys, "_block").orderBy(at.desc()).rowsBetween(Window.unboundedPreceding, -1)
    values = {n: F.sum(c).over(upto) for n, c in sums.items()} | {n: F.last(c, ignorenulls=True).over(upto) for n, c in last.items()}
    values |= {n: F.last(c, ignorenulls=True).over(past) for n, c in before.items()} | {n: F.last(c, ignorenulls=True).over(back) for n, c in after.items()}
    values |= {n: F.first(c, ignorenulls=True).over(upto) for n, c in first.items()}
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("_block") == F.col("_of"))
    none = F.lit(0).cast("bigint")
    out = {n: F.coalesce(n, none) + F.coalesce(f"_{n}", none) for n in sums} | {n: F.coalesce(n, f"_{n}") for n in last | before | after} | {n: F.coalesce(f"_{n}", n) for n in first}
    return placed.withColumns(values).join(starts, same).withColumns(out).select(*rows.columns, *out)
