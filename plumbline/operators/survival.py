"""Survival of conforming elements and recovery horizons, in two variants of the product-limit estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.running import running
from plumbline.sources import lineage

#: States in which an element departs from its design.
DEVIATING = ("absent", "partial", "divergent")


def observations(status: DataFrame) -> DataFrame:
    """One row per element: whether it deviated at its first commit, else the commits from there to its first deviation (an event), or to its last commit if there is none."""
    bad = F.col("status").isin(*DEVIATING)
    out = status.groupBy("project", "element").agg(
        F.min_by("status", "commit_index").alias("at_first"), F.min(F.when(bad, F.col("commit_index"))).alias("deviated"), F.max("commit_index").alias("last"), F.min("commit_index").alias("start")
    )
    time = (F.coalesce("deviated", "last") - F.col("start")).alias("time")
    return out.select("project", "element", F.col("at_first").isin(*DEVIATING).alias("at_freeze"), time, F.col("deviated").isNotNull().alias("event"), "deviated", "last")


def kaplan_meier(observed: DataFrame, *keys: str) -> DataFrame:
    """(keys, time, at_risk, events, survival) at event times; censored rows leave after the events of their time.

    The windows run over distinct times, which a grouped aggregation has reduced the rows to, each as a running sum.
    """
    times = observed.groupBy(*keys, "time").agg(F.sum(F.col("event").cast("bigint")).alias("events"), F.count("*").alias("leaving"))
    order = Window.partitionBy(*keys).orderBy("time")
    times = times.withColumn("at_risk", F.sum("leaving").over(Window.partitionBy(*keys).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)))
    survival = F.product(1 - F.col("events") / F.col("at_risk")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return times.withColumn("survival", survival).where("events > 0").select(*keys, "time", "at_risk", "events", "survival")


def km_quantile(curve: DataFrame, level: float, *keys: str) -> DataFrame:
    """First time at which survival is at most the level."""
    return curve.groupBy(*keys).agg(F.min(F.when(F.col("survival") <= level + 1e-12, F.col("time"))).alias("quantile"))


def element_survival(status: DataFrame, *keys: str) -> DataFrame:
    """Per project (or pooled, without keys): elements at risk, deviating at the freeze, events, commits of the window, half-life (or the
    commit it lies beyond) and survival at the end, NULL where no element was at risk."""
    seen = observations(status)
    risk = seen.where("NOT at_freeze")
    sums = seen.groupBy(*keys).agg(
        F.sum((~F.col("at_freeze")).cast("bigint")).alias("at_risk"),
        F.sum(F.col("at_freeze").cast("bigint")).alias("deviating_at_freeze"),
        F.sum((~F.col("at_freeze") & F.col("event")).cast("bigint")).alias("events"),
        (F.max("last") + 1).alias("window"),
    )
    curve = kaplan_meier(risk, *keys)
    tail = curve.groupBy(*keys).agg(F.min("survival").alias("end"), F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("time"))).alias("half_life"))
    joined = sums.join(tail, list(keys), "left") if keys else sums.crossJoin(F.broadcast(tail))  # one row each
    beyond = F.when(F.col("half_life").isNull(), F.col("window") - 1)
    return joined.withColumns({"survival_at_end": F.coalesce("end", F.when(F.col("at_risk") > 0, 1.0)), "censored_beyond": beyond}).drop("end")


def first_deviations(status: DataFrame) -> DataFrame:
    """(project, element, commit_index) of the first deviation of every element that conformed at its first commit."""
    return observations(status).where("NOT at_freeze AND event").select("project", "element", F.col("deviated").alias("commit_index"))


def recovery_horizons(served: DataFrame) -> DataFrame:
    """Each stale stretch once, at its onset: commits until what is served agrees again, NULL if it never does."""
    keys, stale = ["project", "gate_strategy"], F.col("diverges_from_oracle")
    served = lineage.cut(served.select(*keys, "commit_index", "diverges_from_oracle", "missed_change"))  # read several times
    out = running(served, keys, "commit_index", before={"before": F.coalesce(stale, F.lit(False))}, after={"good": F.when(~stale, F.col("commit_index"))})
    out = out.where(F.col("missed_change") & ~F.coalesce("before", F.lit(False)))
    return out.select("project", "gate_strategy", "commit_index", (F.col("good") - F.col("commit_index")).alias("horizon"))


def median_horizon(horizons: DataFrame, *keys: str) -> DataFrame:
    """Median gap where unresolved stretches stay at risk to the end; without a median the longest resolved gap is what it lies beyond."""
    times = horizons.where("horizon IS NOT NULL").groupBy(*keys, "horizon").agg(F.count("*").alias("events"))
    totals = horizons.groupBy(*keys).agg(F.count("*").alias("total"), F.count("horizon").alias("resolved"), F.max("horizon").alias("longest"))
    order = Window.partitionBy(*keys).orderBy("horizon")
    gone = F.coalesce(F.sum("events").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = times.join(F.broadcast(totals.select(*keys, "total")), list(keys)).withColumn("at_risk", F.col("total") - gone)
    steps = steps.withColumn("survival", F.product(1 - F.col("events") / F.col("at_risk")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    half = steps.groupBy(*keys).agg(F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("horizon"))).alias("median"))
    out = totals.join(half, list(keys), "left")
    beyond = F.when(F.col("median").isNull(), F.coalesce("longest", F.lit(0)).cast("bigint"))
    return out.select(*keys, "total", "resolved", "median", beyond.alias("censored_beyond"))
