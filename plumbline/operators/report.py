"""The tables of a study report, from one reading of the run rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import rate
from plumbline.operators import statistics, survival
from plumbline.sources import lineage

#: The file of each table.
TABLES = (
    "table1-what-was-studied", "table2-gate-performance", "table3-per-project", "table3b-per-project-per-gate", "table4-controlled-test",
    "study-configuration", "comparison-mcnemar", "figure3-pareto", "figure2-drift", "raw-runs",
)


def counted(runs: DataFrame) -> DataFrame:
    """``statistics.gate_counts`` per project and gate and per gate alone (``pooled``) in one aggregation with grouping sets."""
    sets = runs.groupingSets([[F.col("project"), F.col("gate_strategy")], [F.col("gate_strategy")]], "project", "gate_strategy")
    return sets.agg(*statistics.gate_sums(), (F.grouping("project") == 1).alias("pooled"))


def recovery(runs: DataFrame) -> DataFrame:
    """Per gate: stale stretches, how many were resolved and not, and the median number of commits that took."""
    horizons = lineage.cut(survival.recovery_horizons(statistics.serve(runs)))
    out = survival.median_horizon(horizons, "gate_strategy")
    return out.select(
        "gate_strategy", F.col("total").alias("recovery_misses_tracked"), F.col("resolved").alias("recovery_resolved"),
        (F.col("total") - F.col("resolved")).alias("recovery_censored"), F.col("median").alias("recovery_median_commits"),
    )


def tables(runs: DataFrame, deviations: DataFrame | None = None, left: str = "structural", right: str = "isomorphism") -> dict[str, DataFrame]:
    """The report's tables by name.

    runs are typed run rows (project, commit_id, commit_index, gate_strategy, gate_allowed_llm, labels, tokens, latency, counts);
    deviations(gate_strategy, fired, changed) are labelled before-and-after pairs. Runs and the sums by gate are written once and
    every table is made from these; the per-project table is for the recommended gate, and over all of a project's runs without one.
    """
    runs = lineage.cut(runs)
    sums = lineage.cut(counted(runs))
    pooled = sums.where("pooled").drop("pooled", "project")
    gates = lineage.cut(statistics.gate_rates(pooled))
    chosen = statistics.recommend(gates).first()["recommended"]
    each = sums.where("NOT pooled").drop("pooled")
    always = each.where("gate_strategy = 'always'").select("project", F.col("tokens").alias("always_tokens"))
    projects = statistics.project_report(each, statistics.project_wholes(runs), chosen).drop("enough_runs")
    saved = (F.col("always_tokens") - F.col("tokens")).alias("tokens_saved")
    grid = runs.select("project").distinct().crossJoin(F.broadcast(pooled.select("gate_strategy")))  # a handful of gates
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "skipped", "missed", "tokens")]
    cells = grid.join(each, ["project", "gate_strategy"], "left").join(always, "project", "left").select(
        "project", F.col("gate_strategy").alias("gate"), *zero, rate(F.col("skipped"), F.col("runs")).alias("skip_rate"), rate(F.col("missed"), F.col("checked")).alias("miss_rate"), saved,
        "median_latency_ms", (F.coalesce("runs", F.lit(0)) >= 10).alias("enough_runs"),
    )
    tested = runs.select("gate_strategy", F.col("gate_allowed_llm").alias("fired"), F.col("conformance_changed").alias("changed")) if deviations is None else deviations
    controlled = statistics.confusion(tested, "gate_strategy").select(
        F.col("gate_strategy").alias("gate"), F.col("tp").alias("caught"), F.col("fn").alias("missed"), F.col("fp").alias("false_alarms"), F.col("tn").alias("correctly_ignored"), "precision", "recall"
    )
    points = lineage.cut(statistics.trajectories(runs))
    enough = points.groupBy("project").count().where("count >= 2").select("project")
    study = statistics.study_table(runs)
    items = F.explode(F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in study.columns)))
    made = (
        study.select(items.alias("x")).select("x.*"),
        gates.join(recovery(runs), "gate_strategy", "left"),
        projects,
        cells,
        controlled,
        statistics.study_settings(runs),
        statistics.paired_test(statistics.pair_gates(runs, left, right)).select(F.lit(left).alias("left_gate"), F.lit(right).alias("right_gate"), "*"),
        statistics.dominance(gates),
        points.join(enough, "project", "left_semi").select("project", "commit_index", "divergences", "absences"),
        runs,
    )
    return dict(zip(TABLES, made, strict=True))
