"""Running values in blocks equal plain windows, and no task holds a whole project."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import report, statistics, survival
from plumbline.operators.running import running
from plumbline.sources.bridge import load


@pytest.fixture()
def uncoalesced(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def largest(rows):
    """The rows of the fullest task, per project."""
    return {r.project: r["max(count)"] for r in rows.groupBy("project", F.spark_partition_id().alias("task")).count().groupBy("project").max("count").collect()}


@pytest.mark.parametrize("kind", ["long", "double", "string"])
def test_running_values_equal_windows(spark, kind):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), i * i, draw.choice([None, 1, 2]), draw.choice([None, None, "x", "y"])) for i in range(400)] + [("c", None, 5, "n"), ("c", 7, 1, None)]
    table = spark.createDataFrame(rows, "k string, at long, n long, v string").withColumn("at", F.format_string("%09d", "at") if kind == "string" else F.col("at").cast(kind))
    order = Window.partitionBy("k").orderBy("at")
    upto, past, later = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    plain = table.withColumns(
        {"total": F.coalesce(F.sum("n").over(upto), F.lit(0)), "own": F.last("v", True).over(upto), "past": F.last("v", True).over(past), "next": F.first("v", True).over(later), "start": F.first("v", True).over(upto)}
    )
    v = F.col("v")
    found = running(table, ["k"], "at", {"total": F.col("n")}, {"own": v}, {"past": v}, {"next": v}, {"start": v})
    assert found.columns == plain.columns and sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_running_values_of_no_rows(spark):
    assert running(spark.createDataFrame([], "k string, at long"), ["k"], "at", {"n": F.lit(1)}).count() == 0


def test_places_of_a_project_are_found_in_many_tasks(uncoalesced):
    raw = uncoalesced.range(1000).select(F.lit("p").alias("project"), F.col("id").alias("ord"))
    made = statistics.normalise_runs(raw)
    assert [(r.commit, r.commit_index) for r in made.orderBy("commit_index").collect()] == [(f"run-{i + 1}", i) for i in range(1000)]
    assert largest(made.where("commit_index >= 0"))["p"] < 1000


def test_commits_of_a_project_are_numbered_in_many_tasks(uncoalesced, sf_dir):
    runs = load(uncoalesced, sf_dir, "runs").where("gate_strategy = 'always' AND commit_index >= 0 AND divergences >= 0")
    whole = {r.project: r["count"] for r in runs.groupBy("project").count().collect()}
    found = largest(runs)
    assert all(found[p] < whole[p] for p in whole)


def test_a_gate_is_served_in_many_tasks(uncoalesced):
    hashes = F.when(F.col("id") % 7 > 0, (F.floor(F.col("id") / 10)).cast("string"))
    runs = uncoalesced.range(1000).select(F.lit("p").alias("project"), F.lit("g").alias("gate_strategy"), F.col("id").alias("commit_index"), (F.col("id") % 15 == 14).alias("gate_allowed_llm"), hashes.alias("findings_hash"))
    made = statistics.serve(runs)
    expected, served = {}, None
    for i in range(1000):
        own = str(i // 10) if i % 7 else None
        served = own if own is not None and (i == 0 or i % 15 == 14) else served
        expected[i] = (served, None if own is None or served is None else own != served)
    assert {r.commit_index: (r.served_hash, r.diverges_from_oracle) for r in made.collect()} == expected
    assert largest(made.where("served_hash <> 'x'"))["p"] < 500
    stale = [i for i in range(1000) if expected[i][1] and i % 15 != 14 and not (i and expected[i - 1][1])]
    good = lambda i: next((j - i for j in range(i + 1, 1000) if expected[j][1] is False), None)
    assert {r.commit_index: r.horizon for r in survival.recovery_horizons(made).collect()} == {i: good(i) for i in stale}


def test_medians_are_not_kept_for_every_commit(spark, sf_dir):
    runs = load(spark, sf_dir, "runs").withColumn("similarity_score", F.col("latency_ms"))
    for made in (report.counted(runs), statistics.project_wholes(runs)):
        plan = made._jdf.queryExecution().executedPlan().toString().splitlines()
        assert any("percentile" in line for line in plan) and not [line for line in plan if "percentile" in line and "commit_id" in line]


def test_distinct_commits_leave_null_out(spark):
    kind = "project string, commit_id string, gate_strategy string, missed_change boolean, commit_index long, divergences long, absences long"
    rows = [("p", "a", "g", None, 0, 1, 0), ("p", "a", "h", None, 0, 1, 0), ("p", None, "g", None, 1, 3, 0), (None, "b", None, None, 0, 0, 0), ("q", None, "g", None, 0, 0, 0)]
    runs = spark.createDataFrame(rows, kind)
    assert tuple(statistics.study_table(runs).first()) == (2, 1, 5, 2, False)
    assert tuple(statistics.study_table(runs.where("false")).first()) == (0, 0, 0, 0, False)
    assert {r.project: (r.commits, r.median_similarity) for r in statistics.project_wholes(runs).collect()} == {"p": (1, None), "q": (0, None)}
