"""Commit history: the first-parent line by pointer doubling, and how stale a design file is."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.statistics import staleness_verdict
from plumbline.sources.lineage import cut

#: Extensions that count as source code.
CODE = ("py", "js", "jsx", "ts", "tsx", "java", "cs", "php")


def mainline(commits: DataFrame, tips: DataFrame, longest: int | None = None) -> DataFrame:
    """(project, sha, depth): commits(project, sha, parent0) on the first-parent line of each tip, depth 0 at the tip.

    Distances double: after k rounds every commit knows its ancestor 2^k steps up, and every commit within 2^k
    steps of the tip is known, so a line of n commits takes log2(n) rounds of equi joins.
    """
    jump = cut(commits.select("project", F.col("sha").alias("at"), F.col("parent0").alias("up")).where("up IS NOT NULL"))
    longest = jump.count() + 1 if longest is None else longest
    found = tips.select("project", "sha", F.lit(0).cast("bigint").alias("depth"))
    for k in range(max(1, math.ceil(math.log2(max(longest, 2)) + 1))):
        step = jump.withColumnRenamed("at", "sha")
        more = found.join(step, ["project", "sha"]).select("project", F.col("up").alias("sha"), (F.col("depth") + 2**k).alias("depth"))
        far = jump.select("project", F.col("at").alias("up"), F.col("up").alias("top"))
        jump = cut(jump.join(far, ["project", "up"]).select("project", "at", F.col("top").alias("up")))
        found = cut(found.unionByName(more))
        if jump.isEmpty():
            break
    return found


def newest_plain(commits: DataFrame, most: int) -> DataFrame:
    """The last ``most`` commits that are no merges, oldest first by position."""
    place = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("committed_at"), F.desc("sha")))
    return commits.where("parent1 IS NULL").withColumn("place", place.cast("bigint")).where(F.col("place") <= most)


def diagram_staleness(files: DataFrame, extension: str = "mdj") -> DataFrame:
    """Per (project, design file): last commit touching it, commits and distinct code files since, days to the head, verdict.

    A code file has changed since if its own last touch is later. So commits, last touches and the designs' marks are swept
    once, newest first, with running sums; no file meets a design.
    """
    design = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)) == extension
    last = files.where(design).groupBy("project", "path").agg(F.max("commit_ord").alias("last_commit"), F.max("committed_on").alias("last_changed")).withColumnRenamed("path", "diagram")
    head = files.groupBy("project").agg(F.max("committed_on").alias("head_date"))
    code = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(*CODE)
    commits = files.select("project", F.col("commit_ord").alias("ord")).distinct().withColumns({"commit": F.lit(1), "file": F.lit(0)})
    touched = files.where(code).groupBy("project", "path").agg(F.max("commit_ord").alias("ord")).select("project", "ord", F.lit(0).alias("commit"), F.lit(1).alias("file"))
    marks = last.select("project", "diagram", F.col("last_commit").alias("ord"))
    line = marks.unionByName(commits.unionByName(touched).groupBy("project", "ord").agg(F.sum("commit").alias("commit"), F.sum("file").alias("file")), allowMissingColumns=True)
    newer = Window.partitionBy("project").orderBy(F.desc("ord"), F.col("diagram").isNull())  # a mark before its own commit
    sums = line.withColumns({"stale_commits": F.sum("commit").over(newer), "code_files_changed_since": F.sum("file").over(newer)}).where("diagram IS NOT NULL")
    out = last.join(sums.select("project", "diagram", "stale_commits", "code_files_changed_since"), ["project", "diagram"], "left").join(head, "project")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("stale_commits", "code_files_changed_since")}
    out = out.withColumns(zero).withColumn("stale_days", F.datediff("head_date", "last_changed").cast("bigint"))
    return out.withColumn("verdict", staleness_verdict(F.col("stale_commits"), F.col("code_files_changed_since")))
