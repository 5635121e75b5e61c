"""Study statistics over run rows: rates with intervals, paired tests, confusion, frontier, drift, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import count_if, exact_paired_p, rate, wilson
from plumbline.operators.running import running

#: Presentation order of the gates.
GATE_ORDER = ("always", "content", "structural", "isomorphism")


def gate_rank(gate: Column) -> Column:
    """Position in the fixed order; unknown gates come after, alphabetically (sort by this, then by name)."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, GATE_ORDER)), gate).cast("int"), F.lit(0)) + F.when(gate.isin(*GATE_ORDER), 0).otherwise(99)


def normalise_runs(rows: DataFrame, default_project: str = "project") -> DataFrame:
    """One typed shape of 26 columns for raw run rows given as strings: aliases, boolean words, numbers and defaults (row order: ``ord``, a number).

    A run of a ledger has no commit: its place among the project's rows stands in. Whether it re-analysed is what the gate
    allowed, or where that is absent (NULL, not empty) whether a model was called. Absent and empty optional values are NULL.
    """

    def raw(name: str) -> Column:
        return (F.col(name) if name in rows.columns else F.lit(None)).cast("string")

    def text(name: str, other: str | None = None) -> Column:
        return F.coalesce(F.nullif(raw(name), F.lit("")), F.lit(other))

    def flag(value: Column) -> Column:
        return F.lower(F.trim(value)).isin("true", "1", "yes")

    def maybe(name: str) -> Column:
        return F.when(F.coalesce(raw(name), F.lit("")) != "", flag(raw(name)))

    def number(name: str) -> Column:
        return F.trim(raw(name)).try_cast("double")

    rows = running(rows.withColumn("project", text("project", default_project)), ["project"], "ord", {"place": F.lit(1)})
    place = F.col("place")
    amount = lambda name: F.coalesce(number(name), F.lit(0.0))
    return rows.select(
        "project",
        F.coalesce(text("commit"), text("commit_hash"), F.concat(F.lit("run-"), place.cast("string"))).alias("commit"),
        F.coalesce(F.trim(raw("commit_index")).try_cast("bigint"), place - 1).alias("commit_index"),
        text("gate_strategy", "unknown").alias("gate_strategy"),
        F.coalesce(flag(F.coalesce(raw("gate_allowed_llm"), raw("llm_invoked"))), F.lit(False)).alias("gate_allowed_llm"),
        *(maybe(c).alias(c) for c in ("missed_change", "diverges_from_oracle", "conformance_changed")),
        (amount("prompt_tokens") + amount("completion_tokens")).alias("tokens"),
        amount("counterfactual_prompt_tokens").alias("counterfactual_tokens"),
        maybe("source_touched").alias("source_touched"),
        text("provenance", "").alias("provenance"),
        *(amount(c).alias(c) for c in ("latency_ms", "changed_nodes")),
        number("similarity_score").alias("similarity"),
        *(number(c).alias(c) for c in ("divergences", "absences")),
        *(raw(c).alias(c) for c in ("findings_hash", "model", "provider", "llm_mode")),
        number("temperature").alias("temperature"),
        *(raw(c).alias(c) for c in ("seed", "association_scoring", "impact_radius", "degraded")),
    )


def describe(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, median, mean, min, max and total of the values that are numbers; NULL and NaN are left out."""
    x = F.nanvl(F.col(value).try_cast("double"), F.lit(None).cast("double"))
    return rows.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.percentile(x, 0.5).alias("median"),
        F.avg(x).alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.sum(x).alias("total"),
    )


def spread(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """mean, sample deviation (0 for one value), min, max and range."""
    x = F.col(value)
    return rows.groupBy(*keys).agg(
        F.avg(x).alias("mean"),
        F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0))).alias("stdev"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        (F.max(x) - F.min(x)).alias("range"),
    )


def score_variance(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Population variance; NULL below two values."""
    return rows.groupBy(*keys).agg(F.when(F.count(value) >= 2, F.var_pop(value)).alias("variance"))


def ledger_metrics(runs: DataFrame, price_in: float = 5.0, price_out: float = 15.0) -> DataFrame:
    """Per project: runs, re-analyses, model calls, hit rate, tokens, what always calling would have cost, savings and latencies.

    What the gate allowed and whether a model was called (``llm_invoked``; where the column is absent, what was allowed) are
    different facts: averages of a call are over calls, the hit rate is over what was allowed.
    """
    allowed = F.coalesce(F.col("gate_allowed_llm"), F.lit(False))
    called = F.coalesce(F.col("llm_invoked"), F.lit(False)) if "llm_invoked" in runs.columns else allowed
    score = F.col("similarity_score").cast("double") if "similarity_score" in runs.columns else F.lit(None).cast("double")
    amount = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    mean = lambda c, when: F.coalesce(F.avg(F.when(when, amount(c))), F.lit(0.0))
    out = runs.groupBy("project").agg(
        F.count("*").alias("total_runs"),
        count_if(allowed).alias("reanalyses"),
        count_if(called).alias("llm_calls"),
        count_if(~allowed).alias("cached_runs"),
        *(F.sum(amount(c)).cast("bigint").alias(c) for c in ("prompt_tokens", "completion_tokens")),
        *((mean(c, called) * F.count("*")).alias(f"baseline_{c}") for c in ("prompt_tokens", "completion_tokens")),
        mean("latency_ms", called).alias("mean_latency_ms_llm"),
        mean("latency_ms", ~allowed).alias("mean_latency_ms_cached"),
        F.count(score).alias("scored_runs"),
        F.when(F.count(score) >= 2, F.var_pop(score)).alias("score_variance"),
    )
    cost = lambda a, b: (F.col(a) * price_in + F.col(b) * price_out) / 1e6
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    base = F.floor(F.col("baseline_prompt_tokens") + F.col("baseline_completion_tokens")).cast("bigint")
    actual, always = cost("prompt_tokens", "completion_tokens"), cost("baseline_prompt_tokens", "baseline_completion_tokens")
    slower = F.col("mean_latency_ms_llm") - F.col("mean_latency_ms_cached")
    out = out.withColumns(
        {
            "cache_hit_rate": rate(F.col("cached_runs"), F.col("total_runs")),
            "total_tokens": total,
            "baseline_total_tokens": base,
            "tokens_saved": F.greatest(F.lit(0).cast("bigint"), base - total),
            "actual_cost_usd": actual,
            "baseline_cost_usd": always,
            "cost_saved_usd": F.greatest(F.lit(0.0), always - actual),
            "latency_saved_ms": F.greatest(F.lit(0.0), slower * F.col("cached_runs")),
        }
    )
    return out.drop("baseline_prompt_tokens", "baseline_completion_tokens")


def by_strategy(runs: DataFrame) -> DataFrame:
    called = F.col("llm_invoked") if "llm_invoked" in runs.columns else F.col("gate_allowed_llm")
    gate = F.coalesce("gate_strategy", F.lit("unknown")).alias("gate_strategy")
    return runs.groupBy(gate).agg(F.count("*").alias("runs"), count_if(F.col("gate_allowed_llm")).alias("reanalyses"), count_if(called).alias("llm_calls"))


def study_table(runs: DataFrame) -> DataFrame:
    """One row: distinct projects, commits, gates, runs, and whether any run was held against an oracle."""
    cells = runs.groupBy("project", "gate_strategy").agg(F.count("*").alias("n"), F.bool_or(F.col("missed_change").isNotNull()).alias("held"))
    commits = runs.select("project", "commit_id").dropna().distinct().agg(F.count("*").alias("commits"))
    out = cells.agg(
        F.countDistinct("project").alias("projects"), F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("runs"), F.countDistinct("gate_strategy").alias("gates"),
        F.coalesce(F.bool_or("held"), F.lit(False)).alias("has_oracle"),
    )
    return out.crossJoin(F.broadcast(commits)).select("projects", "commits", "runs", "gates", "has_oracle")  # one row each


def baseline(gates: DataFrame) -> DataFrame:
    """One row with the tokens of the baseline gate: ``always`` if present, else the one with most tokens."""
    order = F.struct(F.col("gate_strategy") != "always", -F.col("tokens"), gate_rank(F.col("gate_strategy")), F.col("gate_strategy"))
    return gates.agg(F.min_by("gate_strategy", order).alias("baseline_gate"), F.min_by("tokens", order).alias("baseline_tokens"))


def gate_sums() -> list[Column]:
    """The sums all gate tables are made of."""
    ran, changed = F.col("gate_allowed_llm"), F.col("conformance_changed")
    return [
        F.count("*").alias("runs"),
        count_if(ran).alias("reanalysed"),
        count_if(~ran).alias("skipped"),
        F.count("missed_change").alias("checked"),
        count_if(F.col("missed_change")).alias("missed"),
        count_if(changed & ran).alias("tp"),
        count_if(changed & ~ran).alias("fn"),
        count_if(~changed & ran).alias("fp"),
        count_if(~changed & ~ran).alias("tn"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
        F.percentile("latency_ms", 0.5).alias("median_latency_ms"),
    ]


def gate_counts(runs: DataFrame, *keys: str) -> DataFrame:
    """``gate_sums`` per gate, one shuffle for any grouping."""
    return runs.groupBy(*keys, "gate_strategy").agg(*gate_sums())


def gate_table(runs: DataFrame) -> DataFrame:
    """Skip and miss rates, recall and specificity with intervals, and tokens against the baseline, per gate."""
    return gate_rates(gate_counts(runs))


def gate_rates(counts: DataFrame) -> DataFrame:
    """``gate_table`` from the sums per gate."""
    out = counts.crossJoin(F.broadcast(baseline(counts)))  # one row
    pairs = {
        "skip": (F.col("skipped"), F.col("runs")),
        "miss": (F.col("missed"), F.col("checked")),
        "recall": (F.col("tp"), F.col("tp") + F.col("fn")),
        "specificity": (F.col("tn"), F.col("tn") + F.col("fp")),
    }
    for name, (part, whole) in pairs.items():
        low, high = wilson(part, whole)
        out = out.withColumns({f"{name}_rate": rate(part, whole), f"{name}_low": low, f"{name}_high": high})
    saved = F.col("baseline_tokens") - F.col("tokens")
    return out.withColumns({"saved_tokens": saved, "saved_share": rate(saved, F.col("baseline_tokens")), "enough_runs": F.col("runs") >= 10})


def recommend(gates: DataFrame) -> DataFrame:
    """The gate to use: no baseline, misses measured; without misses if any, else all; most skipped, then first in order."""
    fit = gates.where((F.col("gate_strategy") != F.col("baseline_gate")) & (F.col("checked") > 0))
    order = F.struct(F.col("missed") > 0, -F.col("skip_rate"), gate_rank(F.col("gate_strategy")), F.col("gate_strategy"))
    return fit.agg(F.min_by("gate_strategy", order).alias("recommended"), F.min_by("skip_rate", order).alias("skip_rate"))


def project_table(runs: DataFrame, gate: str) -> DataFrame:
    """Per project under one gate: commits, runs, skipped, missed, tokens saved against the project's ``always`` runs."""
    counts = gate_counts(runs, "project")
    mine = counts.where(F.col("gate_strategy") == gate).select("project", "runs", "skipped", "missed", "tokens", rate(F.col("skipped"), F.col("runs")).alias("skip_rate"))
    every = counts.where(F.col("gate_strategy") == "always").select("project", F.col("tokens").alias("always_tokens"))
    commits = runs.groupBy("project").agg(F.countDistinct("commit_id").alias("commits"))
    ranked = counts.groupBy("project").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("skipped") / F.col("runs")).alias("s"), gate_rank(F.col("gate_strategy")).alias("o"), F.col("gate_strategy").alias("g")))),
                lambda x: x["g"],
            ),
            ">",
        ).alias("ranking")
    )
    return mine.join(every, "project", "left").join(commits, "project").join(ranked, "project").withColumn("saved_tokens", F.col("always_tokens") - F.col("tokens"))


def project_wholes(runs: DataFrame) -> DataFrame:
    """Per project over the runs of all gates: commits, drift per commit and median similarity (NULL where none was measured)."""
    similarity = F.percentile("similarity_score", 0.5) if "similarity_score" in runs.columns else F.lit(None).cast("double")
    # counted apart: beside a distinct count the median would be kept for every commit
    commits = runs.select("project", "commit_id").dropna().distinct().groupBy("project").agg(F.count("*").alias("commits"))
    each = runs.groupBy("project").agg(similarity.alias("median_similarity")).join(commits, "project", "left").select("project", F.coalesce("commits", F.lit(0)).alias("commits"), "median_similarity")
    return each.join(drift_rate(runs).withColumnRenamed("drift_rate", "drift_per_commit"), "project")


def project_report(counts: DataFrame, wholes: DataFrame, gate: str | None) -> DataFrame:
    """One row per project for the gate asked for, and all gates from the one that skips most to the one that skips least.

    counts are ``gate_counts`` per project, wholes ``project_wholes``. A project that never ran the gate is reported over all its
    runs. Missed is NULL where no run was checked, tokens saved where the project has no ``always`` runs. The ranking names every
    gate of the study, one that a project lacks last.
    """
    mine = F.coalesce(F.col("gate_strategy") == F.lit(gate), F.lit(False))
    parts = ("runs", "skipped", "checked", "missed", "tokens")
    sums = [F.coalesce(F.sum(F.when(mine, F.col(c))), F.sum(c)).alias(c) for c in parts]
    skips = F.map_from_entries(F.collect_list(F.struct("gate_strategy", (F.col("skipped") / F.col("runs")).alias("rate"))))
    always = F.sum(F.when(F.col("gate_strategy") == "always", F.col("tokens")))
    each = counts.groupBy("project").agg(*sums, skips.alias("skips"), always.alias("always_tokens"))
    gates = counts.agg(F.collect_set("gate_strategy").alias("gates"))  # one row: a handful of names
    order = F.transform("gates", lambda g: F.struct((-F.coalesce(F.try_element_at("skips", g), F.lit(-1.0))).alias("s"), gate_rank(g).alias("o"), g.alias("g")))
    ranking = F.transform(F.array_sort(order), lambda x: x["g"])
    return each.crossJoin(F.broadcast(gates)).join(wholes, "project").select(
        "project", F.lit(gate).cast("string").alias("gate"), "commits", "runs", "skipped", rate(F.col("skipped"), F.col("runs")).alias("skip_rate"),
        F.when(F.col("checked") > 0, F.col("missed")).alias("missed"), (F.col("always_tokens") - F.col("tokens")).alias("tokens_saved"), "drift_per_commit", "median_similarity",
        F.get(ranking, F.lit(0)).alias("best_gate"), F.array_join(ranking, " > ").alias("gate_ranking"), (F.col("runs") >= 10).alias("enough_runs"),
    )


def project_agreement(report: DataFrame) -> DataFrame:
    """One row of a ``project_report``: whether every project ranks the gates alike (false without projects), lowest and highest skip rate."""
    return report.agg(
        (F.countDistinct("gate_ranking") == 1).alias("consistent_ranking"), F.min("skip_rate").alias("lowest_skip_rate"), F.max("skip_rate").alias("highest_skip_rate"), F.count("*").alias("projects")
    )


def project_gate_cells(runs: DataFrame) -> DataFrame:
    """A row for every project and gate, zero or NULL where there are no runs."""
    cells = runs.select("project").distinct().crossJoin(F.broadcast(runs.select("gate_strategy").distinct()))  # a handful of gates
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "skipped", "missed")]
    return cells.join(gate_counts(runs, "project"), ["project", "gate_strategy"], "left").select("project", "gate_strategy", *zero, rate(F.col("skipped"), F.col("runs")).alias("skip_rate"))


def configuration(runs: DataFrame, *settings: str) -> DataFrame:
    """Distinct non-empty values of each setting and whether there is at most one."""
    long = runs.select(F.explode(F.array(*(F.struct(F.lit(s).alias("setting"), F.col(s).cast("string").alias("value")) for s in settings))).alias("x")).select("x.*")
    out = long.where("value <> ''").distinct().groupBy("setting").agg(F.array_sort(F.collect_list("value")).alias("found"))
    return out.select("setting", F.array_join("found", ",").alias("found"), (F.size("found") <= 1).alias("consistent"))


#: The settings that a study states.
SETTINGS = ("llm_mode", "provider", "model", "temperature", "seed", "impact_radius", "association_scoring")


def study_settings(runs: DataFrame) -> DataFrame:
    """(setting, found, consistent) of the settings that runs have a value for, and ``degraded`` with the number of runs that fell back, if any did."""
    have = [s for s in SETTINGS if s in runs.columns]
    out = configuration(runs, *have).where("found <> ''") if have else runs.sparkSession.createDataFrame([], "setting string, found string, consistent boolean")
    if "degraded" not in runs.columns:
        return out
    fell = F.coalesce(F.lower(F.col("degraded").cast("string")), F.lit("")).isin("true", "1", "yes")
    count = runs.agg(count_if(fell).alias("n")).where("n > 0").select(F.lit("degraded").alias("setting"), F.col("n").cast("string").alias("found"), F.lit(False).alias("consistent"))
    return out.unionByName(count)


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    """rows(fired, changed): the four counts, precision and recall (NULL where nothing was measured)."""
    fired, changed = F.col("fired"), F.col("changed")
    out = rows.groupBy(*keys).agg(
        count_if(fired & changed).alias("tp"), count_if(~fired & changed).alias("fn"), count_if(fired & ~changed).alias("fp"), count_if(~fired & ~changed).alias("tn")
    )
    return out.withColumns({"precision": rate(F.col("tp"), F.col("tp") + F.col("fp")), "recall": rate(F.col("tp"), F.col("tp") + F.col("fn"))})


def confused_ids(rows: DataFrame, id_: str, *keys: str) -> DataFrame:
    """(keys, outcome, id): what a gate missed (changed, not fired) and what it fired on for nothing (wasted), a row each."""
    outcome = F.when(~F.col("fired") & F.col("changed"), "missed").when(F.col("fired") & ~F.col("changed"), "wasted")
    return rows.select(*keys, outcome.alias("outcome"), F.col(id_).alias("id")).where("outcome IS NOT NULL")


def replay_summary(runs: DataFrame) -> DataFrame:
    """Per gate: reuse and miss rate, mean latency, mean impact of the runs that re-analysed, and re-analyses as a share of those of ``always``."""
    out = runs.groupBy("gate_strategy").agg(
        F.count("*").alias("runs"),
        count_if(F.col("gate_allowed_llm")).alias("reanalyses"),
        rate(count_if(~F.col("gate_allowed_llm")), F.count("*")).alias("reuse_rate"),
        rate(count_if(F.col("missed_change")), F.count("missed_change")).alias("miss_rate"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.avg(F.when(F.col("gate_allowed_llm"), F.col("impact_nodes")) if "impact_nodes" in runs.columns else F.lit(None).cast("double")).alias("mean_impact_nodes"),
    )
    every = out.where("gate_strategy = 'always'").agg(F.max("reanalyses").alias("always"))
    return out.crossJoin(F.broadcast(every)).withColumn("share_of_always", rate(F.col("reanalyses"), F.col("always"))).drop("always")


def corpus_totals(runs: DataFrame) -> DataFrame:
    """Per project and pooled (project NULL): commits, touched and changed ones after the first, rates and interval."""
    one = runs.groupBy("project", "commit_index").agg(F.bool_or("source_touched").alias("touched"), F.bool_or("conformance_changed").alias("changed"))
    first = one.groupBy("project").agg(F.min("commit_index").alias("first"))
    judged = one.join(F.broadcast(first), "project").withColumn("later", F.col("commit_index") > F.col("first"))
    out = judged.rollup("project").agg(
        F.count("*").alias("commits"), count_if(F.col("later")).alias("judged"), count_if(F.col("later") & F.col("touched")).alias("touched"), count_if(F.col("later") & F.col("changed")).alias("changed")
    )
    low, high = wilson(F.col("changed"), F.col("judged"))
    return out.withColumns({"touched_rate": rate(F.col("touched"), F.col("judged")), "changed_rate": rate(F.col("changed"), F.col("judged")), "low": low, "high": high})


def pair_gates(runs: DataFrame, left: str, right: str) -> DataFrame:
    """One row per (project, commit) that both gates ran on, the last of repeated rows counting."""
    last = Window.partitionBy("project", "commit_id", "gate_strategy").orderBy(F.desc("commit_index"))
    one = runs.withColumn("rn", F.row_number().over(last)).where("rn = 1")
    sides = [one.where(F.col("gate_strategy") == g).select("project", "commit_id", (~F.col("gate_allowed_llm")).alias(n)) for g, n in ((left, "a"), (right, "b"))]
    return sides[0].join(sides[1], ["project", "commit_id"])


def paired_test(pairs: DataFrame, *keys: str) -> DataFrame:
    """Exact paired test of pairs(a, b): discordant counts, p, and whether there are enough of them to say anything (6)."""
    a, b = F.col("a"), F.col("b")
    out = pairs.groupBy(*keys).agg(count_if(a & ~b).alias("a_only"), count_if(~a & b).alias("b_only"), count_if(a == b).alias("agreed"))
    out = out.withColumn("discordant", F.col("a_only") + F.col("b_only"))
    return out.withColumns({"p": exact_paired_p(F.col("a_only"), F.col("b_only")), "usable": F.col("discordant") >= 6})


def dominance(gates: DataFrame) -> DataFrame:
    """For each gate with a measured recall the gates that skip and recall at least as much and one of both more, plainly and beyond the intervals."""
    own = gates.where("recall_rate IS NOT NULL").select("gate_strategy", "skip_rate", "recall_rate", "skip_low", "skip_high", "recall_low", "recall_high")
    other = own.select(*(F.col(c).alias(f"o_{c}") for c in own.columns))
    better = (
        (F.col("o_gate_strategy") != F.col("gate_strategy"))
        & (F.col("o_skip_rate") >= F.col("skip_rate"))
        & (F.col("o_recall_rate") >= F.col("recall_rate"))
        & ((F.col("o_skip_rate") > F.col("skip_rate")) | (F.col("o_recall_rate") > F.col("recall_rate")))
    )
    apart = (F.col("o_skip_low") > F.col("skip_high")) | (F.col("o_recall_low") > F.col("recall_high"))
    pairs = own.join(F.broadcast(other), better, "left")  # one row per gate
    names = [F.array_join(F.array_sort(F.collect_list(x)), ",") for x in (F.col("o_gate_strategy"), F.when(apart, F.col("o_gate_strategy")))]
    out = pairs.groupBy("gate_strategy", "skip_rate", "recall_rate").agg(names[0].alias("dominated_by"), names[1].alias("robustly_dominated_by"))
    return out.withColumn("on_frontier", F.col("dominated_by") == "")


def serve(runs: DataFrame) -> DataFrame:
    """What each gate serves: the findings of its latest re-analysed commit; whether they differ from the current ones, and were missed."""
    own = F.when(F.col("gate_allowed_llm"), F.col("findings_hash"))
    out = running(runs, ["project", "gate_strategy"], "commit_index", last={"own_hash": own}, first={"first_run": F.struct("findings_hash")})
    out = out.withColumn("served_hash", F.coalesce("own_hash", "first_run.findings_hash")).drop("own_hash", "first_run")
    out = out.withColumn("diverges_from_oracle", F.col("served_hash") != F.col("findings_hash"))
    return out.withColumn("missed_change", F.col("diverges_from_oracle") & ~F.col("gate_allowed_llm"))


def label_changes(runs: DataFrame) -> DataFrame:
    """Whether findings differ from the previous commit's; the first of a project is NULL."""
    before = F.lag("findings_hash").over(Window.partitionBy("project", "gate_strategy").orderBy("commit_index"))
    return runs.withColumn("changed", F.when(before.isNotNull(), before != F.col("findings_hash")))


def infer_labels(runs: DataFrame, label: str = "conformance_changed") -> DataFrame:
    """Fills labels that are NULL by comparing findings with the last known ones; ``filled`` marks the rows."""
    order = Window.partitionBy("project", "gate_strategy").orderBy("commit_index").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last("findings_hash", ignorenulls=True).over(order)
    guess = F.when(known.isNotNull() & F.col("findings_hash").isNotNull(), known != F.col("findings_hash"))
    return runs.withColumn("guess", guess).withColumns({"filled": F.col(label).isNull() & F.col("guess").isNotNull(), label: F.coalesce(F.col(label), F.col("guess"))}).drop("guess")


def trajectories(runs: DataFrame) -> DataFrame:
    """One point per (project, commit_index): the first row that has any count, in the order of gates."""
    first = Window.partitionBy("project", "commit_index").orderBy(gate_rank(F.col("gate_strategy")), "gate_strategy")
    some = runs.where("divergences IS NOT NULL OR absences IS NOT NULL")
    out = some.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("divergences", "absences")]
    return out.select("project", "commit_index", *zero, "source_touched", "conformance_changed")


def drift_direction(points: DataFrame) -> DataFrame:
    """Net movement of divergences and absences per project, how often each moved, and what it amounts to; one point is not measured."""
    order = Window.partitionBy("project").orderBy("commit_index")
    moved = points.withColumns({"dd": F.col("divergences") - F.lag("divergences").over(order), "da": F.col("absences") - F.lag("absences").over(order)})
    later = F.col("dd").isNotNull()
    out = moved.groupBy("project").agg(
        F.count("*").alias("points"),
        (F.max_by("divergences", "commit_index") - F.min_by("divergences", "commit_index")).alias("net_divergences"),
        (F.max_by("absences", "commit_index") - F.min_by("absences", "commit_index")).alias("net_absences"),
        F.greatest(F.lit(1), F.max("commit_index") - F.min("commit_index")).cast("bigint").alias("span"),
        count_if(F.col("dd") + F.col("da") > 0).alias("eroding"),
        count_if(F.col("dd") + F.col("da") < 0).alias("repairing"),
        count_if(later & F.col("source_touched")).alias("touched"),
    )
    nd, na = F.col("net_divergences"), F.col("net_absences")
    label = F.when((nd == 0) & (na == 0), "stable").when((nd > 0) & (nd >= F.greatest(na, F.lit(0))), "divergence-led").when(na > 0, "absence-led").otherwise("converging")
    out = out.withColumns({"label": label, "per_commit": rate(nd + na, F.col("span")), "per_touching": rate(nd + na, F.col("touched"))})
    return out.where("points >= 2")


def drift_rate(runs: DataFrame) -> DataFrame:
    """Change of divergences and absences per commit between a project's first and last measured row, NULL with fewer than two."""
    total = F.coalesce("divergences", F.lit(0)) + F.coalesce("absences", F.lit(0))
    order = F.struct("commit_index", "gate_strategy")
    measured = F.col("divergences").isNotNull() | F.col("absences").isNotNull()
    out = runs.groupBy("project").agg(
        F.max_by(F.when(measured, total), F.when(measured, order)).alias("last"),
        F.min_by(F.when(measured, total), F.when(measured, order)).alias("first"),
        (F.max(F.when(measured, F.col("commit_index"))) - F.min(F.when(measured, F.col("commit_index")))).alias("span"),
        count_if(measured).alias("points"),
    )
    slope = rate(F.col("last") - F.col("first"), F.greatest(F.lit(1), F.col("span")))
    return out.select("project", F.when(F.col("points") >= 2, slope).alias("drift_rate"))


def staleness_verdict(stale_commits: Column, code_files: Column) -> Column:
    """A diagram fewer than 30 commits behind is recent, whatever has changed since; only a stale one with changed sources is a candidate."""
    return F.when(stale_commits == 0, "current").when(stale_commits < 30, "recent").when(code_files == 0, "unaffected").otherwise("candidate")
