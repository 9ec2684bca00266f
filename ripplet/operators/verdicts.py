"""Decision ladders over joined evidence: misses, plan checks, savings, economics, policy, specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_cases(cases: DataFrame) -> DataFrame:
    """(report, id, ord, file, failed, skipped, suite_level): cases of one id are one outcome; any failure wins, all must be skipped, files that differ leave none."""
    return cases.groupBy("report", "id").agg(
        F.min("ord").alias("ord"), F.when(F.count_distinct("file") > 1, "").otherwise(F.min("file")).alias("file"), F.bool_or("failed").alias("failed"), F.bool_and("skipped").alias("skipped"), F.bool_or("suite_level").alias("suite_level")
    )


def receipt_verdict(selection, files, file):
    """What a pull request's receipt says about a test file."""
    return (
        F.when(F.col(selection).isNull(), "no-receipt").when(F.col(selection) == "full", "ran-full").when(F.col(selection) != "selected", "no-tests-run")
        .when(F.col(files).isNull(), "selection-unrecorded").when(F.array_contains(files, F.col(file)), "selected").otherwise("missed")
    )


def classify_failures(full: DataFrame, rerun: DataFrame, baseline: DataFrame, pulls: DataFrame) -> DataFrame:
    """(id, class, missed_by): full(id, file, failed, suite_level), rerun(id, failed, skipped), baseline(id), pulls(number, selection, files).

    Every failure meets every pull request of the window; only the counts of their verdicts leave the join.
    """
    fails = full.where("failed").select("id", "file", "suite_level")
    again = rerun.groupBy("id").agg((~F.bool_or("failed") & ~F.bool_or("skipped")).alias("passed_again"))
    old = baseline.select("id").distinct().withColumn("old", F.lit(True))
    # verdicts by file: a pull request's files are exploded, so that the join is on (file), not on all pairs
    kinds = pulls.select("number", "selection", "files", F.when(F.col("selection").isNull(), "none").when(F.col("selection") == "full", "full").when(F.col("selection") != "selected", "none").when(F.col("files").isNull(), "unrecorded").otherwise("listed").alias("kind"))
    totals = kinds.agg(F.count_if(F.col("kind") == "unrecorded").alias("unrecorded"), F.count_if(F.col("kind") == "listed").alias("listed"), F.count_if(F.col("kind") == "none").alias("none"), F.count("*").alias("all"))
    listed = kinds.where("kind = 'listed'").select("number", F.explode(F.array_distinct("files")).alias("file")).groupBy("file").agg(F.count("*").alias("has"))
    joined = fails.join(again, "id", "left").join(old, "id", "left").join(listed, "file", "left").crossJoin(totals)  # totals is one row
    missed = F.col("listed") - F.coalesce("has", F.lit(0)) + F.col("unrecorded")
    cls = (
        F.when(F.coalesce("passed_again", F.lit(False)), "flaky").when(F.col("old"), "pre-existing").when(F.col("suite_level") | (F.coalesce("file", F.lit("")) == ""), "unattributed")
        .when(missed > 0, "miss").when(F.col("none") == F.col("all"), "unattributed").otherwise("covered")
    )
    return joined.select("id", cls.alias("class"), F.when(cls == "miss", missed).otherwise(F.lit(0)).alias("missed_by"))


def check_plan(plan: DataFrame, head: DataFrame, base: DataFrame | None) -> DataFrame:
    """(ord, outcome) of the failed cases of head(ord, file, identity, named, failed, skipped) against plan(file, selected, mode).

    Without a base report nothing is known to have passed, so that a skipped failure is a possible miss at most.
    """
    p = plan.select("file", "selected", "mode")
    known = head.where("named").join(p.select("file"), "file", "left_semi")
    counts = known.groupBy("identity").agg(F.count("*").alias("heads"))
    j = head.where("failed").join(p, "file", "left").join(counts, "identity", "left")
    if base is None:
        j = j.withColumn("bases", F.lit(0)).withColumn("base_failed", F.lit(False)).withColumn("base_passed", F.lit(False))
    else:
        b = base.where("named").join(p.select("file"), "file", "left_semi").groupBy("identity")
        j = j.join(b.agg(F.count("*").alias("bases"), F.bool_or("failed").alias("base_failed"), F.bool_or(~F.col("failed") & ~F.col("skipped")).alias("base_passed")), "identity", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    heads, bases = F.coalesce("heads", F.lit(0)), F.coalesce("bases", F.lit(0))
    unsure = ~flag("base_passed") | (heads > 1) | (bases > 1) | ~F.col("named")
    out = (
        F.when(F.col("file").isNull(), "unattributed").when(F.col("selected").isNull(), "unattributed").when(flag("base_failed") & (bases == 1) & (heads == 1) & F.col("named"), "pre-existing")
        .when((F.col("mode") == "SELECTIVE") & ~F.col("selected"), F.when(unsure, "possible-miss").otherwise("missed")).otherwise("selected")
    )
    return j.select("ord", out.alias("outcome"))


def savings(trials: DataFrame, timeout_ms: float = 0) -> DataFrame:
    """One row a report of trials(report, trial, arm, ms, ok, stable, controlled, overhead_ms): ranges, saving, evidence grade."""
    arm = lambda a: F.when(F.col("arm") == a, F.col("ms"))
    timely = (F.col("ms") >= 0) & ((F.lit(timeout_ms) == 0) | (F.col("ms") <= timeout_ms))
    g = trials.groupBy("report").agg(
        *(f(arm(a)).alias(f"{a}_{n}") for a in ("full", "selected") for n, f in (("min", F.min), ("median", F.median), ("max", F.max))),
        F.max("overhead_ms").alias("overhead"), F.bool_and(F.col("ok") & F.col("stable") & timely).alias("valid"), F.bool_and("controlled").alias("controlled"), F.count_distinct("trial").alias("repetitions"),
    )
    net = F.col("selected_median") + F.coalesce("overhead", F.lit(0.0))
    delta = F.col("full_median") - net
    grade = F.when(~F.col("valid"), "INVALID").when((F.col("repetitions") >= 3) & F.col("controlled"), "CONTROLLED").otherwise("PRELIMINARY")
    return g.select("report", "full_min", "full_median", "full_max", "selected_min", "selected_median", "selected_max", net.alias("net_selected"), delta.alias("delta"), F.when(F.col("full_median") > 0, delta / F.col("full_median") * 100).otherwise(0.0).alias("percent"), grade.alias("grade"))


def assess_failures(trials: DataFrame) -> DataFrame:
    """(report, kind, confidence) of trials(report, trial, arm, ok, class, fingerprint)."""
    bad = ~F.col("ok")
    in_ = lambda a: F.col("arm") == a
    g = trials.groupBy("report").agg(
        F.count_if(bad).alias("bad"), F.count_distinct("trial").alias("n"), *(F.count_distinct(F.when(in_(a), F.col("ok"))).alias(f"{a}_states") for a in ("full", "selected")),
        F.bool_or(bad & F.col("class").isin("RUNNER_INFRASTRUCTURE", "TIMEOUT")).alias("infra"), *(F.count_if(bad & in_(a)).alias(f"{a}_bad") for a in ("full", "selected")),
        *(F.count_distinct(F.when(bad & in_(a), F.col("fingerprint"))).alias(f"{a}_prints") for a in ("full", "selected")), F.count_distinct(F.when(bad, F.col("fingerprint"))).alias("prints"),
    )
    stable = lambda a: (F.col(f"{a}_bad") == F.col("n")) & (F.col(f"{a}_prints") == 1)
    many = F.col("n") >= 3
    kind = (
        F.when(F.col("bad") == 0, "none").when((F.col("full_states") > 1) | (F.col("selected_states") > 1), "likely_flaky").when(F.col("infra"), "infrastructure")
        .when(stable("full") & (F.col("selected_bad") == 0), F.when(many, "selection_miss").otherwise("inconclusive")).when(stable("full") & stable("selected") & (F.col("prints") == 1), "pre_existing").otherwise("inconclusive")
    )
    conf = F.when(kind == "none", "not-applicable").when(kind == "likely_flaky", F.when(many, "medium").otherwise("low")).when(kind == "infrastructure", "medium").when(kind == "selection_miss", "high").when(kind == "pre_existing", F.when(F.col("n") >= 2, "medium").otherwise("low")).otherwise("low")
    return g.select("report", kind.alias("kind"), conf.alias("confidence"))


def economics(samples: DataFrame) -> DataFrame:
    """(job, decision, saved_ms, observer_ms) of samples(job, head_sha, full_ms, policy_ms, observer_ms, stable): bypass only where the best saving can't cover the cheapest analysis."""
    ok = F.coalesce(F.col("stable") & (F.col("full_ms") > 0) & (F.col("policy_ms") > 0) & (F.col("observer_ms") > 0) & F.col("head_sha").isNotNull(), F.lit(False))
    g = samples.groupBy("job").agg(F.count("*").alias("n"), F.bool_and(ok).alias("valid"), F.count_distinct("head_sha").alias("heads"), F.greatest(F.lit(0.0), F.max(F.col("full_ms") - F.col("policy_ms"))).alias("saved"), F.min("observer_ms").alias("observer"))
    usable = (F.col("n") >= 5) & (F.col("n") <= 100) & F.col("valid") & (F.col("heads") >= 5)
    decision = F.when(~usable, "ANALYZE").when(F.col("saved") * 1.25 + 250 < F.col("observer"), "BYPASS_FULL").otherwise("ANALYZE")
    return g.select("job", decision.alias("decision"), F.when(usable, F.col("saved")).alias("saved_ms"), F.when(usable, F.col("observer")).alias("observer_ms"))


#: The first condition that holds blocks a narrowed run.
ENFORCE_STEPS = ["kill_switch", "override_label", "override_trailer", "policy_problem", "open_misses", "untrusted_range", "not_observed", "weak_confidence", "redacted_paths", "critical_signal", "full_mode", "global_risk", "empty_selection"]


def enforce(observations: DataFrame) -> DataFrame:
    """(observation, outcome): the first of ENFORCE_STEPS that is true, or `allowed`. An unknown (null) guard counts as true."""
    first = F.coalesce(*(F.when(F.coalesce(F.col(s), F.lit(True)), s) for s in ENFORCE_STEPS), F.lit("allowed"))
    return observations.select("observation", first.alias("outcome"))


def spec_conflicts(specs: DataFrame) -> DataFrame:
    """(target, specs): targets, trimmed and lower-cased, of more than one specification."""
    t = F.lower(F.trim("target"))
    return specs.select(t.alias("target"), "spec").where("target <> ''").groupBy("target").agg(F.array_sort(F.collect_set("spec")).alias("specs")).where(F.size("specs") > 1)
