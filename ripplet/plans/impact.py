"""From a change set and a graph to the affected tests, and from these to an advisory plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.operators.graph import closure, reverse, runtime_only
from ripplet.runtime import store

SCHEMA_VERSION = "1"


def affected(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(test, ord, changed_file, reason, depth): every reason why a test is affected.

    A changed test that still exists selects itself; the dependents of a changed file are affected through it. Edges that
    only types take count for tests of types alone (is_type_test, where nodes have it).
    """
    seeds = changed.select(F.col("path").alias("root"), F.col("path").alias("node"))
    full = closure(reverse(edges), seeds)
    run = closure(reverse(runtime_only(edges)), seeds).select("root", "node").distinct()
    tests = nodes.where("is_test").select(F.col("path").alias("node"), (F.col("is_type_test") if "is_type_test" in nodes.columns else F.lit(False)).alias("types"))
    hit = full.join(tests, "node").join(run.withColumn("live", F.lit(True)), ["root", "node"], "left").where("live or types")
    own = changed.select(F.col("path").alias("root"), "ord", "change_type")
    found = hit.join(own, "root").where("depth > 0 or change_type <> 'deleted'")
    reason = F.when(F.col("depth") == 0, "DIRECT_TEST_CHANGE").when(F.col("change_type") == "deleted", "DELETED_DEPENDENCY").otherwise("TRANSITIVE_DEPENDENCY")
    return found.select(F.col("node").alias("test"), "ord", F.col("root").alias("changed_file"), reason.alias("reason"), "depth")


def selected(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(test): the tests that `affected` has a reason for, without the reasons: one closure from all changed files together.

    A deleted test doesn't select itself; whether another changed file does is asked for such tests alone, from their side.
    """
    seeds = changed.select(F.lit(0).alias("root"), F.col("path").alias("node"))
    types = F.col("is_type_test") if "is_type_test" in nodes.columns else F.lit(False)
    tests = nodes.where("is_test").select(F.col("path").alias("node"), types.alias("types"))
    gone = changed.groupBy("path").agg(F.bool_and(F.col("change_type") == "deleted").alias("gone")).where("gone").select(F.col("path").alias("node"))
    parts = []
    for links, some in ((runtime_only(edges), tests.where("not types")), (edges, tests.where("types"))):
        if not some.isEmpty():
            hit = closure(reverse(links), seeds).select("node").distinct().join(some.select("node"), "node", "left_semi")
            parts.append(hit.join(gone, "node", "left_anti"))
            lost = store(hit.join(gone, "node", "left_semi"), "deleted-tests")
            if not lost.isEmpty():
                far = closure(links, lost.select(F.col("node").alias("root"), "node")).where("depth > 0")
                parts.append(far.join(changed.select(F.col("path").alias("node")).distinct(), "node", "left_semi").select(F.col("root").alias("node")))
    out = nodes.where("false").select(F.col("path").alias("node"))
    for p in parts:
        out = out.unionByName(p)
    return out.select(F.col("node").alias("test")).distinct()


def test_impact(reasons: DataFrame) -> DataFrame:
    """(test, reasons, evidence): distinct reasons in the order in which they were first seen, and the changed files."""
    return reasons.groupBy("test").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "reason"))), lambda x: x.reason)).alias("reasons"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "changed_file"))), lambda x: x.changed_file).alias("evidence"),
    )


def fallback(nodes: DataFrame, changed: DataFrame, confidence: str = "COMPLETE") -> DataFrame:
    """(ord, message): why everything has to run. A deleted file without a node can't be followed."""
    spark = nodes.sparkSession
    lost = changed.join(nodes.select("path"), "path", "left_anti").where("change_type = 'deleted'").select("ord", F.concat(F.lit("no node for deleted file "), F.col("path").cast("string")).alias("message"))
    return lost if confidence != "UNSAFE" else lost.unionByName(spark.createDataFrame([(-1, "graph confidence is UNSAFE")], "ord long, message string"))


def plan(nodes: DataFrame, reasons: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """(test, decision, mode): FULL selects every test and skips none; SELECTIVE skips all tests without a reason."""
    mode = fallbacks.agg(F.when(F.count("*") > 0, "FULL").otherwise("SELECTIVE").alias("mode"))
    tests = nodes.where("is_test").select(F.col("path").alias("test")).distinct()
    hit = reasons.select("test").distinct().withColumn("hit", F.lit(True))
    return tests.join(hit, "test", "left").crossJoin(mode).select("test", F.when((F.col("mode") == "FULL") | F.col("hit"), "SELECTED").otherwise("SKIPPED").alias("decision"), "mode")  # mode is one row


def unselected_changes(nodes: DataFrame, changed: DataFrame, planned: DataFrame) -> DataFrame:
    """Tests that were changed directly, still exist and yet aren't selected: must be empty in any plan."""
    direct = changed.where("change_type <> 'deleted'").join(nodes.where("is_test").select("path"), "path", "left_semi").select(F.col("path").alias("test"))
    return direct.join(planned.where("decision = 'SELECTED'").select("test"), "test", "left_anti")


def explain(targets: DataFrame, planned: DataFrame, tasks: DataFrame, reasons: DataFrame) -> DataFrame:
    """(target, answer): always run, then selected, then a task's own status, then affected, else skipped."""
    p = planned.select(F.col("test").alias("target"), "decision").distinct()
    t = tasks.select(F.col("task").alias("target"), "status", "always_run").distinct()
    r = reasons.select(F.col("test").alias("target")).distinct().withColumn("affected", F.lit(True))
    return targets.select("target").join(p, "target", "left").join(t, "target", "left").join(r, "target", "left").select(
        "target",
        F.when(F.col("always_run"), "ALWAYS_RUN").when(F.col("decision") == "SELECTED", "SELECTED").when(F.col("status") == "SKIP_CANDIDATE", "SKIP_CANDIDATE").when(F.col("status").isNotNull(), "SELECTED").when(F.col("affected"), "AFFECTED").otherwise("SKIP_CANDIDATE").alias("answer"),
    )


def task_decisions(tasks: DataFrame, triggers: DataFrame, full: bool) -> DataFrame:
    """(task, status): tasks(task, always_run); triggers(task): a changed path or a risk reason is the task's."""
    hit = triggers.select("task").distinct().withColumn("hit", F.lit(True))
    status = F.when(F.col("always_run"), "ALWAYS_RUN").when(F.lit(full), "FULL_FALLBACK").when(F.col("hit"), "RUN").otherwise("SKIP_CANDIDATE")
    return tasks.join(hit, "task", "left").select("task", status.alias("status"))
