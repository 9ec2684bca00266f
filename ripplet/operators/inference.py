"""CI pipelines as rows: matrices, completeness of operations, providers and causal paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matrix_cells(axes: DataFrame, excludes: DataFrame | None = None) -> DataFrame:
    """(job, cell, assignment) of axes(job, ord, key, pos, value): the product in order of declaration, less the excluded.

    A job's axes fold into an array of maps; excludes(job, assignment) go where all of their pairs are in a cell.
    """
    rows = axes.groupBy("job", "ord").agg(F.first("key").alias("key"), F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("vs"))
    per = rows.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("ord", "key", "vs"))).alias("axes"))
    empty = F.expr("array(cast(map() as map<string,string>))")
    grow = lambda acc, ax: F.flatten(F.transform(acc, lambda m: F.transform(ax.vs, lambda v: F.map_concat(m, F.map_from_arrays(F.array(ax.key), F.array(v.value))))))
    cells = per.select("job", F.posexplode(F.aggregate("axes", empty, grow)).alias("cell", "assignment"))
    if excludes is None:
        return cells
    inside = F.forall(F.map_keys(F.col("x")), lambda k: F.try_element_at(F.col("assignment"), k).eqNullSafe(F.try_element_at(F.col("x"), k)))
    bad = cells.join(excludes.select("job", F.col("assignment").alias("x")), "job").where(inside).select("job", "cell").distinct()
    return cells.join(bad, ["job", "cell"], "left_anti")


def completeness(checks: DataFrame) -> DataFrame:
    """(operation, complete, confidence) of checks(operation, slot, satisfied, blocked): every slot needs one satisfied alternative, and nothing may be blocked."""
    slots = checks.groupBy("operation", "slot").agg(F.bool_or("satisfied").alias("met"), F.bool_or("blocked").alias("blocked"))
    ops = slots.groupBy("operation").agg(F.count_if(~F.col("met")).alias("unmet"), F.bool_or("blocked").alias("blocked"))
    done = (F.col("unmet") == 0) & ~F.col("blocked")
    return ops.select("operation", done.alias("complete"), F.when(done, "HIGH").when(~F.col("blocked") & (F.col("unmet") == 1), "MEDIUM").otherwise("LOW").alias("confidence"))


def provider_job(jobs: DataFrame) -> DataFrame:
    """(purpose, job): of jobs(job, ord, purpose, skips, blocked) the one with fewest skips, then fewest blocked operations, then the first."""
    w = Window.partitionBy("purpose").orderBy("skips", "blocked", "ord")
    return jobs.withColumn("n", F.row_number().over(w)).where("n = 1").select("purpose", "job")


def purpose_path(steps: DataFrame) -> DataFrame:
    """(job, ord, active) of steps(job, ord, provides, condition): those up to the last provider; known-skipped ones aren't active."""
    last = F.max(F.when(F.col("provides"), F.col("ord"))).over(Window.partitionBy("job"))
    return steps.withColumn("last", last).where("ord <= last").select("job", "ord", (F.col("condition") != "FALSE").alias("active"))


def preceding_provider(steps: DataFrame) -> DataFrame:
    """(job, ord, install): the last active install step before each other step."""
    w = Window.partitionBy("job").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("install", F.last(F.when((F.col("kind") == "install") & (F.col("condition") != "FALSE"), F.col("ord")), ignorenulls=True).over(w)).where("kind <> 'install'").select("job", "ord", "install")


def feeds_tests(steps: DataFrame) -> DataFrame:
    """(job, ord): steps after which, in the same job, tests run."""
    w = Window.partitionBy("job").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    return steps.withColumn("later", F.max(F.col("kind") == "test").over(w)).where("later").select("job", "ord")


def provided_purposes(steps: DataFrame) -> DataFrame:
    """(job, purposes): distinct purposes in the order in which they first occur."""
    return steps.where("purpose is not null").groupBy("job").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "purpose"))), lambda x: x.purpose)).alias("purposes"))
