"""Test history: outcome_test(run, seq, test, pos, failed, ms), one row a test and run; seq orders runs."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplet.functions.values import half_up, let, upper_median

HALF_LIFE = 20.0
#: Tests a block of the greedy fold.
BLOCK = 256
CHANGED_TEST_REASONS = ("DIRECT_TEST_CHANGE", "ADDED_TEST")


def run_ranks(outcomes: DataFrame) -> DataFrame:
    """(seq, rank): the position of each run that has results. Runs are few beside results, so one task may number them."""
    return outcomes.select("seq").distinct().select("seq", F.row_number().over(Window.orderBy("seq")).alias("rank"))


def test_history(outcomes: DataFrame) -> DataFrame:
    """(test, runs, failures, ms): weights halve every HALF_LIFE runs back from the newest; ms is the latest one known."""
    ranks = run_ranks(outcomes)
    last = ranks.agg(F.max("rank").alias("last"))
    weight = F.pow(F.lit(0.5), (F.col("last") - F.col("rank")) / HALF_LIFE)
    rows = outcomes.join(ranks.crossJoin(last).withColumn("w", weight).select("seq", "w"), "seq")  # last is one row
    return rows.groupBy("test").agg(F.sum("w").alias("runs"), F.sum(F.when(F.col("failed"), F.col("w")).otherwise(0.0)).alias("failures"), F.max_by("ms", F.when(F.col("ms").isNotNull(), F.struct("seq", "pos"))).alias("ms"))


def failure_score(reason: str | Column | None = None) -> Column:
    """Weighted failures over weighted runs and one; 1 for a test that the change edited or added."""
    rate = F.coalesce(F.col("failures"), F.lit(0.0)) / (F.coalesce(F.col("runs"), F.lit(0.0)) + 1)
    return rate if reason is None else F.when((F.col(reason) if isinstance(reason, str) else reason).isin(*CHANGED_TEST_REASONS), 1.0).otherwise(rate)


def rank_tests(tests: DataFrame, history: DataFrame) -> DataFrame:
    """(test, score, place) of tests(selection, ord, test, reason), by selection: likeliest failures first, then the faster, then as given."""
    scored = tests.join(history, "test", "left").withColumn("score", failure_score("reason"))
    w = Window.partitionBy("selection").orderBy(F.desc("score"), F.asc_nulls_last("ms"), "ord")
    return scored.select("selection", "test", "score", F.row_number().over(w).alias("place"))


def likely_failures(ranked: DataFrame) -> DataFrame:
    return ranked.where("score > 0")


def timings(outcomes: DataFrame, last: int = 5) -> DataFrame:
    """(test, ms): the upper median of each test's last durations."""
    w = Window.partitionBy("test").orderBy(F.desc("seq"), F.desc("pos"))
    recent = outcomes.where("ms is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= last)
    return recent.groupBy("test").agg(upper_median(F.collect_list("ms")).alias("ms"))


def shards(tests: DataFrame, times: DataFrame, total: int) -> DataFrame:
    """(selection, test, shard): longest first onto the least loaded shard (ties: the lower); a test without a timing weighs the upper median of the known ones, or 1.

    A selection's tests are the files of one run, so that they fit one array; the greedy fold runs over it.
    """
    if not 1 <= total <= 1000:
        raise ValueError("between 1 and 1000 shards")
    rows = tests.select("selection", "test").distinct().join(times, "test", "left")
    packed = rows.groupBy("selection").agg(F.collect_list(F.struct("test", "ms")).alias("rows"))
    known = upper_median(F.filter(F.transform("rows", lambda r: r.ms), lambda x: x.isNotNull()))
    in_order = lambda mid: F.array_sort(F.transform("rows", lambda r: F.struct((-F.coalesce(r.ms, mid)).alias("minus"), r.test.alias("test"))))
    loads = F.array_repeat(F.lit(0.0), total)

    def add(acc, x):
        at = F.array_position(acc.load, F.array_min(acc.load)).cast("int")
        load = F.transform(acc.load, lambda v, i: F.when(i == at - 1, v - x.minus).otherwise(v))
        return let(F.struct(load.alias("load"), at.alias("at")), lambda y: F.struct(y.load.alias("load"), F.concat(acc.out, F.array(F.struct(x.test.cast("string").alias("test"), (y.at - 1).alias("shard")))).alias("out")))

    def add_block(acc, block):
        # the places of a block are gathered apart, so that no step copies all places before it
        start = F.struct(acc.load.alias("load"), F.expr("cast(array() as array<struct<test:string,shard:int>>)").alias("out"))
        return let(F.aggregate(block, start, add), lambda y: F.struct(y.load.alias("load"), F.concat(acc.out, F.array(y.out)).alias("out")))

    def fold(order):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(order) - 1) / BLOCK).cast("int")), lambda i: F.slice(order, i * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(loads.alias("load"), F.expr("cast(array() as array<array<struct<test:string,shard:int>>>)").alias("out"))
        return F.aggregate(blocks, start, add_block, lambda acc: F.flatten(acc.out))

    folded = packed.select("selection", let(F.coalesce(known, F.lit(1.0)), lambda mid: let(in_order(mid), fold)).alias("out"))
    return folded.select("selection", F.inline("out"))


def first_failure_share(outcomes: DataFrame, order: list[Column]) -> DataFrame:
    """(seq, share): the share of a run's test time that passes before its first failing test starts, in the given order.

    Only runs with a failure, all durations and a positive total have one.
    """
    w = Window.partitionBy("seq").orderBy(*order)
    before = F.coalesce(F.sum("ms").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = outcomes.withColumn("before", before).withColumn("place", F.row_number().over(w))
    agg = rows.groupBy("seq").agg(F.min_by("before", F.when(F.col("failed"), F.col("place"))).alias("first"), F.sum("ms").alias("total"), F.count_if(F.col("ms").isNull()).alias("unknown"))
    return agg.where("unknown = 0 and total > 0 and first is not null").select("seq", (F.col("first") / F.col("total")).alias("share"))


def prior_scores(outcomes: DataFrame) -> DataFrame:
    """The outcomes with each test's score and latest duration by the history of the runs before its own.

    With w = 2**(rank / HALF_LIFE) a running sum times 2**-((n - 1) / HALF_LIFE) is the weighted count before run n; ranks
    are rebased to the newest run, so that the powers stay small for any number of runs.
    """
    ranks = run_ranks(outcomes)
    last = ranks.agg(F.max("rank").alias("last"))
    rows = outcomes.join(ranks.crossJoin(last), "seq").withColumn("w", F.pow(F.lit(2.0), (F.col("rank") - F.col("last")) / HALF_LIFE))  # last is one row
    before = Window.partitionBy("test").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)
    scale = F.pow(F.lit(2.0), -(F.col("rank") - 1 - F.col("last")) / HALF_LIFE)
    runs = F.coalesce(F.sum("w").over(before), F.lit(0.0)) * scale
    fails = F.coalesce(F.sum(F.when(F.col("failed"), F.col("w")).otherwise(0.0)).over(before), F.lit(0.0)) * scale
    return rows.withColumn("score", fails / (runs + 1)).withColumn("prior_ms", F.last("ms", ignorenulls=True).over(before)).drop("w", "rank", "last")


def confidence_curve(outcomes: DataFrame, steps: int = 10) -> DataFrame:
    """(time_share, ranked, by_path): the share of failing runs found within each share of the test time."""
    scored = prior_scores(outcomes)
    ranked = first_failure_share(scored, [F.desc(F.round("score", 12)), F.asc_nulls_last("prior_ms"), F.asc("test")]).withColumnRenamed("share", "ranked")
    both = ranked.join(first_failure_share(outcomes, [F.asc("test")]).withColumnRenamed("share", "by_path"), "seq")
    cells = both.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("t", F.col("step") / steps)
    return cells.groupBy("step").agg(F.avg((F.col("ranked") < F.col("t")).cast("double")).alias("ranked"), F.avg((F.col("by_path") < F.col("t")).cast("double")).alias("by_path")).select((F.col("step") / steps).alias("time_share"), "ranked", "by_path")


def summary(runs: DataFrame) -> DataFrame:
    """One row over runs(seq, selection, verification, tests_ms): counts and the rounded medians of the two kinds of runs."""
    kind = lambda k: F.floor(F.median(F.when(F.col("selection") == k, F.col("tests_ms"))) + 0.5)
    count = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False))).alias(v)
    return runs.agg(F.count("*").alias("runs"), *(count("verification", v) for v in ("passed", "failed", "blocked")), *(count("selection", v) for v in ("selected", "full")), kind("selected").alias("median_selected_ms"), kind("full").alias("median_full_ms"))


def top_fallback_reasons(runs: DataFrame, k: int = 5) -> DataFrame:
    """(reason, runs): the commonest reasons of full runs, each counted once a run."""
    once = runs.where("selection = 'full'").select("seq", F.explode("fallback_reasons").alias("reason")).distinct()
    return once.groupBy("reason").agg(F.count("*").alias("runs")).orderBy(F.desc("runs"), "reason").limit(k)


def agents(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.coalesce("agent", F.lit("none")).alias("agent")).agg(F.count("*").alias("runs"))


def possible_misses(runs: DataFrame) -> DataFrame:
    """(tree_sha, selected_seq, full_seq): failed full runs with a passed selected run of the same tree before them; the latest one."""
    w = Window.partitionBy("tree_sha").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    good = F.when((F.col("selection") == "selected") & (F.col("verification") == "passed"), F.col("seq"))
    return runs.withColumn("selected_seq", F.last(good, ignorenulls=True).over(w)).where("selection = 'full' and verification = 'failed' and selected_seq is not null").select("tree_sha", "selected_seq", F.col("seq").alias("full_seq"))


def reusable_pass(runs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, seq): the newest passed run of the same tree and versions that covers each query's tests and checks.

    runs(seq, tree_sha, tool, runtime, selection, verification, selected_tests, command, checks, reused) and
    queries(query, tree_sha, tool, runtime, selection, selected_tests, command, full_command, checks): checks are arrays
    of "id command". A reused run is no source.
    """
    r = runs.where("verification = 'passed' and not coalesce(reused, false)").select("seq", "tree_sha", "tool", "runtime", *(F.col(c).alias(f"r_{c}") for c in ("selection", "selected_tests", "command", "checks")))
    full = F.when(F.col("selection") == "full", F.col("command")).otherwise(F.col("full_command"))
    none = F.expr("cast(array() as array<string>)")
    tests = ((F.col("r_selection") == "full") & (F.col("r_command") == full)) | (
        (F.col("r_selection") == "selected") & (F.col("selection") == "selected") & F.col("r_selected_tests").isNotNull() & (F.size(F.array_except("selected_tests", F.coalesce("r_selected_tests", none))) == 0)
    )
    q = queries.select("query", "tree_sha", "tool", "runtime", "selection", "selected_tests", "command", "full_command", "checks")
    hit = q.join(r, ["tree_sha", "tool", "runtime"]).where(tests).where(F.size(F.array_except("checks", F.coalesce("r_checks", none))) == 0)
    return hit.groupBy("query").agg(F.max("seq").alias("seq"))


def merged_results(results: DataFrame) -> DataFrame:
    """(test, failed, ms): of results(list, pos, test, failed, ms) the last list wins, then the last place in it."""
    return results.groupBy("test").agg(F.max_by(F.struct("failed", "ms"), F.struct("list", "pos")).alias("r")).select("test", "r.failed", "r.ms")


def compare_with_base(head: DataFrame, base: DataFrame) -> DataFrame:
    """(run, new, old, status) of failing names head(run, name) and base(run, name)."""
    old = base.select("run", "name").distinct().withColumn("old", F.lit(True))
    joined = head.select("run", "name").distinct().join(old, ["run", "name"], "left")
    counts = joined.groupBy("run").agg(F.count_if(F.col("old").isNull()).alias("new"), F.count_if("old").alias("old"))
    status = F.when(F.col("new") == 0, "pre-existing").when(F.col("old") == 0, "introduced").otherwise("mixed")
    return counts.select("run", "new", "old", status.alias("status"))


def median_variants(values: DataFrame) -> DataFrame:
    """(key, averaged, rounded, upper): the three medians of values(key, x)."""
    m = F.median("x")
    return values.groupBy("key").agg(m.alias("averaged"), half_up(m).alias("rounded"), upper_median(F.collect_list("x")).alias("upper"))
