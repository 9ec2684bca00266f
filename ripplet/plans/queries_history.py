"""Queries over test history and outcomes."""

from pyspark.sql import functions as F

from ripplet.operators import history as h
from ripplet.plans.registry import Registry
from ripplet.relations import load, sql

R = Registry()
_T, _O = sql("outcome_test"), sql("outcome")
_HIST = """ranked as (select seq, row_number() over (order by seq) as r, count(*) over () as n from (select distinct seq from outcome_test)),
hist as (select test, sum(power(0.5, (n - r) / 20.0)) as runs, sum(case when failed then power(0.5, (n - r) / 20.0) else 0 end) as failures, arg_max(ms, t.seq) as ms from outcome_test t join ranked using (seq) group by test)"""
_TIMES = """times as (select test, list_sort(list(ms))[cast(floor(count(*) / 2) as integer) + 1] as ms from (select *, row_number() over (partition by test order by seq desc, pos desc) as k from outcome_test where ms is not null) where k <= 5 group by test)"""
r6 = lambda c: F.round(c, 6).alias(c)


@R.add("history_scores", f"{_T}, {_HIST} select test, round(runs, 6) as runs, round(failures, 6) as failures, round(ms, 6) as ms, round(failures / (runs + 1), 6) as score from hist")
def scores(spark, sf):
    d = h.test_history(load(spark, sf, "outcome_test")).withColumn("score", h.failure_score())
    return d.select("test", r6("runs"), r6("failures"), r6("ms"), r6("score"))


_SEL = "sel as (select distinct test % 4 as selection, test, test as ord, case when test % 19 = 0 then 'DIRECT_TEST_CHANGE' else 'TRANSITIVE_DEPENDENCY' end as reason from outcome_test)"


def _selection(df):
    why = F.when(F.col("test") % 19 == 0, "DIRECT_TEST_CHANGE").otherwise("TRANSITIVE_DEPENDENCY")
    return df.select((F.col("test") % 4).alias("selection"), "test", F.col("test").alias("ord"), why.alias("reason")).distinct()


_RANK = f"""{_T}, {_HIST}, {_SEL}, sc as (select selection, s.test, ord, ms, case when reason = 'DIRECT_TEST_CHANGE' then 1.0 else coalesce(failures, 0) / (coalesce(runs, 0) + 1) end as score from sel s left join hist using (test)),
rk as (select selection, test, round(score, 6) as score, row_number() over (partition by selection order by score desc, ms asc nulls last, ord) as place from sc)"""


@R.add("history_ranking", f"{_RANK} select * from rk")
def ranking(spark, sf):
    t = load(spark, sf, "outcome_test")
    return h.rank_tests(_selection(t), h.test_history(t)).select("selection", "test", r6("score"), F.col("place").cast("long").alias("place"))


@R.add("history_likely_failures", f"{_RANK} select * from rk where score > 0")
def likely(spark, sf):
    t = load(spark, sf, "outcome_test")
    return h.likely_failures(h.rank_tests(_selection(t), h.test_history(t)).select("selection", "test", r6("score"), F.col("place").cast("long").alias("place")))


@R.add("history_timings", f"{_T}, {_TIMES} select * from times")
def timings(spark, sf):
    return h.timings(load(spark, sf, "outcome_test"))


@R.add("history_shards")
def shards(spark, sf):
    """A greedy fold; tests compare it with a loop."""
    t = load(spark, sf, "outcome_test")
    return h.shards(_selection(t), h.timings(t), 4)


@R.add(
    "history_confidence_curve",
    f"""{_T}, bad as (select seq from outcome_test group by seq having bool_or(failed) and count(*) = count(ms) and sum(ms) > 0),
runs as (select seq, row_number() over (order by seq) as r from (select distinct seq from outcome_test)),
prior as (select b.seq, t.test, sum(power(0.5, (x.r - 1 - y.r) / 20.0)) as runs, sum(case when p.failed then power(0.5, (x.r - 1 - y.r) / 20.0) else 0 end) as fails, arg_max(p.ms, p.seq) as pms
  from bad b join runs x on x.seq = b.seq join outcome_test t on t.seq = b.seq left join outcome_test p on p.test = t.test and p.seq < b.seq left join runs y on y.seq = p.seq group by b.seq, t.test),
sc as (select t.*, round(coalesce(fails, 0) / (coalesce(runs, 0) + 1), 12) as score, pms from outcome_test t join prior p on p.seq = t.seq and p.test = t.test),
o as (select *, coalesce(sum(ms) over (partition by seq order by score desc, pms asc nulls last, test rows between unbounded preceding and 1 preceding), 0) as br,
  coalesce(sum(ms) over (partition by seq order by test rows between unbounded preceding and 1 preceding), 0) as bp, row_number() over (partition by seq order by score desc, pms asc nulls last, test) as kr from sc),
sh as (select seq, arg_min(br, kr) filter (where failed) / sum(ms) as ranked, arg_min(bp, test) filter (where failed) / sum(ms) as by_path from o group by seq)
select s / 10.0 as time_share, round(avg(case when ranked < s / 10.0 then 1.0 else 0.0 end), 6) as ranked, round(avg(case when by_path < s / 10.0 then 1.0 else 0.0 end), 6) as by_path from sh, (select unnest(range(1, 11)) as s) group by s""",
)
def curve(spark, sf):
    c = h.confidence_curve(load(spark, sf, "outcome_test"))
    return c.select("time_share", r6("ranked"), r6("by_path"))


@R.add(
    "outcome_summary",
    f"""{_O} select count(*) as runs, count(*) filter (where verification = 'passed') as passed, count(*) filter (where verification = 'failed') as failed, count(*) filter (where verification = 'blocked') as blocked,
    count(*) filter (where selection = 'selected') as selected, count(*) filter (where selection = 'full') as "full", cast(floor(median(case when selection = 'selected' then tests_ms end) + 0.5) as bigint) as median_selected_ms,
    cast(floor(median(case when selection = 'full' then tests_ms end) + 0.5) as bigint) as median_full_ms from outcome""",
)
def summary(spark, sf):
    return h.summary(load(spark, sf, "outcome"))


_WHY = "why as (select seq, selection, unnest([concat('reason ', cast(views % 9 as varchar)), concat('reason ', cast(errors % 7 as varchar))]) as reason from outcome)"


@R.add("outcome_top_reasons", f"{_O}, {_WHY} select reason, count(distinct seq) as runs from why where selection = 'full' group by reason order by runs desc, reason limit 5")
def top_reasons(spark, sf):
    why = F.array(F.expr("concat('reason ', cast(views % 9 as string))"), F.expr("concat('reason ', cast(errors % 7 as string))"))
    return h.top_fallback_reasons(load(spark, sf, "outcome").withColumn("fallback_reasons", why))


@R.add("outcome_agents", f"{_O} select coalesce(agent, 'none') as agent, count(*) as runs from outcome group by 1")
def agents(spark, sf):
    return h.agents(load(spark, sf, "outcome"))


@R.add(
    "outcome_possible_misses",
    f"""{_O} select f.tree_sha, max(s.seq) as selected_seq, f.seq as full_seq from outcome f join outcome s on s.tree_sha = f.tree_sha and s.seq < f.seq and s.selection = 'selected' and s.verification = 'passed'
    where f.selection = 'full' and f.verification = 'failed' group by f.tree_sha, f.seq""",
)
def possible_misses(spark, sf):
    return h.possible_misses(load(spark, sf, "outcome"))


_RUNQ = """rr as (select *, list_distinct(['t' || (views % 6), 't' || (errors % 6), 't' || ((views + errors) % 6)]) as tests, 'npm test ' || (views % 2) as command, ['lint a' || (errors % 2)] as checks, views % 13 = 0 as reused from outcome)"""


@R.add(
    "outcome_reuse",
    f"""{_O}, {_RUNQ} select q.seq as query, max(r.seq) as seq from rr q join rr r on r.tree_sha = q.tree_sha and r.verification = 'passed' and not r.reused
    and ((r.selection = 'full' and r.command = q.command) or (r.selection = 'selected' and q.selection = 'selected' and len(list_filter(q.tests, lambda x: not list_contains(r.tests, x))) = 0))
    and len(list_filter(q.checks, lambda x: not list_contains(r.checks, x))) = 0 group by q.seq""",
)
def reuse(spark, sf):
    tests = F.array_distinct(F.array(*(F.concat(F.lit("t"), F.expr(x).cast("string")) for x in ("views % 6", "errors % 6", "(views + errors) % 6"))))
    o = load(spark, sf, "outcome").withColumns({"selected_tests": tests, "command": F.expr("concat('npm test ', cast(views % 2 as string))"), "checks": F.array(F.expr("concat('lint a', cast(errors % 2 as string))")), "tool": F.lit("1"), "runtime": F.lit("1")})
    runs = o.withColumn("reused", F.expr("views % 13 = 0"))
    return h.reusable_pass(runs, o.withColumn("query", F.col("seq")).withColumn("full_command", F.col("command")))


@R.add("outcome_merged_results", f"{_T} select test, arg_max(failed, seq) as failed, arg_max(ms, seq) as ms from outcome_test group by test")
def merged(spark, sf):
    return h.merged_results(load(spark, sf, "outcome_test").withColumnRenamed("seq", "list"))


@R.add(
    "outcome_base_compare",
    f"""{_T}, j as (select distinct a.seq as run, a.test, b.test is not null as old from outcome_test a left join outcome_test b on b.test = a.test and b.seq = a.seq - 1 and b.failed where a.failed)
    select run, count(*) filter (where not old) as new, count(*) filter (where old) as old, case when count(*) filter (where not old) = 0 then 'pre-existing' when count(*) filter (where old) = 0 then 'introduced' else 'mixed' end as status from j group by run""",
)
def base_compare(spark, sf):
    bad = load(spark, sf, "outcome_test").where("failed")
    return h.compare_with_base(bad.select(F.col("seq").alias("run"), F.col("test").alias("name")), bad.select((F.col("seq") + 1).alias("run"), F.col("test").alias("name")))


@R.add("median_variants", f"{_T} select test as key, round(median(ms), 6) as averaged, cast(floor(median(ms) + 0.5) as bigint) as rounded, list_sort(list(ms))[cast(floor(count(*) / 2) as integer) + 1] as upper from outcome_test group by test")
def medians(spark, sf):
    return h.median_variants(load(spark, sf, "outcome_test").select(F.col("test").alias("key"), F.col("ms").alias("x"))).select("key", r6("averaged"), "rounded", "upper")


QUERIES, ORACLES = R.queries, R.oracles
