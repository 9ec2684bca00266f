"""Queries over CI history, decision ladders and pipeline inference."""

from pyspark.sql import functions as F

from ripplet.functions import conditions as c
from ripplet.functions import values as v
from ripplet.operators import ci
from ripplet.operators import inference as inf
from ripplet.operators import verdicts as vd
from ripplet.plans.registry import Registry
from ripplet.relations import load, sql, table
from ripplet.runtime import again, store

R = Registry()
_J = sql("ci_run", "ci_job", "annotation")
# what the rules say about these names and steps
_BUCKET = """case when not steps_known and j.conclusion <> 'failure' then 'infra' when steps_known and step = '' then 'infra' when step = 'Set up node' then 'infra' when step = 'Check lockfile' then 'ci-only'
  when name in ('E2E tests', 'deploy') then 'ci-only' when name in ('lint', 'CI / unit tests', 'build (ubuntu)', 'typecheck', 'all checks passed') then case when name = 'all checks passed' then case when workflow_name = 'Unit tests' then 'check' else 'ci-only' end else 'check' end
  when workflow_name = 'Unit tests' then 'check' else 'ci-only' end"""
_SIG = "sig as (select distinct job, regexp_replace(concat(path, ' :: ', title, ' :: ', message), '/tmp/\\S+|[a-f0-9]{7,}|[0-9]+(?:[.][0-9]+)?', '#', 'g') as signature from annotation)"
# numbers are blurred, so that the place of a failure is told by letters here
_SIGS = "sig as (select distinct l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey % 10000 as job, concat('sig', chr(cast(97 + l_partkey % 26 as integer)), chr(cast(97 + (l_partkey // 26) % 26 as integer)), chr(cast(97 + cast(l_quantity as bigint) % 26 as integer)), case when l_partkey % 9 = 0 then ' timed out' else '' end) as signature from lineitem where l_partkey % 4 <> 3)"
_FAIL = f"""failing as (select j.*, r.pr, r.workflow_name, {_BUCKET} as bucket, name = 'all checks passed' as gate from ci_job j join ci_run r on r.run = j.run where r.conclusion = 'failure' and j.conclusion in ('failure', 'timed_out')),
{_SIGS}, seen as (select signature, count(distinct pr) as seen from failing f join sig using (job) where bucket = 'check' group by signature),
pj as (select job, bool_and(signature like '%timed out%') as timeouts, bool_or(signature not like '%timed out%' and seen > 1) as elsewhere from (select distinct f.job, signature from failing f join sig using (job) where bucket = 'check') join seen using (signature) group by job),
nm as (select name, count(distinct pr) as failed_on from failing where bucket = 'check' group by name),
realf as (select f.*, bool_or(not gate) over (partition by run) as others from failing f),
owned as (select f.run, f.job, f.name, bucket, case when bucket = 'check' then case when timeouts is null then case when failed_on >= 5 and failed_on * 2 >= (select count(distinct pr) from ci_run) then 'shared' else 'unknown' end
  when timeouts then 'timeout' when elsewhere then 'shared' else 'own' end end as ownership from realf f left join pj using (job) left join nm using (name) where not gate or not others)"""
_VERDICT = """idle as (select run from ci_job group by run having bool_and(not started or conclusion = 'skipped')),
facts as (select run, count(*) filter (where bucket = 'check') as checks, bool_or(bucket = 'ci-only') as ci, bool_and(bucket <> 'check' or ownership = 'own') as all_own, bool_or(coalesce(ownership = 'own', false)) as own,
  bool_and(bucket <> 'check' or ownership = 'unknown') as all_unknown, bool_or(coalesce(ownership = 'shared', false)) as shared from owned where bucket <> 'infra' group by run),
vd as (select r.run, case when checks is null then 'infra' when exists (select 1 from ci_run p where p.conclusion = 'success' and p.workflow_id = r.workflow_id and p.head_sha = r.head_sha) then 'flaky' when checks = 0 then 'ci-only' when all_own and not ci then 'preventable' when own then 'partly'
  when all_unknown and not ci then 'likely' when shared then 'shared' when ci then 'ci-only' else 'likely' end as verdict from ci_run r left join facts f on f.run = r.run
  where r.conclusion = 'failure' and r.run in (select run from ci_job) and r.run not in (select run from idle))"""
_MIN = "mins as (select run, sum(minutes) as minutes from ci_job group by run)"
_ALL = f"{_J}, {_FAIL}, {_VERDICT}"


def _jobs(spark, sf):
    j = load(spark, sf, "ci_job")
    return j.withColumn("started", F.when(F.col("started"), "then")).withColumn("failed_steps", F.filter(F.array("step"), lambda x: x != ""))


def _stored_jobs(spark, sf):
    return store(_jobs(spark, sf), "ci-jobs")  # an aggregate over all line items, read several times


def _runs(spark, sf, jobs=None):
    """The runs with their minutes, which only some queries need."""
    mins = (load(spark, sf, "ci_job") if jobs is None else again(jobs)).groupBy("run").agg(F.sum("minutes").alias("minutes"))
    return load(spark, sf, "ci_run").join(mins, "run", "left").na.fill(0, ["minutes"])


def _notes(spark, sf):
    li = table(spark, sf, "lineitem").where("l_partkey % 4 <> 3")
    text = "concat('sig', chr(cast(97 + l_partkey % 26 as int)), chr(cast(97 + (l_partkey div 26) % 26 as int)), chr(cast(97 + cast(l_quantity as bigint) % 26 as int)), case when l_partkey % 9 = 0 then ' timed out' else '' end)"
    return li.select(F.expr("l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey % 10000").alias("job"), F.expr(text).alias("signature"))


@R.add("ci_buckets", f"{_J} select j.job, {_BUCKET} as bucket from ci_job j join ci_run r on r.run = j.run")
def buckets(spark, sf):
    j = _jobs(spark, sf).join(load(spark, sf, "ci_run").select("run", "workflow_name"), "run")
    return j.select("job", ci.bucket("name", "conclusion", "failed_steps", "steps_known", "workflow_name").alias("bucket"))


@R.add("ci_gates", f"{_J} select name, name = 'all checks passed' as gate, case when name = 'CI / unit tests' then 'unit tests' else name end as own, count(*) as n from ci_job group by name")
def gates(spark, sf):
    return load(spark, sf, "ci_job").groupBy("name").agg(F.count("*").alias("n")).select("name", ci.is_gate("name").alias("gate"), ci.job_name("name").alias("own"), "n")


@R.add("ci_nothing_ran", f"{_J} select run, bool_and(not started or conclusion = 'skipped') as nothing from ci_job group by run")
def nothing(spark, sf):
    return ci.nothing_ran(_jobs(spark, sf))


@R.add("ci_signatures", f"{_J}, {_SIG} select * from sig")
def signatures(spark, sf):
    return load(spark, sf, "annotation").select("job", v.signature("path", "title", "message").alias("signature")).distinct()


@R.add("ci_ownership", f"{_J}, {_FAIL} select * from owned")
def ownership(spark, sf):
    return ci.own_failures(load(spark, sf, "ci_run"), _jobs(spark, sf), _notes(spark, sf))


def _verdicts(spark, sf, jobs=None):
    return ci.verdicts(load(spark, sf, "ci_run"), again(jobs or _stored_jobs(spark, sf)), _notes(spark, sf))


@R.add("ci_verdicts", f"{_ALL} select * from vd")
def verdicts(spark, sf):
    return _verdicts(spark, sf)


@R.add(
    "ci_summary",
    f"""{_ALL}, {_MIN} select v as verdict, coalesce(n, 0) as runs, coalesce(m, 0) as runner_minutes, coalesce(p, 0) as pull_requests from (select unnest({ci.VERDICTS}) as v)
    left join (select verdict, count(*) as n, cast(floor(sum(minutes) + 0.5) as bigint) as m, count(distinct pr) as p from vd join mins using (run) join ci_run using (run) group by verdict) on verdict = v""",
)
def summary(spark, sf):
    jobs = _stored_jobs(spark, sf)
    return ci.summarise(_runs(spark, sf, jobs), _verdicts(spark, sf, jobs))


@R.add(
    "ci_dominated",
    f"""{_ALL}, per as (select pr, count(*) as n from vd join ci_run using (run) where verdict = 'preventable' group by pr)
    select coalesce(max(n), 0) as largest, cast(coalesce(sum(n), 0) as bigint) as preventable, coalesce(max(n), 0) >= 3 and coalesce(max(n), 0) * 2 > coalesce(sum(n), 0) as dominated from per""",
)
def dominated(spark, sf):
    return ci.dominated(load(spark, sf, "ci_run"), _verdicts(spark, sf))


_AG = "case when branch like 'copilot/%' then 'copilot' when branch like 'Claude-%' then 'claude' when branch like 'codex/%' then 'codex' else 'none' end"


@R.add(
    "ci_agent_slices",
    f"""{_ALL}, s as (select {_AG} as agent, count(*) as pull_request_runs, count(*) filter (where conclusion <> 'skipped') as ran_runs, count(*) filter (where conclusion = 'failure') as red_runs from ci_run group by 1),
    w as (select {_AG} as agent, {", ".join(f'''count(*) filter (where verdict = '{x}') as "{x}"''' for x in ci.VERDICTS)} from vd join ci_run using (run) group by 1) select s.*, {", ".join(f'coalesce("{x}", 0) as "{x}"' for x in ci.VERDICTS)} from s left join w using (agent)""",
)
def slices(spark, sf):
    return ci.agent_slices(load(spark, sf, "ci_run"), _verdicts(spark, sf))


_SCORE = "(minutes + 0.01) * case when name like 'CodeQL%' or name like 'Docs%' then 0.05 else 1.0 end * case when name in ('CI', 'Unit tests') then 2.0 else 1.0 end * case when name in ('CI', 'Unit tests') then 1.05 else 1.0 end * case when name in ('CI', 'Unit tests') then 1.5 else 1.0 end"


@R.add("ci_main_workflow", f"{_J}, {_MIN}, w as (select workflow_id, workflow_name as name, sum(case when conclusion <> 'skipped' then least(minutes * 10, 360) else 0 end) as minutes from ci_run join mins using (run) group by 1, 2) select workflow_id, name, round(minutes, 6) as minutes, round({_SCORE}, 6) as score from w order by score desc limit 1")
def main_workflow(spark, sf):
    x = ci.main_workflow(_runs(spark, sf).select(F.col("run").alias("ord"), "workflow_id", F.col("workflow_name").alias("name"), "conclusion", (F.col("minutes") * 10).alias("span")))
    return x.select("workflow_id", "name", F.round("minutes", 6).alias("minutes"), F.round("score", 6).alias("score"))


@R.add("ci_suggested_workflows", f"{_J}, w as (select distinct workflow_name as name, 1.0 as minutes from ci_run) select name, round({_SCORE}, 6) as score from w where name in ('CI', 'Unit tests')")
def suggested(spark, sf):
    return ci.suggest_workflows(load(spark, sf, "ci_run").select(F.col("workflow_name").alias("name"), F.lit("active").alias("state")).distinct()).select("name", F.round("score", 6).alias("score"))


_AGENT = "select conv_id, turn, case when conv_id % 3 = 0 then 'codex' when conv_id % 2 = 0 then 'copilot' else '' end as marker, case when conv_id % 3 = 0 then 'trailer' when conv_id % 2 = 0 then 'branch' else '' end as source from conversations"


@R.add("ci_agent_markers", _AGENT)
def markers(spark, sf):
    x = table(spark, sf, "conversations").withColumn("m", F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit("\nCo-Authored-By: Codex <x@y>"))).otherwise(F.col("text"))).withColumn("b", F.when(F.col("conv_id") % 2 == 0, "copilot/x").otherwise("main"))
    return x.select("conv_id", "turn", ci.agent_marker("m", "b").alias("a")).select("conv_id", "turn", "a.marker", "a.source")


_MSG = "concat(case p_partkey % 6 when 0 then 'Error TS2304 at ' when 1 then 'request timed out after ' when 2 then 'ESLint: 3 problems (2 errors) ' when 3 then 'Cannot find module ' when 4 then 'AssertionError: ' else 'odd ' end, '/a/', replace(p_brand, '#', ''), '.ts:', cast(p_size as varchar(5)), ':7 took ', cast(p_size as varchar(5)), 'ms and ', cast(p_size as varchar(5)), '.5s')"
_CLASS = "case p_partkey % 6 when 0 then 'TYPECHECK' when 1 then 'TIMEOUT' when 2 then 'LINT' when 3 then 'DEPENDENCY' when 4 then 'UNIT_TEST' else 'UNKNOWN' end"
_BLURRED = "concat(lower(case p_partkey % 6 when 0 then 'Error TS2304 at ' when 1 then 'request timed out after ' when 2 then 'ESLint: 3 problems (2 errors) ' when 3 then 'Cannot find module ' when 4 then 'AssertionError: ' else 'odd ' end), '<path> took <duration> and <duration>')"


@R.add("failure_classes", f"select p_partkey as id, {_CLASS} as class from part")
def classes(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), v.failure_class(F.expr(_MSG)).alias("class"))


@R.add("failure_fingerprints", f"select concat({_CLASS}, '|job|', lower(p_brand), '||', {_BLURRED}) as fingerprint, count(*) as n from part group by 1")
def fingerprints(spark, sf):
    x = table(spark, sf, "part").withColumn("msg", F.expr(_MSG))
    return x.groupBy(v.fingerprint(v.failure_class("msg"), F.lit(" Job "), "p_brand", F.lit(None), "msg").alias("fingerprint")).agg(F.count("*").alias("n"))


@R.add("value_functions", "select o_orderkey as id, cast(floor(o_totalprice / 3 + 0.5) as bigint) as rounded, cast(floor(case when o_orderkey % 2 = 0 then o_totalprice / 7 * 1000 else o_totalprice / 7 end + 0.5) as bigint) as ms, round(power(0.5, (o_orderkey % 60) / 20.0), 6) as decay, (o_custkey % 90) * 1.0 as minutes from orders")
def value_functions(spark, sf):
    o = table(spark, sf, "orders")
    end = F.expr("o_orderdate + make_dt_interval(0, 0, cast(o_custkey % 90 as int), 0)")
    return o.select(
        F.col("o_orderkey").alias("id"), v.half_up(F.col("o_totalprice") / 3).alias("rounded"), v.duration_ms(F.col("o_totalprice") / 7, F.when(F.col("o_orderkey") % 2 == 0, "s").otherwise("ms")).alias("ms"), F.round(v.decay(F.col("o_orderkey") % 60), 6).alias("decay"), v.minutes("o_orderdate", end).alias("minutes")
    )


@R.add("value_cost_model", "select o_custkey as pr, round(sum(o_totalprice) * 0.008, 6) as cost, round(sum(o_totalprice) / 60 * 0.05, 6) as kwh, round(sum(o_totalprice) / 60 * 0.05 * 400, 6) as grams from orders group by 1")
def cost(spark, sf):
    x = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("pr")).agg(F.sum("o_totalprice").alias("m")).withColumn("e", v.cost_model(F.col("m"), 0.008, 50.0, 400.0))
    return x.select("pr", F.round("e.cost", 6).alias("cost"), F.round("e.kwh", 6).alias("kwh"), F.round("e.grams", 6).alias("grams"))


# misses: events stand for the cases of a full run, its re-run and the pull requests' receipts
_FULL = "full_run as (select event_id as id, concat('f', cast(user_id as varchar(20))) as file, event_type in ('error', 'click') as failed, event_id % 31 = 0 as suite_level from events)"
_PULL = "pulls as (select user_id as number, case user_id % 4 when 0 then 'full' when 1 then 'selected' when 2 then 'selected' else null end as selection, user_id % 4 = 1 as says, user_id as u from (select distinct user_id from events))"


@R.add(
    "misses_classified",
    f"""with {_FULL}, {_PULL}, has as (select concat('f', cast(n as varchar)) as file, number from pulls, (select unnest(range(0, 200)) as n) where says and n % (number % 7 + 2) <> 0)
    select id, case when id % 10 = 1 then 'flaky' when id % 10 = 2 then 'pre-existing' when suite_level then 'unattributed' when (select count(*) from pulls where says) > (select count(*) from has where has.file = f.file) then 'miss' else 'covered' end as class,
      case when id % 10 in (1, 2) or suite_level then 0 else (select count(*) from pulls where says) - (select count(*) from has where has.file = f.file) end as missed_by from full_run f where failed""",
)
def misses(spark, sf):
    e = table(spark, sf, "events")
    full = e.select(F.col("event_id").alias("id"), F.expr("concat('f', cast(user_id as string))").alias("file"), F.expr("event_type in ('error', 'click')").alias("failed"), F.expr("event_id % 31 = 0").alias("suite_level"))
    rerun = full.where("id % 10 < 2").select("id", F.expr("id % 10 = 0").alias("failed"), F.lit(False).alias("skipped"))
    pulls = e.select(F.col("user_id").alias("number")).distinct()
    pulls = pulls.withColumn("selection", F.expr("case number % 4 when 0 then 'full' when 1 then 'selected' end"))
    files = F.expr("case when number % 4 = 1 then transform(filter(sequence(0, 199), n -> n % (number % 7 + 2) <> 0), n -> concat('f', cast(n as string))) end")
    return vd.classify_failures(full, rerun, full.where("id % 10 = 2").select("id"), pulls.withColumn("files", files))


@R.add("junit_merged", "select user_id as report, event_type as id, min(event_id) as ord, case when count(distinct value > 10) > 1 then '' else min(case when value > 10 then 'a' else 'b' end) end as file, bool_or(value > 40) as failed, bool_and(value < 90) as skipped, bool_or(event_id % 50 = 0) as suite_level from events group by 1, 2")
def junit(spark, sf):
    e = table(spark, sf, "events")
    return vd.merged_cases(e.select(F.col("user_id").alias("report"), F.col("event_type").alias("id"), F.col("event_id").alias("ord"), F.expr("case when value > 10 then 'a' else 'b' end").alias("file"), F.expr("value > 40").alias("failed"), F.expr("value < 90").alias("skipped"), F.expr("event_id % 50 = 0").alias("suite_level")))


_CP = """cases as (select event_id as ord, case when user_id % 9 = 8 then null else concat('f', cast(user_id as varchar(20))) end as file, concat(cast(user_id as varchar(20)), event_type, cast(cast(value as bigint) as varchar(20))) as identity, event_id % 23 <> 0 as named, event_type = 'error' as failed, event_type = 'view' as skipped, event_id % 2 as side from events),
plan as (select distinct concat('f', cast(user_id as varchar(20))) as file, user_id % 3 = 0 as selected, 'SELECTIVE' as mode from events where user_id % 9 < 7),
head as (select * from cases where side = 0), base as (select * from cases where side = 1),
hc as (select identity, count(*) as heads from head join plan using (file) where named group by identity), bc as (select identity, count(*) as bases, bool_or(failed) as bf, bool_or(not failed and not skipped) as bp from base join plan using (file) where named group by identity)"""


def _cases(spark, sf):
    e = table(spark, sf, "events")
    c_ = e.select(F.col("event_id").alias("ord"), F.expr("case when user_id % 9 <> 8 then concat('f', cast(user_id as string)) end").alias("file"), F.expr("concat(cast(user_id as string), event_type, cast(cast(value as bigint) as string))").alias("identity"), F.expr("event_id % 23 <> 0").alias("named"), F.expr("event_type = 'error'").alias("failed"), F.expr("event_type = 'view'").alias("skipped"))
    plan = e.where("user_id % 9 < 7").select(F.expr("concat('f', cast(user_id as string))").alias("file"), F.expr("user_id % 3 = 0").alias("selected"), F.lit("SELECTIVE").alias("mode")).distinct()
    return c_, plan


# DuckDB casts doubles to integers by rounding, so values are floored in both
_CP = _CP.replace("cast(cast(value as bigint) as varchar(20))", "cast(cast(floor(value) as bigint) as varchar(20))")


@R.add(
    "plan_check",
    f"""with {_CP} select h.ord, case when h.file is null or p.file is null then 'unattributed' when coalesce(bf, false) and bases = 1 and heads = 1 and named then 'pre-existing'
    when not selected then case when not coalesce(bp, false) or coalesce(heads, 0) > 1 or coalesce(bases, 0) > 1 or not named then 'possible-miss' else 'missed' end else 'selected' end as outcome
    from head h left join plan p on p.file = h.file left join hc using (identity) left join bc using (identity) where h.failed""",
)
def plan_check(spark, sf):
    cases, plan = _cases(spark, sf)
    return vd.check_plan(plan, cases.where("ord % 2 = 0"), cases.where("ord % 2 = 1"))


@R.add("plan_check_without_base", f"with {_CP} select h.ord, case when h.file is null or p.file is null then 'unattributed' when not selected then 'possible-miss' else 'selected' end as outcome from head h left join plan p on p.file = h.file where h.failed")
def plan_check_alone(spark, sf):
    cases, plan = _cases(spark, sf)
    return vd.check_plan(plan, cases.where("ord % 2 = 0"), None)


_TR = "tr as (select user_id as report, cast(dayofmonth(ts) as bigint) as trial, case when event_type in ('view', 'click') then 'full' else 'selected' end as arm, value * case when event_type in ('view', 'click') then 3 else 1 end as ms, not (user_id % 5 = 0 and event_type = 'error') as ok, user_id % 7 <> 0 as stable, user_id % 2 = 0 as controlled, 2.5 as overhead_ms from events)"


def _trials(spark, sf):
    full = "event_type in ('view', 'click')"
    return table(spark, sf, "events").select(
        F.col("user_id").alias("report"), F.dayofmonth("ts").cast("long").alias("trial"), F.expr(f"case when {full} then 'full' else 'selected' end").alias("arm"), F.expr(f"value * case when {full} then 3 else 1 end").alias("ms"),
        F.expr("not (user_id % 5 = 0 and event_type = 'error')").alias("ok"), F.expr("user_id % 7 <> 0").alias("stable"), F.expr("user_id % 2 = 0").alias("controlled"), F.lit(2.5).alias("overhead_ms"), "event_type", "value", "user_id",
    )


@R.add(
    "savings_report",
    f"""with {_TR}, g as (select report, min(case when arm = 'full' then ms end) as full_min, median(case when arm = 'full' then ms end) as full_median, max(case when arm = 'full' then ms end) as full_max, min(case when arm = 'selected' then ms end) as selected_min,
    median(case when arm = 'selected' then ms end) as selected_median, max(case when arm = 'selected' then ms end) as selected_max, bool_and(ok and stable and ms <= 1000) as valid, bool_and(controlled) as controlled, count(distinct trial) as n from tr group by report)
    select report, {", ".join(f"round({x}, 6) as {x}" for x in ("full_min", "full_median", "full_max", "selected_min", "selected_median", "selected_max"))}, round(selected_median + 2.5, 6) as net_selected, round(full_median - selected_median - 2.5, 6) as delta,
    round((full_median - selected_median - 2.5) / full_median * 100, 6) as percent, case when not valid then 'INVALID' when n >= 3 and controlled then 'CONTROLLED' else 'PRELIMINARY' end as grade from g""",
)
def savings(spark, sf):
    x = vd.savings(_trials(spark, sf), 1000)
    return x.select("report", *(F.round(k, 6).alias(k) for k in x.columns if k not in ("report", "grade")), "grade")


_TA = "ta as (select user_id % 60 as report, user_id // 60 as trial, case when event_type = 'error' then 'full' else 'selected' end as arm, bool_and(case user_id % 60 % 5 when 0 then true when 1 then event_type <> 'error' when 2 then user_id % 2 = 0 else false end) as ok, max(case when user_id % 60 % 5 = 3 then 'TIMEOUT' else 'UNIT_TEST' end) as class, case when user_id % 60 % 7 = 1 then concat('p', cast(user_id as varchar(20))) else 'p' end as fp from events where event_type in ('error', 'view') group by user_id, 3)"


@R.add(
    "savings_failures",
    f"""with {_TA}, g as (select report, count(*) filter (where not ok) as bad, count(distinct trial) as n, count(distinct ok) filter (where arm = 'full') as fs, count(distinct ok) filter (where arm = 'selected') as ss, bool_or(not ok and class = 'TIMEOUT') as infra,
    count(*) filter (where not ok and arm = 'full') as fb, count(*) filter (where not ok and arm = 'selected') as sb, count(distinct fp) filter (where not ok and arm = 'full') as fp, count(distinct fp) filter (where not ok and arm = 'selected') as sp, count(distinct fp) filter (where not ok) as pp from ta group by report),
    k as (select *, case when bad = 0 then 'none' when fs > 1 or ss > 1 then 'likely_flaky' when infra then 'infrastructure' when fb = n and fp = 1 and sb = 0 then case when n >= 3 then 'selection_miss' else 'inconclusive' end when fb = n and fp = 1 and sb = n and sp = 1 and pp = 1 then 'pre_existing' else 'inconclusive' end as kind from g)
    select report, kind, case kind when 'none' then 'not-applicable' when 'likely_flaky' then case when n >= 3 then 'medium' else 'low' end when 'infrastructure' then 'medium' when 'selection_miss' then 'high' when 'pre_existing' then case when n >= 2 then 'medium' else 'low' end else 'low' end as confidence from k""",
)
def assess(spark, sf):
    e = table(spark, sf, "events").where("event_type in ('error', 'view')")
    ok = "case user_id % 60 % 5 when 0 then true when 1 then event_type <> 'error' when 2 then user_id % 2 = 0 else false end"
    t = e.groupBy("user_id", F.expr("case when event_type = 'error' then 'full' else 'selected' end").alias("arm")).agg(F.expr(f"bool_and({ok})").alias("ok"))
    return vd.assess_failures(t.select(F.expr("user_id % 60").alias("report"), F.expr("user_id div 60").alias("trial"), "arm", "ok", F.expr("case when user_id % 60 % 5 = 3 then 'TIMEOUT' else 'UNIT_TEST' end").alias("class"), F.expr("case when user_id % 60 % 7 = 1 then concat('p', cast(user_id as string)) else 'p' end").alias("fingerprint")))


@R.add(
    "economics_gate",
    """with s as (select user_id as job, event_id as head, value * 10 as f, value * case when user_id % 2 = 0 then 9.9 else 4 end as p, value * 30 + 100 as o, value > 1 as ok from events),
    g as (select job, count(*) between 5 and 100 and bool_and(ok and f > 0 and p > 0 and o > 0) and count(distinct head) >= 5 as usable, greatest(0, max(f - p)) as saved, min(o) as obs from s group by job)
    select job, case when usable and saved * 1.25 + 250 < obs then 'BYPASS_FULL' else 'ANALYZE' end as decision, case when usable then round(saved, 6) end as saved_ms, case when usable then round(obs, 6) end as observer_ms from g""",
)
def economics(spark, sf):
    e = table(spark, sf, "events")
    x = vd.economics(e.select(F.col("user_id").alias("job"), F.col("event_id").alias("head_sha"), F.expr("value * 10").alias("full_ms"), F.expr("value * case when user_id % 2 = 0 then 9.9 else 4 end").alias("policy_ms"), F.expr("value * 30 + 100").alias("observer_ms"), F.expr("value > 1").alias("stable")))
    return x.select("job", "decision", F.round("saved_ms", 6).alias("saved_ms"), F.round("observer_ms", 6).alias("observer_ms"))


@R.add("enforce_gate", f"select event_id as observation, case {' '.join(f'''when {'event_id % 67 = 5 or ' if i == 3 else ''}event_id % {i + 11} = {i} then '{s}' ''' for i, s in enumerate(vd.ENFORCE_STEPS))} else 'allowed' end as outcome from events")
def enforce(spark, sf):
    e = table(spark, sf, "events")
    return vd.enforce(e.select(F.col("event_id").alias("observation"), *(F.expr(f"case when {'event_id % 67 = 5' if i == 3 else 'false'} then null else event_id % {i + 11} = {i} end").alias(s) for i, s in enumerate(vd.ENFORCE_STEPS))))


@R.add("spec_conflicts", "select target, array_to_string(list_sort(list(distinct s)), ',') as specs from (select lower(trim(p_name)) as target, p_brand as s from part) group by target having count(distinct s) > 1")
def specs(spark, sf):
    x = vd.spec_conflicts(table(spark, sf, "part").select(F.concat(F.lit(" "), F.upper("p_name")).alias("target"), F.col("p_brand").alias("spec")))
    return x.select("target", F.array_join("specs", ",").alias("specs"))


# pipelines: orders are jobs, line items their steps
@R.add("matrix_cells", "select s_suppkey as job, n, os, shard from supplier, (select unnest(['18', '20', '22']) as n), (select unnest(['linux', 'mac']) as os), (select unnest(['1', '2']) as shard) where s_suppkey % 4 <> 0 and not (os = 'mac' and n = '18' and s_suppkey % 2 = 1)")
def matrix(spark, sf):
    jobs = table(spark, sf, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("job"))
    axes = spark.createDataFrame([(o, k, i, x) for o, (k, vs) in enumerate([("n", ["18", "20", "22"]), ("os", ["linux", "mac"]), ("shard", ["1", "2"])]) for i, x in enumerate(vs)], "ord int, key string, pos int, value string")
    out = inf.matrix_cells(jobs.crossJoin(F.broadcast(axes)), jobs.where("job % 2 = 1").select("job", F.create_map(F.lit("os"), F.lit("mac"), F.lit("n"), F.lit("18")).alias("assignment")))  # seven axis values
    return out.select("job", *(F.col("assignment")[k].alias(k) for k in ("n", "os", "shard")))


@R.add(
    "operation_completeness",
    """with s as (select l_orderkey as op, l_linenumber % 3 as slot, bool_or(l_quantity > 12) as met, bool_or(l_quantity = 50) as blocked from lineitem group by 1, 2), o as (select op, count(*) filter (where not met) as unmet, bool_or(blocked) as blocked from s group by op)
    select op as operation, unmet = 0 and not blocked as complete, case when unmet = 0 and not blocked then 'HIGH' when unmet = 1 and not blocked then 'MEDIUM' else 'LOW' end as confidence from o""",
)
def completeness(spark, sf):
    return inf.completeness(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("operation"), F.expr("l_linenumber % 3").alias("slot"), F.expr("l_quantity > 12").alias("satisfied"), F.expr("l_quantity = 50").alias("blocked")))


@R.add("provider_jobs", "select purpose, job from (select o_custkey as purpose, o_orderkey as job, row_number() over (partition by o_custkey order by o_orderkey % 2, cast(substr(o_orderpriority, 1, 1) as integer), o_orderkey) as n from orders) where n = 1")
def providers(spark, sf):
    return inf.provider_job(table(spark, sf, "orders").select(F.col("o_custkey").alias("purpose"), F.col("o_orderkey").alias("job"), F.col("o_orderkey").alias("ord"), F.expr("o_orderkey % 2").alias("skips"), F.expr("cast(substr(o_orderpriority, 1, 1) as int)").alias("blocked")))


_ST = "st as (select l_orderkey as job, l_linenumber as ord, max(case l_partkey % 5 when 0 then 'install' when 1 then 'test' when 2 then 'build' else 'other' end) as kind, max(case l_suppkey % 6 when 0 then 'FALSE' when 1 then 'UNRESOLVED' else 'TRUE' end) as condition from lineitem group by 1, 2)"


def _steps(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("ord")).agg(
        F.max(F.expr("case l_partkey % 5 when 0 then 'install' when 1 then 'test' when 2 then 'build' else 'other' end")).alias("kind"), F.max(F.expr("case l_suppkey % 6 when 0 then 'FALSE' when 1 then 'UNRESOLVED' else 'TRUE' end")).alias("condition")
    )


@R.add("purpose_paths", f"with {_ST}, p as (select *, max(case when kind = 'test' then ord end) over (partition by job) as last from st) select job, ord, condition <> 'FALSE' as active from p where ord <= last")
def purpose_paths(spark, sf):
    return inf.purpose_path(_steps(spark, sf).withColumn("provides", F.col("kind") == "test"))


@R.add("causal_installs", f"with {_ST} select a.job, a.ord, max(b.ord) as install from st a left join st b on b.job = a.job and b.ord < a.ord and b.kind = 'install' and b.condition <> 'FALSE' where a.kind <> 'install' group by a.job, a.ord")
def installs(spark, sf):
    return inf.preceding_provider(_steps(spark, sf))


@R.add("steps_feeding_tests", f"with {_ST} select job, ord from st a where exists (select 1 from st b where b.job = a.job and b.ord > a.ord and b.kind = 'test')")
def feeding(spark, sf):
    return inf.feeds_tests(_steps(spark, sf))


@R.add("job_purposes", f"with {_ST}, f as (select job, kind, min(ord) as o from st where kind <> 'other' group by job, kind) select job, string_agg(kind, ',' order by o) as purposes from f group by job")
def purposes(spark, sf):
    return inf.provided_purposes(_steps(spark, sf).withColumn("purpose", F.when(F.col("kind") != "other", F.col("kind")))).select("job", F.array_join("purposes", ",").alias("purposes"))


@R.add(
    "conditions",
    """select o_orderkey as id, case o_orderkey % 8 when 0 then 'TRUE' when 1 then case when o_orderstatus = 'F' then 'TRUE' else 'FALSE' end when 2 then case when o_orderstatus = 'F' then 'FALSE' else 'TRUE' end when 3 then 'UNRESOLVED' when 4 then 'UNRESOLVED' when 5 then 'FALSE' when 6 then 'TRUE' else 'UNRESOLVED' end as value from orders""",
)
def conditions(spark, sf):
    texts = F.expr("case o_orderkey % 8 when 0 then null when 1 then \"${{ job.status == 'f' }}\" when 2 then \"job.status != 'F'\" when 3 then \"other.name == 'x'\" when 4 then \"contains(a, b) && c\" when 5 then 'false' when 6 then '${{ always() }}' else concat(\"'a' == '\", repeat('x', 1001), \"'\") end")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), c.evaluate(texts, F.create_map(F.lit("job.status"), F.col("o_orderstatus"))).alias("value"))


QUERIES, ORACLES = R.queries, R.oracles
