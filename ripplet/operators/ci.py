"""CI history: why builds were red, and whose fault it was.

run(run, workflow_id, workflow_name, head_sha, pr, branch, conclusion, actor, minutes); job(run, job, name, conclusion,
started, failed_steps, steps_known); annotation(job, signature).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplet.runtime import again, store

VERDICTS = "flaky infra ci-only shared likely partly preventable".split()
IDLE = ["action_required", "skipped", "startup_failure"]


def _words(*words: str) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


INFRA_STEP = "(?i)" + "|".join(["setup", "set up", "install", "checkout", "cache", "restore", "upload", "download", "login", "docker", "post "])
LOCK_STEP = "(?i)lock ?file|migration ordering"
STRONG = _words("playwright", "puppeteer", "cypress", "selenium", "browserstack", "e2e", "end[- ]to[- ]end", "preview", "deploy(ment)?", "lighthouse", "visual", "percy", "chromatic", "docker")
CI_SIDE = _words(
    "publish", "release", "container", "image", "perf(ormance)?", "bench(mark)?s?", "bundle[- ]?size", "size[- ]?(limit|check)?", "security", "codeql", "dependency[- ]review", "snyk", "label(er)?", "licen[cs]e",
    "triage", "stale", "cla", "storybook", "semantic", "dco", "changeset", "pr[- ]title", "danger", "lockfile", "coverage[- ]upload", "codecov", "netlify", "vercel", "sonar",
)
CHECK = _words(
    "eslint", "lint(ing)?", "prettier", "biome", "fmt", "format(ting)?", "style", "types", "type[- ]?check(ing)?", "tsc", "pyright", "mypy", "vet", "clippy", "compile", "build", "tests?", "unit", "suites?", "jest", "vitest", "pytest", "mocha",
    "integration", "spec", "check",
)
LOCAL_WORKFLOW = _words("lint(ing)?", "unit[- ]?tests?", "type[- ]?checks?", "static[- ]analysis")
_ENDS = "gate verify required ci status summary result results conclusion complete done finish finished success alls-green"
_GATES = [_ENDS.replace(" ", "|"), "check[ -]results?", "(?:checks?|test|build|merge|ci|pr)[ -]?gate", "ci[ -]?(?:success|ok|passed|status|result)", "all[ -]?(?:checks|required|green|jobs)?(?:[ -]?(?:pass|passed|ok|green))?"]
GATE = f"(?i)^(?:{'|'.join(_GATES)})$"
GATE_END = r"(?i)(?:^|\s)(?:status[\s-]checks?|required?s?[\s-]all[\s-]checks?(?:[\s-]to)?[\s-](?:passed|pass|succeeded|succeed))$"
TIMEOUT = "(?i)timed out|timeout"
AGENT = r"(?i)^(jules|devin|cursor|copilot|codex|claude)[-/]"
TRAILER = r"(?i)co-authored-by:.*?\b(aider|jules|devin|cursor|copilot|codex|claude|windsurf)\b"


def job_name(name: str | Column) -> Column:
    """A job's own name: the last part after " / "."""
    return F.trim(F.element_at(F.split(name, " / "), -1))


def is_gate(name: str | Column) -> Column:
    own = F.trim(F.regexp_replace(job_name(name), "[()]", ""))
    return own.rlike(GATE) | own.rlike(GATE_END)


def bucket(name: str | Column, conclusion: str | Column, failed_steps: str | Column, steps_known: str | Column, workflow: str | Column) -> Column:
    """infra, ci-only or check: what a failing job's steps and name say, in this order."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    steps, known, own = F.coalesce(c(failed_steps), F.expr("cast(array() as array<string>)")), F.coalesce(c(steps_known), F.lit(True)), job_name(name)
    some = F.size(steps) > 0
    return (
        F.when(~known & (F.coalesce(c(conclusion), F.lit("")) != "failure"), "infra")
        .when(known & ~some, "infra")
        .when(some & F.forall(steps, lambda s: s.rlike(INFRA_STEP)), "infra")
        .when(some & F.forall(steps, lambda s: s.rlike(LOCK_STEP)), "ci-only")
        .when(own.rlike(STRONG), "ci-only")
        .when(own.rlike(CHECK), "check")
        .when(c(workflow).rlike(LOCAL_WORKFLOW) & ~c(workflow).rlike(STRONG) & ~own.rlike(CI_SIDE), "check")
        .otherwise("ci-only")
    )


def branch_agent(branch: str | Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(branch, AGENT, 1)), F.lit(""))


def agent_marker(message: str | Column, branch: str | Column) -> Column:
    """The agent a commit names, and where: a trailer beats the branch."""
    trailer = F.nullif(F.lower(F.regexp_extract(message, TRAILER, 1)), F.lit(""))
    return F.struct(F.coalesce(trailer, branch_agent(branch), F.lit("")).alias("marker"), F.when(trailer.isNotNull(), "trailer").when(branch_agent(branch).isNotNull(), "branch").otherwise("").alias("source"))


def ran(conclusion: str | Column) -> Column:
    c = F.col(conclusion) if isinstance(conclusion, str) else conclusion
    return c.isNotNull() & ~c.isin(*IDLE)


def nothing_ran(jobs: DataFrame) -> DataFrame:
    """(run, nothing): no job of the run started, or all were skipped."""
    return jobs.groupBy("run").agg(F.bool_and(F.col("started").isNull() | F.coalesce(F.col("conclusion") == "skipped", F.lit(False))).alias("nothing"))


def own_failures(runs: DataFrame, jobs: DataFrame, annotations: DataFrame) -> DataFrame:
    """(run, job, name, bucket, ownership) of the failing jobs that count in each red run; gates count only alone."""
    red = runs.where("conclusion = 'failure'").select("run", "pr", "workflow_name")
    failing = jobs.where("conclusion in ('failure', 'timed_out')").join(red, "run").withColumn("bucket", bucket("name", "conclusion", "failed_steps", "steps_known", "workflow_name")).withColumn("gate", is_gate("name"))
    # both are read several times, and names are judged by many expressions
    failing = store(failing.select("run", "job", "name", "pr", "bucket", "gate"), "failing-jobs")
    signed = again(failing).where("bucket = 'check'").join(annotations.where("signature is not null").select("job", "signature").distinct(), "job")
    signed = store(signed.select("job", "signature", "pr"), "signed-jobs")
    # on how many pull requests a signature, and a check job's name, was seen
    spread = again(signed).groupBy("signature").agg(F.count_distinct("pr").alias("seen"))
    per_job = signed.select("job", "signature").join(spread, "signature").groupBy("job").agg(
        F.bool_and(F.col("signature").rlike(TIMEOUT)).alias("timeouts"), F.bool_or(~F.col("signature").rlike(TIMEOUT) & (F.col("seen") > 1)).alias("elsewhere")
    )
    names = again(failing).where("bucket = 'check'").groupBy("name").agg(F.count_distinct("pr").alias("failed_on"))
    all_prs = runs.agg(F.count_distinct("pr").alias("prs"))
    real = failing.withColumn("others", F.max(~F.col("gate")).over(Window.partitionBy("run"))).where("not gate or not others")
    everyone = (F.col("failed_on") >= 5) & (F.col("failed_on") * 2 >= F.col("prs"))
    ownership = F.when(F.col("bucket") == "check", F.when(F.col("timeouts").isNull(), F.when(everyone, "shared").otherwise("unknown")).when(F.col("timeouts"), "timeout").when(F.col("elsewhere"), "shared").otherwise("own"))
    return real.join(per_job, "job", "left").join(names, "name", "left").crossJoin(all_prs).select("run", "job", "name", "bucket", ownership.alias("ownership"))  # all_prs is one row


def verdicts(runs: DataFrame, jobs: DataFrame, annotations: DataFrame) -> DataFrame:
    """(run, verdict) of every red run in which something ran."""
    ran = nothing_ran(jobs).where("not nothing").select("run")
    red = runs.where("conclusion = 'failure'").join(ran, "run", "left_semi")
    passed = runs.where("conclusion = 'success'").select("workflow_id", "head_sha").distinct().withColumn("passed", F.lit(True))
    f = own_failures(runs, jobs, annotations).where("bucket <> 'infra'")
    check = F.col("bucket") == "check"
    is_ = lambda o: F.coalesce(F.col("ownership") == o, F.lit(False))
    facts = f.groupBy("run").agg(
        F.count_if(check).alias("checks"), F.bool_or(F.col("bucket") == "ci-only").alias("ci"), F.bool_and(~check | is_("own")).alias("all_own"), F.bool_or(is_("own")).alias("own"),
        F.bool_and(~check | is_("unknown")).alias("all_unknown"), F.bool_or(is_("shared")).alias("shared"),
    )
    v = (
        F.when(F.col("checks").isNull(), "infra").when(F.col("passed"), "flaky").when(F.col("checks") == 0, "ci-only").when(F.col("all_own") & ~F.col("ci"), "preventable").when(F.col("own"), "partly")
        .when(F.col("all_unknown") & ~F.col("ci"), "likely").when(F.col("shared"), "shared").when(F.col("ci"), "ci-only").otherwise("likely")
    )
    return red.join(facts, "run", "left").join(passed, ["workflow_id", "head_sha"], "left").select("run", v.alias("verdict"))


def summarise(runs: DataFrame, verdict: DataFrame) -> DataFrame:
    """(verdict, runs, runner_minutes, pull_requests): all seven verdicts, also those that no run has."""
    spark = runs.sparkSession
    all_ = spark.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    agg = verdict.join(runs.select("run", "pr", "minutes"), "run").groupBy("verdict").agg(F.count("*").alias("runs"), F.floor(F.sum("minutes") + 0.5).alias("runner_minutes"), F.count_distinct("pr").alias("pull_requests"))
    return all_.join(agg, "verdict", "left").na.fill(0)


def dominated(runs: DataFrame, verdict: DataFrame) -> DataFrame:
    """One row (largest, preventable, dominated): does one pull request hold most of the preventable runs, and three at least?"""
    per = verdict.where("verdict = 'preventable'").join(runs.select("run", "pr"), "run").groupBy("pr").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).alias("preventable")).withColumn("dominated", (F.col("largest") >= 3) & (F.col("largest") * 2 > F.col("preventable")))


def agent_slices(runs: DataFrame, verdict: DataFrame) -> DataFrame:
    """(agent, pull_request_runs, ran_runs, red_runs, and a column a verdict)."""
    agent = F.coalesce(branch_agent("branch"), F.lit("none"))
    base = runs.groupBy(agent.alias("agent")).agg(F.count("*").alias("pull_request_runs"), F.count_if(ran("conclusion")).alias("ran_runs"), F.count_if(F.coalesce(F.col("conclusion") == "failure", F.lit(False))).alias("red_runs"))
    split = verdict.join(runs.select("run", agent.alias("agent")), "run").groupBy("agent").pivot("verdict", VERDICTS).count()
    return base.join(split, "agent", "left").na.fill(0)


MAIN_WORKFLOW = _words("ci", "cd", "pipeline", "tests?", "pull[-_ ]request", "pr", "checks?", "build", "validate", "verify", "main", "quality", "lint", "unit", "unittests?")
SIDE_WORKFLOW = _words("codeql", "security", "sonar\\w*", "bench(mark)?s?", "preview", "release", "publish", "deploy(ment)?", "stale", "label(er)?", "docs?", "nightly", "bot")


def workflow_score(name: str | Column, minutes: str | Column) -> Column:
    """Minutes, doubled for a name like CI's, cut to a twentieth for a side workflow's, a little more for test words."""
    n = F.col(name) if isinstance(name, str) else name
    m = F.col(minutes) if isinstance(minutes, str) else minutes
    side, main = n.rlike(SIDE_WORKFLOW), n.rlike(MAIN_WORKFLOW)
    generic = F.forall(F.filter(F.split(F.lower(n), "[^a-z]+"), lambda w: w != ""), lambda w: w.rlike(MAIN_WORKFLOW) | w.isin("and", "run"))
    test = n.rlike(_words("tests?", "unit", "unittests?", "ci"))
    return (m + 0.01) * F.when(side, 0.05).otherwise(1.0) * F.when(main, 2.0).otherwise(1.0) * F.when(main & ~side & test, 1.05).otherwise(1.0) * F.when(main & ~side & generic, 1.5).otherwise(1.0)


def main_workflow(sample: DataFrame) -> DataFrame:
    """One row: of sample(ord, workflow_id, name, conclusion, span) the workflow with the best score of its minutes, each run's cut at six hours."""
    minutes = F.when(~F.coalesce(F.col("conclusion").isin(*IDLE), F.lit(False)) & (F.col("span") > 0), F.least("span", F.lit(360.0))).otherwise(0.0)
    w = sample.groupBy("workflow_id").agg(F.min_by("name", "ord").alias("name"), F.sum(minutes).alias("minutes"), F.min("ord").alias("ord")).withColumn("score", workflow_score("name", "minutes"))
    return w.orderBy(F.desc("score"), "ord").limit(1).select("workflow_id", "name", "minutes", "score")


def suggest_workflows(workflows: DataFrame, k: int = 5) -> DataFrame:
    """(name, score): active workflows that look like the main CI, best first, shorter names first among equals."""
    return workflows.where("state = 'active'").where(F.col("name").rlike(MAIN_WORKFLOW) & ~F.col("name").rlike(SIDE_WORKFLOW)).select("name", workflow_score("name", F.lit(1.0)).alias("score")).orderBy(F.desc("score"), F.length("name"), "name").limit(k)
