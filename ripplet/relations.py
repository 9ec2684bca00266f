"""The engine's relations, derived from the driver's tables: as DataFrames and, for the oracle, as SQL.

There are no repositories in these tables, so parts stand for files, orders for CI runs, line items for jobs and imports,
events for test outcomes. Every derivation is an expression that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ENDS = [".ts", ".test.ts", ".md", ".css", ".json", ".yml", ".sql", ".tsx", ".go", ".py", "_test.go", ".svg"]
_END = "case p_partkey % 12 " + " ".join(f"when {i} then '{e}'" for i, e in enumerate(ENDS)) + " end"
PATH = f"concat(lower(p_type), '/', replace(p_name, ' ', '/'), '/f', cast(p_partkey as varchar(20)), {_END})"
CHANGE = "case p_partkey % 4 when 0 then 'added' when 1 then 'modified' when 2 then 'renamed' else 'deleted' end"

SQL = {
    "node": "select p_partkey as path, p_partkey % 5 = 0 as is_test, p_partkey % 7 <> 3 as is_source, p_partkey % 7 = 3 as is_asset, p_partkey % 35 = 0 as is_type_test from part where p_partkey % 97 <> 57",
    "edge": """select src, dst, max(kind) as kind from (select a.l_partkey as src, b.l_partkey as dst, case when a.l_linenumber = 1 then 'type-import' else 'import' end as kind
      from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
      where a.l_returnflag = 'R' and a.l_quantity <= 5 and a.l_partkey <> b.l_partkey) e group by src, dst""",
    "changed": f"select p_partkey as path, p_partkey as ord, {CHANGE} as change_type from part where p_partkey % 50 in (7, 10)",
    "file": f"select p_partkey as ord, {PATH} as path from part",
    "file_change": f"select p_partkey as ord, {PATH} as path, {CHANGE} as change_type, case when p_partkey % 4 = 2 then concat('old/', {PATH}) end as old_path from part where p_partkey % 5 = 1",
    "outcome_test": """select cast(dayofmonth(ts) as bigint) as seq, user_id as test, user_id as pos, max(case when event_type = 'error' and value > 20 then 1 else 0 end) = 1 as failed, max(value) as ms
      from events group by 1, 2, 3""",
    "outcome": """select seq, seq % 7 as tree_sha, case when clicks % 2 = 0 then 'selected' else 'full' end as selection, case when errors % 3 = 0 then 'passed' when errors % 3 = 1 then 'failed' else 'blocked' end as verification,
      case when views % 5 <> 0 then total end as tests_ms, case when views % 3 = 0 then 'bot' end as agent, views, errors
      from (select cast(dayofmonth(ts) as bigint) * 24 + hour(ts) as seq, sum(case when event_type = 'click' then 1 else 0 end) as clicks, sum(case when event_type = 'error' then 1 else 0 end) as errors,
        sum(case when event_type = 'view' then 1 else 0 end) as views, max(value) as total from events group by 1) h""",
    "ci_run": """select o_orderkey as run, o_orderkey % 5 as workflow_id, case o_orderkey % 5 when 0 then 'CI' when 1 then 'Unit tests' when 2 then 'E2E' when 3 then 'CodeQL security' else 'Docs preview' end as workflow_name,
      concat('sha', cast(o_custkey * 3 + o_orderkey % 3 as varchar(20))) as head_sha, concat('pr', cast(o_custkey as varchar(20))) as pr,
      concat(case o_custkey % 6 when 0 then 'copilot/' when 1 then 'Claude-' when 2 then 'codex/' else 'fix/' end, 'b', cast(o_custkey as varchar(20))) as branch,
      case o_orderstatus when 'F' then 'failure' when 'O' then 'success' else case when o_orderkey % 2 = 0 then 'skipped' else 'failure' end end as conclusion, o_custkey as actor from orders""",
    "ci_job": """select l_orderkey as run, l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey % 10000 as job, max(case l_suppkey % 8 when 0 then 'lint' when 1 then 'CI / unit tests' when 2 then 'E2E tests' when 3 then 'deploy'
      when 4 then 'build (ubuntu)' when 5 then 'all checks passed' when 6 then 'policy' else 'typecheck' end) as name,
      max(case when l_returnflag = 'R' then 'failure' when l_returnflag = 'A' then 'success' else 'timed_out' end) as conclusion, max(case when l_linestatus = 'F' or l_quantity > 10 then 1 else 0 end) = 1 as started,
      max(case l_partkey % 5 when 0 then 'Set up node' when 1 then 'Check lockfile' when 2 then '' else 'Run it' end) as step, max(l_partkey) % 11 <> 0 as steps_known, max(l_quantity) as minutes
      from lineitem group by l_orderkey, l_linenumber, l_suppkey""",
    "annotation": """select l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey % 10000 as job, concat('src/f', cast(l_partkey as varchar(20)), '.ts') as path, case when l_partkey % 9 = 0 then 'job timed out' else 'failed' end as title,
      concat('expected value', cast(cast(l_quantity / 10 as integer) as varchar(20)), ' to hold at /tmp/x', cast(l_orderkey as varchar(20)), ' there') as message from lineitem where l_partkey % 4 <> 3""",
}


def sql(*names: str) -> str:
    """A WITH list of the named relations."""
    return "with recursive " + ", ".join(f"{n} as ({SQL[n]})" for n in names)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation as a DataFrame: its SQL over the tables it names."""
    text, views = SQL[name], {}
    for t in ("lineitem", "orders", "part", "events"):
        if f" {t} " in f"{text} ".replace("\n", " "):
            views[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for t in views:
        text = text.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(text, **views)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


