"""Queries over the smaller rules."""

from pyspark.sql import functions as F

from ripplet.operators import rules as r
from ripplet.plans.registry import Registry
from ripplet.relations import load, sql, table

R = Registry()
_F, _C = sql("file"), sql("file_change")
_NAMES = ["infra/main.tf", "infra/run.py", "infra/README.md", "infra/x.bin", "src/a.ts", ".eslintrc.json", "tsconfig.base.json", "vite.config.ts", "jest.config.js", ".prettierrc", "a/testdata/x", "_skip/y.go", "b/conftest.py", ".env.local", "x/__mocks__/m.ts"]
_LIST = "(select unnest([" + ", ".join(f"'{n}'" for n in _NAMES) + "]) as name)"


def _names(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.explode(F.array(*(F.lit(n) for n in _NAMES))).alias("name")).withColumn("path", F.concat(F.lit("d"), F.col("n_nationkey").cast("string"), F.lit("/"), "name"))


@R.add(
    "rule_path_roles",
    f"""select concat('d', cast(n_nationkey as varchar), '/', name) as path, case when name like '.eslintrc%' then 'lint' when name = '.prettierrc' then 'format' when name like 'tsconfig%' then 'types' when name like 'vite.%' then 'bundle' when name like 'jest.%' then 'test' end as subject,
    case name when 'infra/main.tf' then 'definition' when 'infra/run.py' then 'code' when 'infra/README.md' then 'documentation' when 'infra/x.bin' then 'data' end as role,
    name in ('tsconfig.base.json', 'vite.config.ts', 'jest.config.js', 'b/conftest.py', '.env.local', 'x/__mocks__/m.ts') as implicit, name in ('a/testdata/x', '_skip/y.go', '.eslintrc.json', '.prettierrc', '.env.local', 'x/__mocks__/m.ts') as go_ignored from nation, {_LIST}""",
)
def path_roles(spark, sf):
    return _names(spark, sf).select("path", r.tool_subject("path").alias("subject"), r.infrastructure_role("path").alias("role"), r.implicitly_loaded("path").alias("implicit"), r.go_ignored("path").alias("go_ignored"))


@R.add("rule_suite_members", f"{_F} select path, (starts_with(path, 'small/') or starts_with(path, 'large/')) and not contains(path, '/hot/') and not ends_with(path, 'f1.test.ts') and (ends_with(path, '.test.ts') or ends_with(path, '_test.go')) as member from file")
def suite(spark, sf):
    return load(spark, sf, "file").select("path", r.matches_suite("path", ["small", "large"], ["/hot/"], ["*.test.ts", "**/*_test.go"], ["**/f1.test.ts"]).alias("member"))


@R.add("rule_translations", f"{_F}, m as (select path from file where path like '%.md') select replace(path, '.md', '.de.md') as path, path as original from m")
def translations(spark, sf):
    f = load(spark, sf, "file").where("path like '%.md'")
    return r.translated_companions(f.select(F.expr("replace(path, '.md', '.de.md')").alias("path")), f)


@R.add("rule_declaration_edges", f"{_F} select 's' as src, replace(path, '.ts', '.d.ts') as dst, 'import' as kind from file where ord % 12 = 0 union select 's', replace(path, '.ts', '.js'), 'import' from file where ord % 12 = 0 and ord % 5 = 0")
def declarations(spark, sf):
    f = load(spark, sf, "file").where("ord % 12 = 0")
    edges = f.select(F.lit("s").alias("src"), F.expr("replace(path, '.ts', '.d.ts')").alias("dst"), F.lit("import").alias("kind"))
    return r.declaration_edges(edges, f.where("ord % 5 = 0").select(F.expr("replace(path, '.ts', '.js')").alias("path")))


@R.add("rule_bindings", "with i as (select l_suppkey as src, l_partkey % 50 as dst, case when l_quantity = 1 then '*' else concat('n', cast(l_linenumber as varchar)) end as name from lineitem where l_quantity < 6) select src, dst, bool_or(name = '*') as whole, case when bool_or(name = '*') then '*' else array_to_string(list_sort(list(distinct name)), ',') end as names from i group by src, dst")
def binding(spark, sf):
    i = table(spark, sf, "lineitem").where("l_quantity < 6").select(F.col("l_suppkey").alias("src"), F.expr("l_partkey % 50").alias("dst"), F.expr("case when l_quantity = 1 then '*' else concat('n', cast(l_linenumber as string)) end").alias("name"))
    return r.bindings(i).select("src", "dst", "whole", F.array_join("names", ",").alias("names"))


@R.add("rule_directory_listers", f"{_C}, l as (select unnest(['t1', 't2', 't3']) as test, unnest(['small', 'large/hot', '']) as dir) select distinct test, path from file_change join l on dir = '' or starts_with(path, dir || '/')")
def listers(spark, sf):
    return r.directory_listers(load(spark, sf, "file_change"), spark.createDataFrame([("t1", "small"), ("t2", "large/hot"), ("t3", "")], "test string, dir string"))


@R.add("rule_layout_descendants", f"{_F}, l as (select path as layout, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from file where ord % 120 = 7) select layout, path as entry from l join file on starts_with(path, dir || '/') and path <> layout")
def descendants(spark, sf):
    f = load(spark, sf, "file")
    return r.layout_descendants(f.where("ord % 120 = 7"), f)


@R.add("rule_risk_signals", "select event_type as reason, arg_max(event_id, event_id) as detail from events group by event_type")
def risks(spark, sf):
    return r.risk_signals(table(spark, sf, "events").select(F.col("event_type").alias("reason"), F.col("event_id").alias("detail"), F.col("event_id").alias("ord")))


@R.add(
    "rule_fallback_messages",
    """with p as (select concat('reason ', cast(user_id as varchar)) as text, min(event_id) as ord, list_sort(list(distinct concat('f', cast(event_id % 9 as varchar)))) as ps from events group by user_id)
    select concat(text, ': ', array_to_string(ps[1:5], ', '), case when len(ps) > 5 then concat(' (+', cast(len(ps) - 5 as varchar), ' more)') else '' end) as message, ord from p""",
)
def messages(spark, sf):
    e = table(spark, sf, "events")
    return r.fallback_messages(e.select(F.col("event_id").alias("ord"), F.expr("concat('reason ', cast(user_id as string))").alias("text"), F.expr("concat('f', cast(event_id % 9 as string))").alias("path")))


@R.add("rule_coverage_counts", "select count(distinct l_suppkey) as tests, count(distinct case when l_quantity > 3 then l_partkey end) as files from lineitem")
def counts(spark, sf):
    return r.coverage_counts(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("test"), F.col("l_partkey").alias("path"), F.expr("l_quantity <= 3").alias("is_dir")))


@R.add("rule_suite_split", "select distinct user_id as test, user_id % 3 = 0 and user_id in (select s_suppkey from supplier) as inside from events")
def split(spark, sf):
    return r.suite_split(table(spark, sf, "events").select(F.col("user_id").alias("test")), table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("test")))


@R.add("rule_added_entry_points", f"{_C} select concat('app/', regexp_replace(path, '[^/]+$', 'page.tsx')) as path from file_change where change_type = 'added' group by 1 having min(ord) % 3 <> 0")
def added(spark, sf):
    c = load(spark, sf, "file_change").withColumn("path", F.concat(F.lit("app/"), F.regexp_replace("path", "[^/]+$", "page.tsx")))
    known = c.where("change_type = 'added'").groupBy("path").agg(F.min("ord").alias("o")).where("o % 3 = 0")
    return r.added_entry_points(c, known)


@R.add("rule_stop_decisions", "select user_id as session, case when user_id % 4 = 0 then 'allow' when user_id % 4 = 1 then 'unknown' when user_id % 7 < 3 then 'block' else 'give-up' end as decision from (select distinct user_id from events)")
def stops(spark, sf):
    s = table(spark, sf, "events").select("user_id").distinct()
    return r.stop_decision(s.select(F.col("user_id").alias("session"), F.expr("case user_id % 4 when 0 then 'passed' when 1 then case when user_id % 2 = 1 then null else 'blocked' end else 'failed' end").alias("verification"), F.expr("user_id % 7").alias("attempts")))


_CMDS = [("vitest run", True), ("npm run build && npx jest --ci", True), ("node --test src", True), ("echo contest", False), ("pnpm test", True), ("cargo test -p x", True), ("eslint .", False), ("mvn -q test", True)]


@R.add("rule_test_commands", "select n_nationkey as id, cmd, want as runs_tests from nation, (select " + f"unnest({[c for c, _ in _CMDS]}) as cmd, unnest([{', '.join(str(w).lower() for _, w in _CMDS)}]) as want)")
def commands(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.explode(F.array(*(F.lit(c) for c, _ in _CMDS))).alias("cmd")).withColumn("runs_tests", r.is_test_command("cmd"))


@R.add("rule_frameworks", "select distinct l_orderkey % 500 as project, case l_partkey % 9 when 0 then 'vitest' when 1 then 'jest' when 2 then 'jest' when 3 then 'playwright' end as framework from lineitem where l_partkey % 9 < 4")
def frameworks(spark, sf):
    d = table(spark, sf, "lineitem").select(F.expr("l_orderkey % 500").alias("project"), F.expr("case l_partkey % 9 when 0 then 'vitest' when 1 then 'jest' when 2 then 'ts-jest' when 3 then '@playwright/test' else 'left-pad' end").alias("name"))
    return r.declared_frameworks(d)


@R.add("rule_dependency_basis", "select o_custkey as repository, case when bool_or(o_orderstatus = 'F') then 'pinned' when bool_or(o_orderstatus = 'P') then 'time-boxed' else 'unresolved' end as basis from orders where o_orderkey % 7 = 0 group by 1")
def basis(spark, sf):
    return r.dependency_basis(table(spark, sf, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("repository"), F.expr("case o_orderstatus when 'F' then 'lockfile' when 'P' then 'date' else 'none' end").alias("fact")))


@R.add("rule_global_risk", f"{_C} select 'database' as signal, path from file_change where path like '%.sql' and ord % 11 <> 0")
def risk(spark, sf):
    c = load(spark, sf, "file_change")
    from ripplet.operators.delta import signal

    return r.global_risk(c.select(signal("path").alias("signal"), "path").where("signal is not null"), c.where("ord % 11 = 0"))


QUERIES, ORACLES = R.queries, R.oracles
