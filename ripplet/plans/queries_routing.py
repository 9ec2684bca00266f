"""Queries over import extraction, routes of changed paths and the rules beside them."""

from pyspark.sql import functions as F

from ripplet.operators import graph as g
from ripplet.operators import routing as r
from ripplet.plans.registry import Registry
from ripplet.relations import load, sql, table
from ripplet.runtime import store, tasks
from ripplet.sources import imports as im

R = Registry()
_F, _C = sql("file"), sql("file_change")

# every part is a module in one of seven directories; its text is written here, and what it loads is said again by the SQL
_ALIASES = [("@lib/*", "src/d1/*")]


def _sources(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 7).cast("string").alias("d")).repartition(tasks(spark), "k")  # the table is small beside the texts made of it
    k = lambda n=0: (F.col("k") + n).cast("string")
    lit = F.lit
    text = F.concat(
        lit("/* import z from './f0' */ // require('./f1')\nimport a, { b as c, type D } from './f"), k(1), lit("';\nexport * from \"../d"), (F.col("k") * 3 % 7).cast("string"), lit("/f"), k(2), lit(".js\"\n"),
        lit("import type { T } from '@lib/f"), k(3), lit("';\nconst x = require('pkg"), (F.col("k") % 5).cast("string"), lit("/sub');\n"),
        F.when(F.col("k") % 11 == 0, lit("await import(`./f${n}1`);\n")).otherwise(lit("")), F.when(F.col("k") % 13 == 0, lit("require(name);\n")).otherwise(lit("")), lit("import 'node:fs'; jest.mock('./f"), k(4), lit("')\n"),
    )
    return p.select("k", F.concat(lit("src/d"), "d", lit("/f"), k(), lit(".ts")).alias("path"), text.alias("content"))


def _packages(spark, sf):
    return spark.createDataFrame([("pkg1", "./sub", "src/d1/f1.ts"), ("pkg2", "./sub", "src/none.ts")], "name string, subpath string, target string")


_SRC = """src as (select p_partkey as k, p_size % 7 as d, concat('src/d', cast(p_size % 7 as varchar), '/f', cast(p_partkey as varchar), '.ts') as path from part),
ref as (select path, 0 as ord, 'import' as kind, concat('./f', cast(k + 1 as varchar)) as specifier, 'default,b' as names, concat('src/d', cast(d as varchar), '/f', cast(k + 1 as varchar), '.ts') as t from src
  union all select path, 1, 're-export', concat('../d', cast(k * 3 % 7 as varchar), '/f', cast(k + 2 as varchar), '.js'), '*', concat('src/d', cast(k * 3 % 7 as varchar), '/f', cast(k + 2 as varchar), '.ts') from src
  union all select path, 2, 'type-import', concat('@lib/f', cast(k + 3 as varchar)), 'T', concat('src/d1/f', cast(k + 3 as varchar), '.ts') from src
  union all select path, 3, 'require', concat('pkg', cast(k % 5 as varchar), '/sub'), null, case k % 5 when 1 then 'src/d1/f1.ts' end from src
  union all select path, 4 + cast(k % 11 = 0 as integer) + cast(k % 13 = 0 as integer), 'import', 'node:fs', null, null from src
  union all select path, 5 + cast(k % 11 = 0 as integer) + cast(k % 13 = 0 as integer), 'mock', concat('./f', cast(k + 4 as varchar)), null, concat('src/d', cast(d as varchar), '/f', cast(k + 4 as varchar), '.ts') from src),
comp as (select path, 4 as ord, 'dynamic-import' as kind, true as pattern, d from src where k % 11 = 0 union all select path, 4 + cast(k % 11 = 0 as integer), 'require', false, d from src where k % 13 = 0),
res as (select ref.*, src.path as resolved, case when src.path is not null then 'internal' when specifier = 'node:fs' then 'builtin' when specifier like 'pkg2%' then 'unresolved' when specifier like 'pkg%' and t is null then 'external-package' else 'unresolved' end as resolution
  from ref left join src on src.path = t),
expanded as (select c.path, c.ord, s.path as target from comp c join src s on pattern and s.d = c.d and s.path like '%1.ts' and s.path <> c.path)"""


def _references(spark, sf):
    src = _sources(spark, sf)
    return src, store(im.extract_imports(src.select("path", "content")), "imports")  # texts are read once for all that follows


def _resolved(spark, src, refs, sf):
    return im.resolve_imports(refs, src, _ALIASES, _packages(spark, sf), ("fs",))


def _expanded(src, refs):
    return im.expansion(refs, src.select("path", F.lit(True).alias("usable")))


@R.add("import_references", f"with {_SRC} select path as importer, ord, kind, specifier, coalesce(names, '') as names, false as computed from ref union all select path, ord, kind, case when pattern then '`./f${{n}}1`' else 'name' end, '', true from comp")
def references(spark, sf):
    return _references(spark, sf)[1].select("importer", "ord", "kind", "specifier", F.coalesce(F.array_join("names", ","), F.lit("")).alias("names"), "computed")


@R.add("import_resolutions", f"with {_SRC} select path as importer, ord, specifier, resolved, resolution from res")
def resolutions(spark, sf):
    return _resolved(spark, *_references(spark, sf), sf).select("importer", "ord", "specifier", "resolved", "resolution")


@R.add("import_computed", f"with {_SRC} select path as importer, ord, target from expanded")
def computed(spark, sf):
    return _expanded(*_references(spark, sf)).rows()


@R.add("import_edges", f"with {_SRC} select distinct path as src, resolved as dst, kind from res where resolved is not null and resolved <> path union select path, target, 'dynamic-import' from expanded")
def edges(spark, sf):
    src, refs = _references(spark, sf)
    return im.import_edges(_resolved(spark, src, refs, sf), _expanded(src, refs))


@R.add("import_resolution_counts", f"with {_SRC} select resolution, count(*) as n from (select resolution from res union all select case when exists (select 1 from expanded e where e.path = c.path and e.ord = c.ord) then 'expanded' else 'computed' end from comp c) group by resolution")
def counts(spark, sf):
    src, refs = _references(spark, sf)
    return im.resolution_counts(refs, _resolved(spark, src, refs, sf), _expanded(src, refs).loads)


_CATEGORY = "case p_partkey % 9 when 0 then 'docs' when 1 then 'test' when 2 then 'config' when 3 then 'unknown' when 4 then 'test-fixture' when 5 then 'infrastructure' when 6 then 'database' else 'source' end"
_ROUTE = """x as (select concat('a/', case when p_partkey % 17 = 0 then 'package.json' else concat('f', cast(p_partkey as varchar(20)), case when p_partkey % 4 = 0 then '.svg' when p_partkey % 41 = 1 then '.eslintrc' else '.ts' end) end) as path, p_partkey as k, CAT as category,
  case p_partkey % 4 when 0 then 'added' when 1 then 'modified' when 2 then 'renamed' else 'deleted' end as change_type, p_size % 5 = 0 as is_old, p_size % 3 = 0 as in_graph, p_partkey % 4 = 0 and p_partkey % 17 <> 0 as is_asset, p_partkey % 101 = 7 as is_lockfile, false as any_lockfile,
  p_size % 2 = 0 as fixture, p_partkey % 103 = 5 as testdata, p_partkey % 107 = 5 as embedded, p_partkey % 109 = 5 as rust_asset, p_partkey % 113 = 5 as rust_source, p_size % 7 = 0 as cleared, p_size % 11 = 0 as worker_outside, p_size % 13 = 0 as infra_code from part)""".replace("CAT", _CATEGORY)


@R.add(
    "route_paths",
    f"""with {_ROUTE}, y as (select *, change_type = 'deleted' or (is_old and change_type = 'renamed') as gone, is_asset and not in_graph as unseen from x)
    select path, k, case when rust_asset then 'asset' when rust_source then 'source' when embedded then 'asset' when testdata then 'testdata' when is_lockfile then 'readers-lockfile'
      when path like '%/package.json' and not cleared and change_type <> 'added' then 'full-manifest' when category = 'test-fixture' and fixture then 'fixture'
      when category in ('unknown', 'test-fixture') then 'readers' when category = 'docs' then 'none' when unseen and not gone then case when fixture then 'fixture' else 'readers' end
      when unseen and gone then 'removed' when is_asset then 'asset' when category = 'infrastructure' and worker_outside then 'readers' when category in ('config', 'infrastructure', 'database') then 'full-global'
      when infra_code and not in_graph and change_type <> 'deleted' then 'readers-infrastructure' when category = 'test' then 'test' when change_type = 'deleted' and not in_graph then 'removed' else 'source, orphan?' end as route from y""",
)
def route_paths(spark, sf):
    text = _ROUTE.partition("(")[2][:-1].replace(" from part", " from {part}")
    return r.route(spark.sql(text, part=table(spark, sf, "part"))).select("path", "k", "route")


_SIG = "sig as (select case p_partkey % 6 when 0 then 'config' when 1 then 'dependencyManifest' when 2 then 'lockfile' when 3 then 'workflow' when 4 then 'infrastructure' else 'database' end as signal, concat('d', cast(p_partkey % 97 as varchar(20)), '/', case when p_partkey % 60 = 0 then 'jest.config.js' when p_partkey % 30 = 4 then 'wrangler.toml' else cast(p_size as varchar(20)) end) as path, p_size from part)"


@R.add(
    "route_risks",
    f"""with {_SIG}, kept as (select distinct signal, path from sig where not (signal = 'infrastructure' and path like '%wrangler.toml') and not (signal in ('infrastructure', 'database') and path in (select path from sig where p_size = 9))),
    n as (select *, case signal when 'config' then 'CONFIG_GLOBAL' when 'dependencyManifest' then 'DEPENDENCY_MANIFEST' when 'lockfile' then 'LOCKFILE_GLOBAL' when 'workflow' then 'WORKFLOW_GLOBAL' when 'infrastructure' then 'INFRASTRUCTURE_GLOBAL' else 'DATABASE_GLOBAL' end as reason, case when signal = 'config' and path like '%jest.config.js' then 'test' end as subject from kept),
    g as (select reason, subject, list_sort(list(path)) as ps from n group by reason, subject, case when subject is not null then path end)
    select reason, coalesce(subject, '') as subject, array_to_string(ps[1:5], ',') as paths, greatest(len(ps) - 5, 0) as more from g""",
)
def risks(spark, sf):
    s = spark.sql(_SIG.partition("(")[2][:-1].replace(" from part", " from {part}"), part=table(spark, sf, "part"))
    out = r.risk_fallbacks(s.select("signal", "path"), s.where("p_size = 9").select("path"), workers_outside=True)
    return out.select("reason", F.coalesce("subject", F.lit("")).alias("subject"), F.array_join("paths", ",").alias("paths"), "more")


@R.add(
    "route_removed",
    f"""{_F}, gone as (select replace(path, '.ts', '.js') as path, ord, regexp_extract(path, '([^/]*)\\.ts$', 1) as stem from file where ends_with(path, '.ts') and not ends_with(path, '.test.ts')),
    said as (select distinct concat('f', cast(l_partkey as varchar)) as name from lineitem where l_quantity = 50 and l_linenumber > 1)
    select g.path, case when stem in (select name from said) then 'blocked' else 'resolved' end as outcome, case when stem in (select name from said) then null else f.path end as sibling from gone g join file f on f.ord = g.ord""",
)
def removed(spark, sf):
    f = load(spark, sf, "file")
    gone = f.where("path like '%.ts' and path not like '%.test.ts'").select(F.regexp_replace("path", r"\.ts$", ".js").alias("path"))
    said = table(spark, sf, "lineitem").where("l_quantity = 50").select(F.expr("concat('../x/f', cast(l_partkey as string), '?raw')").alias("specifier"), F.expr("l_linenumber = 1").alias("computed"))
    return r.removed_files(gone, f, said, f)


@R.add("route_orphans", f"""{_C}, dep as (select distinct f.path from lineitem join file_change f on f.ord = l_partkey where l_quantity = 3), x as (select distinct case when ord % 2 = 0 then path else replace(path, '/f', '/setup.f') end as path, ord, change_type from file_change)
  select distinct path from x where change_type <> 'deleted' and regexp_matches(path, '\\.[jt]sx?$') and contains(path, '/setup.') and not ends_with(path, '.test.ts') and ord % 3 <> 0 and path not in (select path from dep)""")
def orphans(spark, sf):
    c = load(spark, sf, "file_change")
    dep = table(spark, sf, "lineitem").where("l_quantity = 3").join(c, F.col("l_partkey") == F.col("ord")).select(F.col("path").alias("dst"))
    x = c.select(F.when(F.col("ord") % 2 == 0, F.col("path")).otherwise(F.regexp_replace("path", "/f", "/setup.f")).alias("path"), "ord", "change_type")
    return r.tool_loaded_orphans(x, dep, x.where("path like '%.test.ts'"), x.where("ord % 3 = 0"))


@R.add("route_always_run", f"{_F} select path as test from file where ends_with(path, '.test.ts') and (starts_with(path, 'small/') or ord % 20 = 1) union select path from file where ord % 50 = 10")
def always(spark, sf):
    f = load(spark, sf, "file")
    t = f.where("path like '%.test.ts'").select(F.col("path").alias("test"), "ord")
    return r.always_run(t, ["small/**/*.test.ts"], t.where("ord % 20 = 1").unionByName(f.where("ord % 50 = 10").select(F.col("path").alias("test"), "ord")))


_TESTS = "t as (select distinct l_suppkey as path, l_partkey as test, l_partkey % 5 <> 0 as by_name from lineitem), reach as (select distinct l_partkey as test, l_suppkey as path from lineitem where l_quantity < 9 and l_suppkey % 3 <> 0)"


@R.add("route_export_filter", f"""with {_TESTS}, n as (select t.path, t.test, reach.test is not null as hit from t left join reach on reach.test = t.test and reach.path = t.path where by_name), g as (select path, bool_or(hit) as reached, min(test) as least from n group by path)
  select path, test from t where not by_name union all select n.path, n.test from n join g on g.path = n.path where hit or (not reached and n.test = least)""")
def export_filter(spark, sf):
    li = table(spark, sf, "lineitem")
    return r.export_filter(li.select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("test"), F.expr("l_partkey % 5 <> 0").alias("by_name")).distinct(), li.where("l_quantity < 9 and l_suppkey % 3 <> 0").select(F.col("l_partkey").alias("test"), F.col("l_suppkey").alias("path")))


@R.add("route_computed_runners", f"""with {_TESTS}, i as (select s_suppkey as importer, s_suppkey % 2 = 0 as by_name from supplier), dep as (select distinct l_suppkey as importer, l_partkey as node from lineitem), tests as (select p_partkey as test from part where p_size % 3 = 0)
  select importer, importer as test from i where importer in (select test from tests) union select i.importer, node from i join dep on dep.importer = i.importer where node in (select test from tests) and (not by_name or exists (select 1 from reach where reach.test = node and reach.path = i.importer))""")
def runners(spark, sf):
    li = table(spark, sf, "lineitem")
    reach = li.where("l_quantity < 9 and l_suppkey % 3 <> 0").select(F.col("l_partkey").alias("test"), F.col("l_suppkey").alias("path"))
    tests = table(spark, sf, "part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("test"))
    return r.computed_load_runners(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("importer"), F.expr("s_suppkey % 2 = 0").alias("by_name")), li.select(F.col("l_suppkey").alias("importer"), F.col("l_partkey").alias("node")).distinct(), tests, reach)


@R.add("route_entry_points", """with e as (select concat('app/', case user_id % 4 when 0 then 'page.tsx' when 1 then concat('api/', cast(user_id as varchar), '/api.ts') when 2 then 'x.ts' else concat(cast(user_id as varchar), '/not-found.js') end) as path, event_type as reason, event_id as ord, user_id from events),
  f as (select path, reason, min(ord) as ord from e group by 1, 2) select path, case when path = 'app/x.ts' then 'script' when path like '%page.tsx' then 'next-page' when path like '%api.ts' then 'next-api' else 'next-error' end as kind, string_agg(reason, ',' order by ord) as reasons from f group by path""")
def entries(spark, sf):
    e = table(spark, sf, "events")
    name = F.expr("concat('app/', case user_id % 4 when 0 then 'page.tsx' when 1 then concat('api/', cast(user_id as string), '/api.ts') when 2 then 'x.ts' else concat(cast(user_id as string), '/not-found.js') end)")
    out = r.entry_points(e.select(name.alias("path"), F.col("event_type").alias("reason"), F.col("event_id").alias("ord")), spark.createDataFrame([("app/x.ts", "script")], "path string, kind string"), True)
    return out.select("path", "kind", F.array_join("reasons", ",").alias("reasons"))


@R.add("route_undeclared", "select distinct case when p_partkey % 2 = 0 then concat('@', lower(p_type), '/', replace(p_name, ' ', '-')) else replace(p_name, ' ', '-') end as package from part where p_partkey % 3 <> 0 except select replace(p_name, ' ', '-') from part where p_size < 20")
def undeclared(spark, sf):
    p = table(spark, sf, "part")
    name = F.expr("replace(p_name, ' ', '-')")
    refs = p.select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("@"), F.lower("p_type"), F.lit("/"), name)).otherwise(name).alias("s"), F.when(F.col("p_partkey") % 3 == 0, "internal").otherwise("external-package").alias("resolution"))
    return r.undeclared_packages(refs.select(F.concat("s", F.lit("/sub/x")).alias("specifier"), "resolution"), p.where("p_size < 20").select(name.alias("name")))


@R.add("route_window_start", "with r as (select row_number() over (order by ts desc, event_id desc) as ord, case when event_type = 'error' then 'detector' when event_type = 'view' then 'full' else 'other' end as kind, event_id, value > 50 as good from events) select concat('s', cast(event_id as varchar)) as head_sha, case kind when 'detector' then 'detector-record' else 'green-full-run' end as source from r where good and kind <> 'other' order by case kind when 'detector' then 0 else 1 end, ord limit 1")
def window_start(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "detector").when(F.col("event_type") == "view", "full").otherwise("other")
    good = F.col("value") > 50
    return r.window_start(e.select(F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), (-F.col("event_id")).alias("e")).alias("ord"), kind.alias("kind"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("head_sha"), F.lit(True).alias("ancestor"), good.alias("recorded"), good.alias("passed")))


@R.add("route_newest_receipts", "select user_id as number, arg_max(concat('r', cast(event_id as varchar)), event_id) as artifact from events where value > 30 group by user_id")
def receipts(spark, sf):
    return r.newest_receipts(table(spark, sf, "events").select(F.col("user_id").alias("number"), (-F.col("event_id")).alias("ord"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("artifact"), F.expr("value > 30").alias("valid")))


@R.add("route_baseline", f"""{_C}, c as (select ord % 40 as change, path from file_change) select change, case when bool_or(regexp_matches(path, '^(database|ops|docker|jest\\.config)')) then 'all' when bool_and(path like '%.md') then 'none' else 'rules' end as decision from c group by change""")
def baseline(spark, sf):
    return r.baseline_decision(load(spark, sf, "file_change").select(F.expr("ord % 40").alias("change"), "path"))


@R.add(
    "route_path_kinds",
    """with n as (select p_partkey as k, case p_partkey % 16 when 0 then '.github/workflows/a.yml' when 1 then 'ci/test.gitlab-ci.yml' when 2 then '.gitlab/x.txt' when 3 then 'Jenkinsfile' when 4 then 'pkg/jest.config.ts' when 5 then 'jest.config.ts' when 6 then 'a/node_modules/b/babel.config.js'
      when 7 then 'app/page.tsx' when 8 then 'app/page.css' when 9 then 'venv/x.py' when 10 then 'src/test_x.py' when 11 then 'tests/unit/test_y.py' when 12 then 'Docs/readme.txt' when 13 then 'x/y.MDX' when 14 then 'yarn.lock' else 'src/ops.ts' end as p from part)
    select k, p as path, k % 16 in (0, 1, 3) as ci, k % 16 = 4 as nested, case k % 16 when 7 then 'next-page' end as entry, k % 16 in (10, 11) as python, k % 16 = 11 as pytest, k % 16 in (12, 13) as documentation, k % 16 in (0, 5, 14) as everything from n""",
)
def kinds(spark, sf):
    names = [".github/workflows/a.yml", "ci/test.gitlab-ci.yml", ".gitlab/x.txt", "Jenkinsfile", "pkg/jest.config.ts", "jest.config.ts", "a/node_modules/b/babel.config.js", "app/page.tsx", "app/page.css", "venv/x.py", "src/test_x.py", "tests/unit/test_y.py", "Docs/readme.txt", "x/y.MDX", "yarn.lock", "src/ops.ts"]
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.get(F.array(*map(F.lit, names)), F.expr("cast(p_partkey % 16 as int)")).alias("path"))
    return p.select("k", "path", r.ci_config("path").alias("ci"), r.nested_test_config("path").alias("nested"), r.next_entry_kind("path", F.lit(True)).alias("entry"), r.python_source("path").alias("python"), r.pytest_file("path", ["test_*.py"], ["tests/**"]).alias("pytest"), r.documentation_path("path").alias("documentation"), r.forces_everything("path").alias("everything"))


@R.add("route_layout", f"{_F} select distinct path, path like '%.md' as is_documentation, starts_with(path, 'small/') or starts_with(path, 'large/hot/') as is_script from file")
def layout(spark, sf):
    return r.layout(load(spark, sf, "file"), spark.createDataFrame([("scripts", "small"), ("operations", "large/hot"), ("source", "economy")], "kind string, path string"))


@R.add("route_values", """select o_orderkey as k, o_orderkey % 7 between 1 and o_custkey % 9 as is_shard, case when o_orderkey % 2 = 0 then concat('a/f', cast(o_orderkey as varchar), '.ts') else concat('/other/f', cast(o_orderkey as varchar), '.ts') end as legacy, o_orderkey % 3 <> 0 as same,
  concat(case when o_totalprice <= 1000 then 'price,' else '' end, case when o_orderstatus <> 'F' then 'status,' else '' end) as problems, greatest(o_orderkey % 9 - 3, 0) as more from orders""")
def values(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "k")
    return o.select(
        "k", r.shard_spec(F.concat(F.lit(" "), (F.col("k") % 7).cast("string"), F.lit("/"), (F.col("o_custkey") % 9).cast("string"))).isNotNull().alias("is_shard"),
        r.legacy_test_path(F.concat(F.when(F.col("k") % 2 == 0, F.lit("/repo/a/./f")).otherwise(F.lit("/other/f")), F.col("k").cast("string"), F.lit(".ts")), "/repo").alias("legacy"),
        r.same_json(F.expr("concat('{ \"a b\" : ', cast(k as string), ' }')"), F.expr("concat('{\"a b\":', cast(k + case when k % 3 = 0 then 1 else 0 end as string), '}')")).alias("same"),
        F.array_join(F.transform(r.problems({"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus") == "F"}), lambda x: F.concat(x, F.lit(","))), "").alias("problems"),
        r.bounded(F.expr("slice(sequence(1, 9), 1, cast(k % 9 as int))"), 3)["more"].cast("long").alias("more"),
    )


@R.add("route_junit_files", """select event_id as k, case when user_id % 6 in (0, 2) then concat('pkg/t', cast(user_id as varchar), '.test.ts') when user_id % 6 = 4 then concat('in/t', cast(user_id as varchar), '.js') end as path,
  case user_id % 6 when 1 then 'suite-level' when 3 then 'no file named' when 5 then case when event_id % 2 = 0 then 'several files' else 'invalid or outside' end end as reason from events""")
def junit_files(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("k"), (F.col("user_id") % 6).alias("c"), F.col("user_id").cast("string").alias("u"))
    name = F.concat(F.lit("t"), "u", F.lit(".test.ts"))
    file = F.when(F.col("c") == 0, name).when(F.col("c") == 2, F.concat(F.lit(r"C:\repo\pkg" + "\\"), name)).when((F.col("c") == 5) & (F.col("k") % 2 == 1), F.lit("../x.test.ts"))
    cases = e.select("k", file.alias("file"), F.when(F.col("c") == 4, F.concat(F.lit("./../in/t"), "u", F.lit(".js"))).alias("skip"), F.when(F.col("c") == 4, F.concat(F.lit("C:/repo/in/t"), "u", F.lit(".js"))).otherwise("Some class").alias("classname"), F.when((F.col("c") == 5) & (F.col("k") % 2 == 0), F.array(F.lit("a.ts"), F.lit("b.ts"))).alias("suite_files"), F.array(F.lit("suite")).alias("suite_names"), (F.col("c") == 1).alias("suite_level"))
    return r.attribute_cases(cases, "C:/repo", "pkg").select("k", "path", "reason")


_READ = "refs as (select distinct concat('f', cast(l_partkey as varchar)) as reader, concat('f', cast(l_suppkey as varchar)) as target from lineitem where l_quantity <= 2 and l_partkey <> l_suppkey), roots as (select concat('f', cast(s_suppkey as varchar)) as path from supplier)"


@R.add(
    "reader_chain",
    f"""with recursive {_READ}, walk(root, node, depth) as (select path, path, 0 from roots union select w.root, r.reader, w.depth + 1 from walk w join refs r on r.target = w.node where w.depth < 5 and r.reader <> w.root),
    best as (select root, node, min(depth) as depth from walk group by root, node), lv as (select *, (cast(substr(node, 2) as bigint) % 29 = 5) as stop from best where depth > 0),
    state as (select root, depth, bool_or(stop) as stopped, sum(count(*)) over (partition by root order by depth) as total from lv group by root, depth),
    fin as (select root, min(depth) as depth from state where stopped or total > 12 group by root)
    select lv.root, lv.node, lv.depth, '' as why from lv where root not in (select root from fin) union all select f.root, null, f.depth, case when s.stopped then 'blocked' else 'too many' end from fin f join state s on s.root = f.root and s.depth = f.depth""",
)
def chain(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity <= 2 and l_partkey <> l_suppkey")
    refs = li.select(F.expr("concat('f', cast(l_partkey as string))").alias("reader"), F.expr("concat('f', cast(l_suppkey as string))").alias("target"))
    roots = table(spark, sf, "supplier").select(F.expr("concat('f', cast(s_suppkey as string))").alias("path"))
    stops = table(spark, sf, "part").where("p_partkey % 29 = 5").select(F.expr("concat('f', cast(p_partkey as string))").alias("path"))
    out = r.reader_chain(refs, roots, stops, most=12)
    return out.select("root", "node", "depth", F.when(F.col("node").isNull(), F.col("via")).otherwise("").alias("why"))


@R.add("route_test_universe", f"{_F} select path as test from file where ends_with(path, '.test.ts') union select path from file where ends_with(path, '_test.go')")
def universe(spark, sf):
    f = load(spark, sf, "file").withColumnRenamed("path", "test")
    return r.test_universe(f.where("test like '%.test.ts'"), f.where("test like '%\\_test.go'"))


@R.add("route_compiled_projects", """with roots as (select distinct l_suppkey as config, l_partkey as path from lineitem where l_quantity = 1), named as (select distinct l_orderkey as test, l_suppkey as config from lineitem where l_quantity = 50), reach as (select distinct l_partkey as node, l_orderkey as dependency from lineitem where l_quantity = 2),
  fs as (select config, path from roots union select config, dependency from roots join reach on node = path union select s_suppkey, s_suppkey from supplier) select fs.config, test, path from fs join named on named.config = fs.config where fs.config in (select s_suppkey from supplier)""")
def compiled(spark, sf):
    li = table(spark, sf, "lineitem")
    pick = lambda q, a, b: li.where(f"l_quantity = {q}").select(*(F.col(c).alias(n) for n, c in (a, b))).distinct()
    return r.compiled_projects(pick(1, ("config", "l_suppkey"), ("path", "l_partkey")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("config")), pick(50, ("test", "l_orderkey"), ("config", "l_suppkey")), pick(2, ("node", "l_partkey"), ("dependency", "l_orderkey")))


@R.add("route_included_configs", "with recursive inc as (select distinct concat('c', cast(p_size as varchar)) as path, concat('c', cast((p_size * 3 + p_partkey % 3) % 50 as varchar)) as target from part), w(path, depth) as (select 'c1', 0 union select target, depth + 1 from w join inc using (path) where depth < 9) select path, min(depth) as depth from w where path <> 'c1' group by path")
def included(spark, sf):
    inc = table(spark, sf, "part").select(F.expr("concat('c', cast(p_size as string))").alias("path"), F.expr("concat('c', cast((p_size * 3 + p_partkey % 3) % 50 as string))").alias("target"))
    return r.included_configs(inc, "c1")


# parts are modules, line items what they own, pass on and load
_MOD = """mods as (select p_partkey as path, p_size % 4 <> 0 as plain from part where p_partkey % 29 <> 3), pl as (select path from mods where plain), li as (select l_partkey as path, l_suppkey as target, concat('n', cast(l_linenumber % 3 as varchar(20))) as name, concat('n', cast((l_linenumber + l_suppkey) % 3 as varchar(20))) as other, l_quantity as q from lineitem where l_partkey <> l_suppkey),
own as (select distinct path, name from li where q <= 6), fwd as (select distinct path, name, target, case when q = 8 then '*' else other end as imported from li where q in (7, 8)), star as (select distinct path, target from li where q in (9, 10)),
imp as (select distinct path, target, case when q = 11 then '*' else name end as name from li where q between 11 and 14), run as (select distinct path, target from li where q between 7 and 16)"""


@R.add(
    "graph_module_reach",
    f"""with recursive {_MOD}, names as (select unnest(['n0', 'n1', 'n2']) as name),
    body as (select distinct r.path, r.target, case when not exists (select 1 from pl where pl.path = r.target) or exists (select 1 from imp i where i.path = r.path and i.target = r.target and i.name = '*') then '*' else i.name end as name from run r left join imp i on i.path = r.path and i.target = r.target
      where i.name is not null or not exists (select 1 from pl where pl.path = r.target) or not exists (select 1 from fwd f where f.path = r.path and f.target = r.target union all select 1 from star s where s.path = r.path and s.target = r.target)),
    load as (select path, target, coalesce(name, '*') as name from body), whole as (select * from load union select path, target, '*' from fwd union select path, target, '*' from star),
    def(root, path) as (select distinct target, target from star union select d.root, s.target from def d join star s on s.path = d.path where s.path in (select path from pl)),
    can as (select distinct d.root as path, n.name from def d, names n where d.path not in (select path from pl) or exists (select 1 from own o where o.path = d.path and o.name = n.name) or exists (select 1 from fwd f where f.path = d.path and f.name = n.name)),
    pn as (select pl.path, n.name, case when exists (select 1 from own o where o.path = pl.path and o.name = n.name) then 1 when exists (select 1 from fwd f where f.path = pl.path and f.name = n.name) then 2 when exists (select 1 from star s join can c on c.path = s.target and c.name = n.name where s.path = pl.path) then 3 else 4 end as kind from pl, names n),
    step as (select pn.path, pn.name, l.target, l.name as taken from pn join load l on l.path = pn.path where kind = 1 union all select pn.path, pn.name, f.target, f.imported from pn join fwd f on f.path = pn.path and f.name = pn.name where kind = 2
      union all select pn.path, pn.name, s.target, pn.name from pn join star s on s.path = pn.path join can c on c.path = s.target and c.name = pn.name where kind = 3 union all select pn.path, pn.name, w.target, w.name from pn join whole w on w.path = pn.path where kind = 4
      union all select w.path, n.name, w.target, w.name from whole w, names n where w.path not in (select path from pl) union all select path, '*', target, name from whole),
    reach(root, path, name) as (select p_partkey, p_partkey, '*' from part where p_partkey % 5 = 0 union select r.root, s.target, s.taken from reach r join step s on s.path = r.path and s.name = r.name)
    select root, path, name from reach""",
)
def module_reach(spark, sf):
    part, li = table(spark, sf, "part"), table(spark, sf, "lineitem").where("l_partkey <> l_suppkey")
    li = li.select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("target"), F.expr("concat('n', cast(l_linenumber % 3 as string))").alias("name"), F.expr("concat('n', cast((l_linenumber + l_suppkey) % 3 as string))").alias("other"), F.col("l_quantity").alias("q"))
    modules = part.where("p_partkey % 29 <> 3").select(F.col("p_partkey").alias("path"), F.expr("p_size % 4 <> 0").alias("plain"))
    fwd = li.where("q in (7, 8)").select("path", "name", "target", F.expr("case when q = 8 then '*' else other end").alias("imported"))
    star = li.where("q in (9, 10)").select("path", "target")
    imports = li.where("q between 11 and 14").select("path", "target", F.expr("case when q = 11 then '*' else name end").alias("name"))
    body = g.body_edges(li.where("q between 7 and 16"), imports, modules, fwd, star)
    return g.module_reach(modules, li.where("q <= 6").select("path", "name"), fwd, star, body, part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("path")))


QUERIES, ORACLES = R.queries, R.oracles
