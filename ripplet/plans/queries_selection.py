"""Queries over change sets and the joins that map paths to tests, files and tasks."""

from pyspark.sql import functions as F

from ripplet.functions import paths as p
from ripplet.operators import delta as d
from ripplet.operators import selection as s
from ripplet.plans.registry import Registry
from ripplet.relations import load, sql, table

R = Registry()
_C, _F = sql("file_change"), sql("file")
_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_EXT = "lower(regexp_extract(path, '(\\.[^./]+)$', 1))"
_DIR = "regexp_extract(path, '^(?:(.*)/)?[^/]*$', 1)"
_TEST = r"regexp_matches(path, '[.](spec|test)[.][cm]?[jt]sx?$|_test[.](go|py)$|(^|/)test_[^/]*[.]py$|(^|/)__tests__/')"


@R.add("delta_summary", f"""{_C} select count(*) as total, {", ".join(f"count(*) filter (where change_type = '{t}') as {t.replace('-', '_')}" for t in d.CHANGE_TYPES.values())} from file_change""")
def delta_summary(spark, sf):
    return d.summary(load(spark, sf, "file_change"))


@R.add(
    "delta_categories",
    f"""{_F} select path, case when {_EXT} = '.sql' then 'database' when {_EXT} in ('.ts', '.tsx', '.py', '.go') and {_TEST} then 'test' when {_EXT} in ('.ts', '.tsx', '.py', '.go') then 'source'
    when {_EXT} in ('.css', '.svg') then 'asset' when {_EXT} = '.md' then 'docs' else 'unknown' end as category, {_TEST} as is_test from file""",
)
def categories(spark, sf):
    return load(spark, sf, "file").select("path", d.category("path").alias("category"), d.is_test("path").alias("is_test"))


@R.add("delta_signals", f"{_C}, sides as (select path from file_change union all select old_path from file_change where old_path is not null) select 'database' as signal, count(distinct path) as n, min(path) as first from sides where {_EXT} = '.sql'")
def signals(spark, sf):
    x = d.signals(load(spark, sf, "file_change"))
    return x.select("signal", F.size("paths").cast("long").alias("n"), F.col("paths")[0].alias("first"))


@R.add("delta_reasons", f"{_C} select path, case change_type when 'deleted' then 'DIRECT_CHANGE,DELETED_FILE' when 'renamed' then 'DIRECT_CHANGE,RENAMED_FILE' else 'DIRECT_CHANGE' end as reasons from file_change")
def reasons(spark, sf):
    return load(spark, sf, "file_change").select("path", F.array_join(d.reasons("change_type"), ",").alias("reasons"))


@R.add("delta_paths", f"{_C} select ord, path from file_change union all select ord, old_path from file_change where old_path is not null")
def change_paths(spark, sf):
    return d.change_paths(load(spark, sf, "file_change"))


@R.add("delta_directories", f"{_C} select distinct {_DIR} as dir from file_change")
def directories(spark, sf):
    return d.directories(load(spark, sf, "file_change"))


@R.add(
    "delta_change_kinds",
    "select s as status, case substr(s, 1, 1) when 'A' then 'added' when 'C' then 'copied' when 'D' then 'deleted' when 'R' then 'renamed' when 'T' then 'type-changed' when 'U' then 'unmerged' else 'modified' end as kind, count(*) as n from (select concat(substr('ACDMRTUXB', 1 + cast(p_partkey % 9 as integer), 1), cast(p_size as varchar)) as s from part) group by s",
)
def kinds(spark, sf):
    x = table(spark, sf, "part").select(F.expr("concat(substr('ACDMRTUXB', 1 + cast(p_partkey % 9 as int), 1), cast(p_size as string))").alias("status"))
    return x.groupBy("status").agg(F.count("*").alias("n")).select("status", d.change_kind("status").alias("kind"), "n")


@R.add("path_functions", f"{_F} select path, {_BASE} as base, {_DIR} as dir, {_EXT} as ext, len(string_split(path, '/')) as depth, concat(substr(sha256(path), 1, 12), regexp_extract(path, '(\\.[^./]+)$', 1)) as redacted, regexp_replace(path, '\\.[^./]+$', '') as module from file")
def path_functions(spark, sf):
    f = load(spark, sf, "file")
    return f.select("path", p.basename("path").alias("base"), p.dirname("path").alias("dir"), p.extension("path").alias("ext"), F.size(p.ancestors("path")).cast("long").alias("depth"), p.redacted("path").alias("redacted"), p.module_key("path").alias("module"))


_LOCK = "side as (select concat('p', cast(l_partkey as varchar(20))) as key, max(l_suppkey) filter (where l_returnflag <> 'R') as was, max(l_suppkey) filter (where l_returnflag <> 'A') as now from lineitem group by 1)"


@R.add("delta_lock_keys", f"with {_LOCK} select key, case when was is null then 'added' when now is null then 'removed' else 'changed' end as change from side where was is distinct from now")
def lock_keys(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("key", F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    side = lambda flag: li.where(f"l_returnflag <> '{flag}'").groupBy("key").agg(F.max("l_suppkey").alias("fp"))
    return d.keyed_diff(side("R"), side("A"))


_ROOTS = "reach as (select distinct l_suppkey % 20 as root, l_partkey as key from lineitem where l_quantity < 4 and l_suppkey % 20 < 12)"


@R.add("delta_lock_roots", f"with {_ROOTS}, ch as (select distinct key from reach where key % 40 = 3), roots as (select distinct root from reach) select root, root in (select root from reach join ch using (key)) as affected from roots")
def lock_roots(spark, sf):
    reach = table(spark, sf, "lineitem").where("l_quantity < 4 and l_suppkey % 20 < 12").select(F.expr("l_suppkey % 20").alias("root"), F.col("l_partkey").alias("key")).distinct()
    return d.affected_roots(reach.select("root"), reach, reach.where("key % 40 = 3").select("key"))


@R.add("delta_lock_unattributed", "select cast(null as bigint) as root, false as affected")
def lock_unattributed(spark, sf):
    reach = table(spark, sf, "lineitem").where("l_quantity < 4").select(F.expr("l_suppkey % 20").alias("root"), F.col("l_partkey").alias("key")).distinct()
    return d.affected_roots(reach.select("root"), reach, spark.range(1).select(F.lit(-1).alias("key")))


@R.add(
    "delta_manifest_change",
    "select p_partkey as id, case p_partkey % 5 when 0 then 'none' when 1 then 'metadata' when 2 then 'dependencies' when 3 then 'scripts' else 'resolution' end as change from part",
)
def manifest(spark, sf):
    x = table(spark, sf, "part").select("p_partkey", F.expr("""concat('{"name":"a","version":"1","dependencies":{"x":"', p_size, '"},"scripts":{"t":"run"},"main":"m"}')""").alias("b"))
    a = F.expr("""case p_partkey % 5 when 0 then b when 1 then replace(b, '"version":"1"', '"version":"2"') when 2 then replace(b, '"x"', '"y"') when 3 then replace(replace(b, '"run"', '"go"'), '"x"', '"y"') else replace(b, ',"main":"m"', '') end""")
    return x.select(F.col("p_partkey").alias("id"), d.manifest_change("b", a).alias("change"))


@R.add("delta_word_edit", "select p_partkey as id, p_brand as added, case when p_name = p_type then '' else p_type end as removed from part")
def word_edit(spark, sf):
    x = table(spark, sf, "part").withColumn("e", d.word_edit(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws("  ", "p_name", "p_brand")))
    return x.select(F.col("p_partkey").alias("id"), F.array_join("e.added", ",").alias("added"), F.array_join("e.removed", ",").alias("removed"))


_OWN = f"owners as (select distinct split_part(path, '/', 1) as dir, split_part(path, '/', 1) as owner from file union select distinct concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)), concat('o-', split_part(path, '/', 2)) from file where ord % 9 = 0)"


@R.add("join_nearest_ancestor", f"{_F}, {_OWN} select path, arg_max(owner, len(dir)) as owner from file join owners on starts_with(path, dir || '/') group by path")
def nearest(spark, sf):
    f = load(spark, sf, "file")
    one = f.select(F.expr("split_part(path, '/', 1)").alias("dir")).distinct().withColumn("owner", F.col("dir"))
    two = f.where("ord % 9 = 0").select(F.expr("concat(split_part(path, '/', 1), '/', split_part(path, '/', 2))").alias("dir"), F.expr("concat('o-', split_part(path, '/', 2))").alias("owner")).distinct()
    return s.nearest_ancestor(f.select("path"), one.unionByName(two))


@R.add("join_unrouted", f"{_F} select path from file where not starts_with(path, 'small/') and not starts_with(path, 'large/red/')")
def unrouted(spark, sf):
    packages = spark.createDataFrame([("small", "s"), ("large/red", "lr"), ("small/red", "sr")], "root string, package string")
    return s.unrouted(load(spark, sf, "file"), packages)


_GLOBS = [("docs", "**/*.md"), ("unit", "{small,large}/**/*.test.ts"), ("styles", "**/red/**/*.{css,svg}"), ("go", "promo/*/*/f?[0-4]*_test.go"), ("all-small", "small/**")]
_TRIG = """case task when 'docs' then regexp_matches(path, '^(.*/)?[^/]*\\.md$') when 'unit' then regexp_matches(path, '^(small|large)/(.*/)?[^/]*\\.test\\.ts$') when 'styles' then regexp_matches(path, '^(.*/)?red/(.*/)?[^/]*\\.(css|svg)$')
  when 'go' then regexp_matches(path, '^promo/[^/]*/[^/]*/f[^/][0-4][^/]*_test\\.go$') else regexp_matches(path, '^small(/.*)?$') end"""


@R.add("join_task_triggers", f"{_C} select task, path from file_change, (select unnest(['docs', 'unit', 'styles', 'go', 'all-small']) as task) where {_TRIG}")
def triggers(spark, sf):
    return s.task_triggers(load(spark, sf, "file_change"), _GLOBS)


@R.add(
    "join_declared_tests",
    f"""{_C}, t as (select path as test from file where {_TEST}) select distinct path, test from file_change c, t where (path like '%.sql' and regexp_matches(test, '^promo/(.*/)?[^/]*\\.test\\.ts$')) or (starts_with(path, 'small/hot/') and regexp_matches(test, '^small/hot/[^/]*$'))""".replace(
        "with recursive", f"with recursive file as ({_F.split('file as (', 1)[1][:-1]}),"
    ),
)
def declared(spark, sf):
    tests = load(spark, sf, "file").where(d.is_test("path"))
    return s.declared_tests(load(spark, sf, "file_change"), tests, [("**/*.sql", "promo/**/*.test.ts"), ("small/hot/**", "small/hot/*")])


_COV = "cov as (select concat('t', cast(l_suppkey as varchar(20))) as test, f.path as p, false as is_dir from lineitem join file f on f.ord = l_partkey where l_quantity < 3 union select concat('t', cast(l_suppkey as varchar(20))), regexp_extract(f.path, '^(.*)/[^/]*$', 1), true from lineitem join file f on f.ord = l_partkey where l_quantity = 7 and l_suppkey % 9 = 0)"


@R.add(
    "join_coverage_additions",
    f"""{_F}, {_COV}, ch as (select ord, path from file where ord % 40 = 1) select test, arg_min(path, ord) as changed_file from cov join ch on (not is_dir and p = path) or (is_dir and starts_with(path, p || '/')) where test not in ('t3', 't9', 't18') group by test""",
)
def coverage(spark, sf):
    f = load(spark, sf, "file")
    li = table(spark, sf, "lineitem").join(f, F.col("l_partkey") == F.col("ord")).select(F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("test"), "l_quantity", "l_suppkey", "path")
    cov = li.where("l_quantity < 3").select("test", "path", F.lit(False).alias("is_dir")).unionByName(li.where("l_quantity = 7 and l_suppkey % 9 = 0").select("test", p.dirname("path").alias("path"), F.lit(True).alias("is_dir"))).distinct()
    return s.coverage_additions(cov, f.where("ord % 40 = 1"), spark.createDataFrame([("t3",), ("t9",), ("t18",)], "test string"))


@R.add("join_fixture_owners", f"""{_F}, t as (select path as test, {_DIR} as dir from file where {_TEST}), j as (select f.path, t.test, rank() over (partition by f.path order by len(t.dir) desc) as r from file f join t on starts_with(f.path, t.dir || '/') where f.path like '%.json') select path, test from j where r = 1""")
def fixtures(spark, sf):
    f = load(spark, sf, "file")
    return s.fixture_owners(f.where("path like '%.json'"), f.where(d.is_test("path")))


@R.add("join_under", f"{_F} select path, dir from file, (select unnest(['small', 'small/red', 'large/hot/ring']) as dir) where starts_with(path, dir || '/')")
def under(spark, sf):
    return s.under(load(spark, sf, "file"), spark.createDataFrame([("small",), ("small/red",), ("large/hot/ring",)], "dir string"))


@R.add("join_route_visits", "select test, entry from (select page_id as test, regexp_replace(regexp_replace(url, '^\\w+://[^/]*', ''), '[?#].*$', '') as u from pages), (select unnest(['lang', 'rest', 'maybe']) as entry) where case entry when 'lang' then regexp_matches(u, '^/[^/]+/[^/]+/?$') when 'rest' then regexp_matches(u, '^/de/.+/?$') else regexp_matches(u, '^/fr(/.*)?/?$') end")
def routes(spark, sf):
    visits = table(spark, sf, "pages").select(F.col("page_id").alias("test"), F.regexp_replace(F.regexp_replace("url", r"^\w+://[^/]*", ""), "[?#].*$", "").alias("url_path"))
    return s.route_visits(visits, [("lang", "(group)/[lang]/[page]"), ("rest", "de/[...rest]"), ("maybe", "fr/[[...rest]]")])


@R.add("join_visited_paths", "select page_id, unnest(list_filter(regexp_extract_all(html, 'href=[\"'']([^\"''`?#]*)', 1), lambda u: starts_with(u, '/'))) as visited from pages")
def visited(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(s.visited_paths("html")).alias("visited"))


_NAMED = r"([A-Za-z]{4,}\.)\s"


@R.add("join_content_references", f"""with tg as (select distinct concat('lib/', w) as target, replace(w, '.', '\\.') as w from (select regexp_extract(text, '{_NAMED}', 1) as w from benchmark) where w <> '')
  select doc_id as reader, target from documents, tg where regexp_matches(text, concat('(^|["''`/\\s=(])(lib/)?', w, '($|["''`/\\s),;:])'))""")
def content(spark, sf):
    files = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    targets = table(spark, sf, "benchmark").select(F.regexp_extract("text", _NAMED, 1).alias("w")).where("w <> ''").distinct().select(F.concat(F.lit("lib/"), "w").alias("path"))
    return s.content_references(files, targets).select(F.col("reader").cast("long").alias("reader"), "target")


_PB = f"""tests as (select path, {_DIR} as dir from file where {_TEST}), ch as (select path from file where ord % 150 = 1), code as (select path from ch where not regexp_matches(path, '\\.md$')),
near as (select code.path, max(len(t.dir)) as n, arg_max(t.dir, len(t.dir)) as dir from code join tests t on starts_with(code.path, t.dir || '/') group by code.path)"""


@R.add("path_baseline", f"{_F}, {_PB} select path as test, case when (select count(*) from near) < (select count(*) from code) then 'all' else 'scope' end as reason from tests t where (select count(*) from near) < (select count(*) from code) or exists (select 1 from near where starts_with(t.path, near.dir || '/'))")
def baseline(spark, sf):
    f = load(spark, sf, "file")
    return s.path_baseline(f.where("ord % 150 = 1"), f.where(d.is_test("path")))


@R.add("path_baseline_scoped", f"{_F}, {_PB.replace('ord % 150 = 1', '((ord % 12 = 2 and ord % 50 = 2) or (ord % 12 = 1 and ord % 5 = 0))')} select path as test, 'scope' as reason from tests t where exists (select 1 from near where starts_with(t.path, near.dir || '/')) and (select count(*) from near) = (select count(*) from code)")
def baseline_scoped(spark, sf):
    """Documents, and the tests themselves: every scope is found."""
    f = load(spark, sf, "file")
    return s.path_baseline(f.where("(ord % 12 = 2 and ord % 50 = 2) or (ord % 12 = 1 and ord % 5 = 0)"), f.where(d.is_test("path")))


@R.add(
    "join_import_resolution",
    f"""{_F}, ref as (select ord, concat({_DIR}, '/f', cast(ord + case ord % 3 when 0 then 0 when 1 then 7 else 100000 end as varchar)) as base from file),
    c as (select ref.ord, f.path, case {" ".join(f"when f.path = base || '{e}' then {i}" for i, e in enumerate(["", *".ts .tsx .d.ts .js .jsx .mjs .cjs .json".split()]))} else 99 end as n from ref join file f on starts_with(f.path, base || '.') or f.path = base)
    select ref.ord, base, x.path as resolved from ref left join (select ord, arg_min(path, n) as path from c where n < 99 group by ord) x on x.ord = ref.ord""",
)
def imports(spark, sf):
    f = load(spark, sf, "file")
    far = F.expr("ord + case ord % 3 when 0 then 0 when 1 then 7 else 100000 end")
    refs = f.select("ord", F.concat(p.dirname("path"), F.lit("/f"), far.cast("string")).alias("base"))
    return s.first_existing(refs, s.import_candidates(F.col("base")), f)


@R.add("join_external_importers", "select distinct p_partkey as importer, p_brand as package from part where p_partkey % 3 <> 2 and p_brand in ('Brand#2', 'Brand#4') union select distinct p_partkey, concat('@', p_type, '/', p_name) from part where p_partkey % 3 = 2 and p_type = 'SMALL' and p_name = 'hot plate'")
def external(spark, sf):
    spec = F.expr("case p_partkey % 3 when 0 then p_brand when 1 then concat(p_brand, '/deep/file') else concat('@', p_type, '/', p_name, '/x') end")
    refs = table(spark, sf, "part").select(F.col("p_partkey").alias("importer"), spec.alias("specifier"))
    return s.external_importers(refs, spark.createDataFrame([("Brand#2",), ("Brand#4",), ("@SMALL/hot plate",)], "package string"))


QUERIES, ORACLES = R.queries, R.oracles
