import random
import re
import time
from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ripplet.functions import globs
from ripplet.operators import ci, delta, graph, history, inference, routing, selection, verdicts
from ripplet.plans import impact
from tests.compare import duck


def test_closure_and_paths_against_a_queue(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(70)] + [(50, 51), (51, 50)]
    e = spark.createDataFrame([(a, b, "import") for a, b in edges], "src int, dst int, kind string")
    roots = [0, 3, 50, 99]
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    want = {}
    for r in roots:
        paths, queue = {r: [r]}, deque([r])
        while queue:
            x = queue.popleft()
            for y in sorted(out.get(x, ())):
                if y not in paths:
                    paths[y] = paths[x] + [y]
                    queue.append(y)
        want.update({(r, n): p for n, p in paths.items()})
    df = spark.createDataFrame([(r, r) for r in roots], "root int, node int")
    got = {(r.root, r.node): r.depth for r in graph.closure(e, df).collect()}
    assert got == {k: len(p) - 1 for k, p in want.items()}
    got = {(r.root, r.node): r.path for r in graph.shortest_paths(e, df.select("root"), 40).collect()}
    assert got == want


def test_export_reach_through_a_barrel(spark):
    rows = [("t", "a", "barrel", "a"), ("barrel", "a", "a.ts", "a"), ("barrel", "b", "b.ts", "b"), ("a.ts", "a", "deep", "x"), ("star", "*", "barrel", "*")]
    b = spark.createDataFrame(rows, "path string, name string, target string, imported string")
    seeds = spark.createDataFrame([("t", "t", "a"), ("s", "star", "b"), ("w", "barrel", "*")], "root string, path string, name string")
    got = {(r.root, r.path) for r in graph.export_reach(b, seeds).collect()}
    assert {("t", "a.ts"), ("t", "deep"), ("s", "b.ts"), ("w", "a.ts"), ("w", "b.ts")} <= got and ("t", "b.ts") not in got and ("s", "a.ts") not in got


def _naive(pattern, path):
    """A matcher by recursion for the common part of the dialects."""
    if not pattern:
        return not path
    if pattern == "/**":
        return path == "" or path.startswith("/")
    if pattern.startswith("**/"):
        return _naive(pattern[3:], path) or any(path[i] == "/" and _naive(pattern[3:], path[i + 1 :]) for i in range(len(path)))
    if pattern[0] == "*":
        return _naive(pattern[1:], path) or (path != "" and path[0] != "/" and _naive(pattern, path[1:]))
    if pattern[0] == "?":
        return path != "" and path[0] != "/" and _naive(pattern[1:], path[1:])
    return path != "" and path[0] == pattern[0] and _naive(pattern[1:], path[1:])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["**/", "*", "?", "a", "b", ".", "/", "(", "$"]), max_size=7), st.booleans(), st.text("ab./($", max_size=9))
def test_globs_against_recursion(parts, below, path):
    pattern = "".join(parts) + ("/**" if below else "")
    if "**/*" in pattern.replace("**/", "") or re.search(r"\*\*(?!/)", pattern[:-3] if below else pattern):
        return
    assert bool(re.search(globs.task_glob(pattern), path)) == _naive(pattern, path), globs.task_glob(pattern)


@pytest.mark.parametrize(
    "compile_,pattern,yes,no",
    [
        (globs.task_glob, "src/{a,b{1,2}}/*.ts", ["src/a/x.ts", "src/b2/x.ts"], ["src/b/x.ts", "src/a/y/x.ts"]),
        (globs.task_glob, "app/(group)/[!a]*", ["app/(group)/b"], ["app/(group)/a"]),
        (globs.test_glob, "*.@(test|spec).?(c|m)[jt]s", ["a.test.js", "x/y/b.spec.mts"], ["a.test.css"]),
        (globs.segment_glob, "test_*.py", ["test_a.py"], ["x/test_a.py"]),
        (globs.route, "(shop)/[id]/[...rest]", ["/1/a/b"], ["/1"]),
        (globs.route, "docs/[[...rest]]", ["/docs", "/docs/a/b"], ["/doc"]),
    ],
)
def test_glob_dialects(compile_, pattern, yes, no):
    rx = re.compile(compile_(pattern))
    assert all(rx.search(p) for p in yes) and not any(rx.search(p) for p in no)


def test_shards_against_a_loop(spark):
    rng = random.Random(2)
    tests = [(s, f"t{i}") for s in (1, 2) for i in range(rng.randint(1, 30))]
    ms = {f"t{i}": float(rng.randint(1, 9)) for i in range(20)}
    got = history.shards(spark.createDataFrame(tests, "selection int, test string"), spark.createDataFrame(list(ms.items()), "test string, ms double"), 3).collect()
    for s in (1, 2):
        own = [t for k, t in tests if k == s]
        known = sorted(ms[t] for t in own if t in ms)
        mid = known[len(known) // 2] if known else 1.0
        loads, want = [0.0] * 3, {}
        for t in sorted(own, key=lambda t: (-ms.get(t, mid), t)):
            k = loads.index(min(loads))
            loads[k] += ms.get(t, mid)
            want[t] = k
        assert {r.test: r.shard for r in got if r.selection == s} == want
    with pytest.raises(ValueError):
        history.shards(spark.createDataFrame(tests, "selection int, test string"), spark.createDataFrame([], "test string, ms double"), 0)


def test_known_curve(spark):
    rows = [(1, 1, "slow", 0, True, 10.0), (1, 1, "a", 1, False, 80.0), (2, 2, "a", 0, False, 80.0), (2, 2, "slow", 1, True, 20.0)]
    o = spark.createDataFrame(rows, "run int, seq int, test string, pos int, failed boolean, ms double")
    curve = sorted((r.time_share, r.ranked, r.by_path) for r in history.confidence_curve(o, 4).collect())
    assert curve == [(0.25, 0.5, 0.0), (0.5, 0.5, 0.0), (0.75, 0.5, 0.0), (1.0, 1.0, 1.0)]


def test_job_buckets(spark):
    rows = [("lint", "failure", ["Run eslint"], True, "CI", "check"), ("E2E tests", "failure", ["Run"], True, "CI", "ci-only"), ("policy", "failure", ["Run"], True, "CI", "ci-only"), ("test", "failure", ["Set up job", "Install"], True, "CI", "infra"),
            ("test", "failure", [], True, "CI", "infra"), ("test", "cancelled", [], False, "CI", "infra"), ("a / unit", "failure", None, False, "CI", "check"), ("Node 24", "failure", ["Run"], True, "Unit tests", "check"), ("x", "failure", ["Check lockfile"], True, "CI", "ci-only")]
    df = spark.createDataFrame(rows, "name string, conclusion string, steps array<string>, known boolean, workflow string, want string")
    assert all(r.got == r.want for r in df.select("want", ci.bucket("name", "conclusion", "steps", "known", "workflow").alias("got")).collect())


def test_every_verdict_occurs(spark):
    from ripplet import catalog

    found = {r.verdict for r in catalog.QUERIES["ci_verdicts"](spark, "/root/testdata/sf0.01").select("verdict").distinct().collect()}
    assert len(found) >= 5, found


def test_deleted_file_without_node_runs_everything(spark):
    nodes = spark.createDataFrame([(1, True), (2, False)], "path int, is_test boolean")
    changed = spark.createDataFrame([(9, 0, "deleted")], "path int, ord long, change_type string")
    edges = spark.createDataFrame([(1, 2, "import")], "src int, dst int, kind string")
    why = impact.affected(nodes, edges, changed)
    assert [tuple(r) for r in impact.plan(nodes, why, impact.fallback(nodes, changed)).collect()] == [(1, "SELECTED", "FULL")]
    assert [r.decision for r in impact.plan(nodes, why, impact.fallback(nodes, changed.limit(0))).collect()] == ["SKIPPED"]
    assert impact.fallback(nodes, changed.limit(0), "UNSAFE").count() == 1


def test_path_baseline_of_documents_alone(spark):
    tests = spark.createDataFrame([("a/x.test.ts",), ("b/y.test.ts",)], "path string")
    run = lambda *p: sorted(r.test for r in selection.path_baseline(spark.createDataFrame([(x,) for x in p], "path string"), tests).collect())
    assert run("README.md") == [] and run("a/b/c.ts") == ["a/x.test.ts"] and run("a/c.ts", "z/c.ts") == ["a/x.test.ts", "b/y.test.ts"] and len(run("package.json")) == 2
    assert selection.path_baseline(spark.createDataFrame([], "path string"), tests).count() == 0


def test_matrix_and_unknown_guard(spark):
    axes = spark.createDataFrame([(1, 0, "os", 0, "a"), (1, 0, "os", 1, "b"), (1, 1, "n", 0, "1"), (1, 1, "n", 1, "2")], "job int, ord int, key string, pos int, value string")
    cells = [r.assignment for r in inference.matrix_cells(axes).orderBy("cell").collect()]
    assert cells == [{"os": "a", "n": "1"}, {"os": "a", "n": "2"}, {"os": "b", "n": "1"}, {"os": "b", "n": "2"}]
    row = spark.createDataFrame([(1, *[False] * 4, None, *[False] * 8)], "observation int, " + ", ".join(f"{s} boolean" for s in verdicts.ENFORCE_STEPS))
    assert verdicts.enforce(row).first().outcome == verdicts.ENFORCE_STEPS[4]


def test_categories(spark):
    rows = {"src/a.ts": "source", "src/a.test.ts": "test", "docs/x.md": "docs", "a.png": "asset", "package.json": "config", ".github/workflows/ci.yml": "infrastructure", "db/migrations/1.ts": "database", "x/fixtures/a.bin": "test-fixture", "blob": "unknown", "scripts/x.py": "script"}
    df = spark.createDataFrame([(k,) for k in rows], "path string")
    assert {r.path: r.c for r in df.select("path", delta.category("path").alias("c")).collect()} == rows


def test_dependents_to_the_depth_of_the_sql(spark, tmp_path):
    # a chain of parts from 40 to 60, each of which loads the next; 57 and 60 are changed
    lines = [(p, n, p + n - 1) for p in range(40, 60) for n in (1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").selectExpr("*", "1.0D as l_quantity", "'R' as l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 101).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.root, r.node): r.depth for r in entry.queries()["graph_dependents"](spark, str(tmp_path)).collect()}
    assert got[60, 48] == 12 and (60, 47) not in got
    columns, want = duck(str(tmp_path), entry.oracle_sql()["graph_dependents"])
    at = [columns.index(c) for c in ("root", "node", "depth")]
    assert got == {(r[at[0]], r[at[1]]): r[at[2]] for r in want}


def test_reach_by_hubs(spark):
    # a ring that all come to, tails before and after it, and an island with a ring of its own
    rng = random.Random(5)
    ring = [(i, (i + 1) % 30) for i in range(30)] + [(i, 0) for i in range(0, 30, 3)] + [(0, i) for i in range(0, 30, 4)]
    edges = ring + [(100 + i, rng.randrange(30)) for i in range(40)] + [(200 + i, 100 + i) for i in range(20)] + [(5, 300), (300, 301)] + [(400 + i, 400 + (i + 1) % 7) for i in range(7)] + [(500, 301), (501, 400), (501, 3)]
    roots = [*range(200, 220), 100, 7, 300, 402, 500, 501, 999]
    want = set()
    for r in roots:
        seen, todo = {r}, [r]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        want |= {(r, x) for x in seen}
    got = [tuple(r) for r in graph.reach(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(r, r) for r in roots], "root long, node long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_declared_tests_are_made_once(spark):
    changed = spark.createDataFrame([("a/x.sql",), ("a/y.sql",), ("b/z.md",), ("a/x.sql",)], "path string")
    tests = spark.createDataFrame([("t/1.test.ts",), ("t/2.test.ts",), ("u/3.test.ts",)], "path string")
    out = selection.declared_tests(changed, tests, [("**/*.sql", "t/*"), ("a/x*", "**/*.test.ts"), ("b/**", "u/*")])
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted([("a/x.sql", f"{d}.test.ts") for d in ("t/1", "t/2", "u/3")] + [("a/y.sql", f"t/{n}.test.ts") for n in (1, 2)] + [("b/z.md", "u/3.test.ts")])
    # what makes rows distinct comes before the join that makes the pairs
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString().partition("Join")[0]


def test_fixture_owners_find_the_directory_first(spark):
    f = spark.createDataFrame([("a/b/x.json",), ("a/c/y.json",), ("z.json",)], "path string")
    t = spark.createDataFrame([("a/1.test.ts",), ("a/b/2.test.ts",), ("a/b/3.test.ts",)], "path string")
    out = selection.fixture_owners(f, t)
    assert sorted(tuple(r) for r in out.collect()) == [("a/b/x.json", "a/b/2.test.ts"), ("a/b/x.json", "a/b/3.test.ts"), ("a/c/y.json", "a/1.test.ts")]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_shards_of_many_tests(spark):
    # 20,000 tests of one selection: a step of the fold that copies all places before it takes minutes
    n = 20_000
    tests = spark.range(n).selectExpr("1 as selection", "concat('t', lpad(cast(id as string), 6, '0')) as test")
    times = spark.range(n).where("id % 3 <> 0").selectExpr("concat('t', lpad(cast(id as string), 6, '0')) as test", "cast(id % 17 + 1 as double) as ms")
    began = time.time()
    got = {r.test: r.shard for r in history.shards(tests, times, 4).collect()}
    assert time.time() - began < 60
    ms = {f"t{i:06}": float(i % 17 + 1) for i in range(n) if i % 3}
    known = sorted(ms.values())
    loads, want = [0.0] * 4, {}
    for t in sorted((f"t{i:06}" for i in range(n)), key=lambda t: (-ms.get(t, known[len(known) // 2]), t)):
        k = loads.index(min(loads))
        loads[k] += ms.get(t, known[len(known) // 2])
        want[t] = k
    assert got == want


def test_manifests_are_parsed_once(spark):
    rows = [('{"a":1}', "no json"), ('{"name":"a"}', '{"name":"b"}'), ('{"scripts":{"t":"x"}}', "{}"), ("{}", "{}"), (None, "{}")]
    df = spark.createDataFrame(rows, "b string, a string").select(delta.manifest_change("b", "a").alias("c"))
    assert [r.c for r in df.collect()] == ["resolution", "metadata", "scripts", "none", "resolution"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 2


def test_nearest_ancestor_keeps_a_share_of_the_paths_a_task(spark):
    paths = spark.range(500).selectExpr("concat('a/b', cast(id % 7 as string), '/f', cast(id as string)) as path").coalesce(1)
    owners = spark.createDataFrame([("a", "all"), ("a/b3", "three")], "dir string, owner string")
    out = selection.nearest_ancestor(paths, owners)
    assert {r.path: r.owner for r in out.collect()} == {f"a/b{i % 7}/f{i}": "three" if i % 7 == 3 else "all" for i in range(500)}
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_layout_keeps_a_share_of_the_paths_a_task(spark):
    paths = spark.range(500).selectExpr("concat('a/b', cast(id % 7 as string), '/f', cast(id as string), case when id % 2 = 0 then '.md' else '.ts' end) as path").coalesce(1)
    roots = spark.createDataFrame([("scripts", "a/b3"), ("operations", "a/b4/f4.md"), ("source", "a"), ("scripts", "")], "kind string, path string")
    out = routing.layout(paths.unionAll(paths), roots)
    rows = {r.path: (r.is_documentation, r.is_script) for r in out.collect()}
    assert out.count() == len(rows) == 500 and rows["a/b4/f4.md"] == (True, True) and rows["a/b4/f11.ts"] == (False, False)
    assert sum(s for _, s in rows.values()) == sum(i % 7 == 3 for i in range(500)) + 1
    assert out.select(F.spark_partition_id()).distinct().count() > 4


def test_failing_jobs_are_judged_once(spark):
    runs = spark.createDataFrame([(1, "a", "CI", "failure"), (2, "b", "CI", "failure"), (3, "b", "CI", "success")], "run int, pr string, workflow_name string, conclusion string")
    jobs = spark.createDataFrame([(1, 11, "lint", "failure", ["Run"], True), (2, 21, "lint", "failure", ["Run"], True), (2, 22, "E2E tests", "failure", ["Run"], True), (3, 31, "lint", "success", ["Run"], True)], "run int, job int, name string, conclusion string, failed_steps array<string>, steps_known boolean")
    notes = spark.createDataFrame([(11, "x"), (21, "y"), (21, "y"), (31, "x")], "job int, signature string")
    out = ci.own_failures(runs, jobs, notes)
    assert sorted((r.run, r.job, r.bucket, r.ownership) for r in out.collect()) == [(1, 11, "check", "own"), (2, 21, "check", "own"), (2, 22, "ci-only", None)]
    # what judges names stays out of the plan that reads them four times
    assert "playwright" not in out._jdf.queryExecution().optimizedPlan().toString()
