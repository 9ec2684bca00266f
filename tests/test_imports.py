"""Import extraction and resolution on sources as they are written, and the rules beside them."""

from pyspark.sql import functions as F

from ripplet.operators import routing as r
from ripplet.sources import imports as im

TEXT = """
// import no from './no'; require('./no')
/* import no2 from './no2' */
import def, { a as b, type T, c } from "./lib.js";
import * as ns from '../up/mod';
import type { U } from '@/types';
import './side.css';
import old = require('legacy');
export { x, y as z } from './re';
export * from './star';
export type { V } from './v';
const url = "http://not/a/comment"; const q = 'it\\'s // not one';
const m = await import('./dyn?raw');
const t = await import(`./locales/${lang}.json`);
const u = require(name);
vi.mock('./mocked', () => ({}));
const all = import.meta.glob('./pages/**/*.ts');
obj.require('./method');
"""


def test_references(spark):
    got = im.extract_imports(spark.createDataFrame([("src/a/main.ts", TEXT), ("src/empty.ts", ""), ("src/null.ts", None)], "path string, content string")).orderBy("ord").collect()
    assert [(x.kind, x.specifier, x.names, x.computed) for x in got] == [
        ("import", "./lib.js", ["default", "a", "c"], False),
        ("import", "../up/mod", ["*"], False),
        ("type-import", "@/types", ["U"], False),
        ("import", "./side.css", None, False),
        ("require", "legacy", None, False),
        ("re-export", "./re", ["x", "y"], False),
        ("re-export", "./star", ["*"], False),
        ("type-import", "./v", ["V"], False),
        ("dynamic-import", "./dyn", None, False),
        ("dynamic-import", "`./locales/${lang}.json`", None, True),
        ("require", "name", None, True),
        ("mock", "./mocked", None, False),
        ("glob", "./pages/**/*.ts", None, True),
    ]


def test_resolution_and_expansion(spark):
    files = ["src/a/main.ts", "src/a/lib.ts", "src/up/mod/index.ts", "src/types.ts", "src/a/side.css", "src/a/re.tsx", "src/a/star.d.ts", "src/a/dyn.js", "src/a/locales/en.json", "src/a/locales/de.json", "src/a/pages/x/y.ts", "src/a/pages/z.ts", "src/a/mocked.ts"]
    f = spark.createDataFrame([(p,) for p in files], "path string")
    refs = im.extract_imports(spark.createDataFrame([("src/a/main.ts", TEXT)], "path string, content string"))
    res = {x.specifier: (x.resolved, x.resolution) for x in im.resolve_imports(refs, f, [("@/*", "src/*")], spark.createDataFrame([], "name string, subpath string, target string")).collect()}
    assert res == {
        "./lib.js": ("src/a/lib.ts", "internal"), "../up/mod": ("src/up/mod/index.ts", "internal"), "@/types": ("src/types.ts", "internal"), "./side.css": ("src/a/side.css", "internal"), "legacy": (None, "external-package"),
        "./re": ("src/a/re.tsx", "internal"), "./star": ("src/a/star.d.ts", "internal"), "./v": (None, "unresolved"), "./dyn": ("src/a/dyn.js", "internal"), "./mocked": ("src/a/mocked.ts", "internal"),
    }
    usable = f.withColumn("usable", F.lit(True))
    assert {x.target for x in im.expand_computed(refs, usable).collect()} == {"src/a/locales/en.json", "src/a/locales/de.json", "src/a/pages/x/y.ts", "src/a/pages/z.ts"}
    # a file that can't be loaded leaves its load computed
    some = f.withColumn("usable", F.col("path") != "src/a/locales/de.json")
    assert {x.target for x in im.expand_computed(refs, some).collect()} == {"src/a/pages/x/y.ts", "src/a/pages/z.ts"}
    assert im.resolved(F.lit("a"), F.lit("../../x")) is not None and spark.range(1).select(im.resolved(F.lit("a"), F.lit("../../x"))).first()[0] is None


def test_awkward_texts_end(spark):
    odd = ["`" * 50_001, "/*" * 50_000, '"' + "\\" * 100_001, "import {" + "a," * 50_000, "'" * 99_999, "/" * 100_000]
    got = im.extract_imports(spark.createDataFrame([(str(i), t) for i, t in enumerate(odd)], "path string, content string"))
    assert got.count() == 0


def test_chain_stops(spark):
    refs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("a", "d"), ("y", "x"), ("stop", "y")], "reader string, target string")
    roots, stops = spark.createDataFrame([("a",), ("x",), ("lone",)], "path string"), spark.createDataFrame([("stop",)], "path string")
    got = {tuple(x) for x in r.reader_chain(refs, roots, stops).collect()}
    assert got == {("a", "b", 1, "a"), ("a", "c", 2, "b"), ("a", "d", 3, "c"), ("x", None, 2, "blocked")}
    assert {tuple(x)[:2] for x in r.reader_chain(refs, roots, stops, most=2).where("root = 'a'").collect()} == {("a", None)}


def test_values(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(r.shard_spec(F.lit("2/3"))) == (2, 3) and all(one(r.shard_spec(F.lit(x))) is None for x in ("0/3", "4/3", "1/1001", "1/", "a/b", "-1/2"))
    assert one(r.same_json(F.lit('{"a": "x  y"}'), F.lit('{"a":"x  y"}'))) and not one(r.same_json(F.lit('{"a": "x y"}'), F.lit('{"a":"x  y"}'))) and not one(r.same_json(F.lit('{"a":1,"b":2}'), F.lit('{"b":2,"a":1}')))
    assert [one(r.report_path(F.lit(x), "/w/repo", "pkg")) for x in ("/w/repo/a/b.ts", "/else/b.ts", "./a//b.ts", "../b.ts", "http://x/y", "a\\b.ts", "a/")] == ["a/b.ts", "/else/b.ts", "pkg/a/b.ts", "", "", "pkg/a/b.ts", ""]
    assert one(r.pytest_file(F.lit("a/b/tests/test_x.py"), ["test_*.py"], ["**/tests"])) and not one(r.pytest_file(F.lit("a/test_x.py"), ["test_*.py"], ["tests"])) and one(r.pytest_file(F.lit("x_test.py"), ["*_test.py"], []))


def test_names_in_content(spark):
    from ripplet.operators.selection import content_references

    files = spark.createDataFrame([
        ("full", 'read("src/data/a.json")'), ("base", "cat a.json | sort"), ("other", "xa.json a.jsonx a_json"), ("prose", "the data is here"), ("quoted", "list('data')"), ("slash", "ls ./data/x"),
        ("end", "open('src/data')"), ("comma", "[b,a.json]"), ("src/data/a.json", "a.json"), ("null", None),
    ], "path string, content string")
    target = spark.createDataFrame([("src/data/a.json",)], "path string")
    assert {x.reader for x in content_references(files, target).collect()} == {"full", "base"}
    assert {x.reader for x in content_references(files, target, above=True).collect()} == {"full", "base", "quoted", "slash", "end"}


def reach(spark, plain, own=(), forwards=(), stars=(), runtime=(), imports=(), types=None):
    from ripplet.operators import graph as g

    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    modules, fwd, star = make([(p, True) for p in plain], "path string, plain boolean"), make(forwards, "path string, name string, target string, imported string"), make(stars, "path string, target string")
    t = None if types is None else make(types, "path string, target string")
    body = g.body_edges(make(runtime, "path string, target string"), make(imports, "path string, target string, name string"), modules, fwd, star, t)
    return {x.path for x in g.module_reach(modules, make(own, "path string, name string"), fwd, star, body, make([("t",)], "path string")).collect()}


def test_reach_through_barrels(spark):
    loads = dict(runtime=[("t", "barrel"), ("barrel", "a"), ("barrel", "b")], imports=[("t", "barrel", "a")])
    own = [("a", "a"), ("b", "b")]
    pairs = [("barrel", "a", "a", "a"), ("barrel", "b", "b", "b")]
    assert reach(spark, ["barrel", "a", "b"], own, pairs, **loads) == {"t", "barrel", "a"}
    # a module that does more than define counts as a whole
    assert reach(spark, ["a", "b"], own, pairs, **loads) == {"t", "barrel", "a", "b"}
    # stars: only what can have the name; an unknown name takes all
    assert reach(spark, ["barrel", "a", "b"], own, (), [("barrel", "a"), ("barrel", "b")], **loads) == {"t", "barrel", "a"}
    assert reach(spark, ["barrel", "a", "b"], [("a", "x")], (), [("barrel", "a"), ("barrel", "b")], **loads) == {"t", "barrel", "a", "b"}
    # namespaces and cycles of stars
    assert reach(spark, ["barrel", "a", "b"], own, [("barrel", "a", "a", "*")], [("a", "b"), ("b", "a")], **loads) == {"t", "barrel", "a", "b"}
    # an own export runs the body, which loads by name; a type import counts where types are checked
    own, loads = [("barrel", "a"), ("b", "b"), ("b", "c")], dict(runtime=[("t", "barrel"), ("barrel", "b"), ("b", "x")], imports=[("t", "barrel", "a"), ("barrel", "b", "b")])
    assert reach(spark, ["barrel", "b", "x"], own, **loads) == {"t", "barrel", "b", "x"}
    assert reach(spark, ["barrel", "b", "x"], [("barrel", "a"), ("b", "c")], [("b", "b", "x", "y")], types=[("barrel", "b")], **loads) == {"t", "barrel", "b", "x"}


def test_expansion_keeps_loads_and_targets_apart(spark):
    # 40 loads of one directory: its files are matched once, not once a load
    files = [f"d/f{i}.ts" for i in range(60)] + ["d/sub/f1.ts", "e/f1.ts"]
    text = "import(`./f${n}1`); import('./f11'); import x from './f11';"
    both = text + " import(`./f${n}`);"
    src = spark.createDataFrame([(f"d/f{i}.ts", both if i == 1 else text) for i in range(40)], "path string, content string")
    f = spark.createDataFrame([(p, True) for p in files], "path string, usable boolean")
    refs = im.extract_imports(src)
    some = im.expansion(refs, f)
    assert some.loads.count() == 41
    assert some.targets.where("regex not like '%1%'").count() == 60 and some.targets.where("regex like '%1%'").count() == 6
    ends = [p for p in files if p.startswith("d/f") and p.endswith("1.ts")]
    want = {(f"d/f{i}.ts", t, "dynamic-import") for i in range(40) for t in ends if t != f"d/f{i}.ts"} | {(f"d/f{i}.ts", "d/f11.ts", "import") for i in range(40) if i != 11} | {("d/f1.ts", t, "dynamic-import") for t in files[:60] if t != "d/f1.ts"}
    res = im.resolve_imports(refs, f, [], spark.createDataFrame([], "name string, subpath string, target string"))
    got = [tuple(r) for r in im.import_edges(res, some).collect()]
    assert got == sorted(want)
    assert sorted((r.importer, r.target) for r in some.rows().collect() if r.ord == 0) == sorted((s, t) for s, t, k in want if k == "dynamic-import" and t in ends)
    assert {r.resolution: r.n for r in im.resolution_counts(refs, res, some.loads).collect()}["expanded"] == 41
    # a file that can't be loaded leaves all loads computed but its own
    bad = f.withColumn("usable", F.col("path") != "d/f21.ts")
    assert {r.importer for r in im.expand_computed(refs.where("importer <> 'd/f1.ts'"), bad).collect()} == {"d/f21.ts"}


def test_first_of_several_places_of_a_reference(spark):
    # an alias before another, a source before its declaration, a compiled ending, a package's export as it is
    files = ["b/x.ts", "a/x.d.ts", "a/y.tsx", "b/y.ts", "p/out.js", "p/out.js.ts", "r.ts", "r/index.ts"]
    refs = im.extract_imports(spark.createDataFrame([("main.ts", "import '@/x'; import '@/y.js'; import 'pkg'; import './r'; import './r/'; import 'none'; import '@/none';")], "path string, content string"))
    f = spark.createDataFrame([(p,) for p in files], "path string")
    packages = spark.createDataFrame([("pkg", ".", "p/out.js")], "name string, subpath string, target string")
    out = im.resolve_imports(refs, f, [("@/*", "a/*"), ("@/*", "b/*")], packages)
    assert {r.specifier: (r.resolved, r.resolution) for r in out.collect()} == {
        "@/x": ("a/x.d.ts", "internal"), "@/y.js": ("a/y.tsx", "internal"), "pkg": ("p/out.js", "internal"), "./r": ("r.ts", "internal"), "./r/": ("r.ts", "internal"), "none": (None, "external-package"), "@/none": (None, "unresolved"),
    }
    # six references are six rows: they meet files by what an import may say of them, not once a suffix
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "posexplode" not in plan
