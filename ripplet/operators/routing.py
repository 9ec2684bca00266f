"""How each changed path is followed up: what kind of file it is, which way it is resolved, and what forces a full run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.functions.globs import test_glob
from ripplet.functions.paths import ancestors, basename, module_key, package_root
from ripplet.operators.rules import tool_subject
from ripplet.runtime import again, store, tasks

_col = lambda x: F.col(x) if isinstance(x, str) else x
CODE = r"\.[cm]?[jt]sx?$"


def ci_config(path: str | Column) -> Column:
    """Paths that by their name alone define a CI pipeline."""
    p, name = _col(path), basename(path)
    yaml = p.rlike(r"(?i)\.ya?ml$")
    return (
        p.rlike(r"^\.(github/workflows|circleci|buildkite)/") | F.lower(name).rlike(r"(^|\.)gitlab-ci\.ya?ml$|^azure-pipelines\.ya?ml$")
        | (p.rlike(r"^\.(gitlab|azure-pipelines|azuredevops)/") & yaml) | p.isin("bitbucket-pipelines.yml", ".travis.yml") | (name == "Jenkinsfile")
    )


def included_configs(includes: DataFrame, root: str, depth: int = 10) -> DataFrame:
    """(path, depth): files that includes(path, target) reach from the root in fewer than `depth` steps, the root itself not counted."""
    spark = includes.sparkSession
    links = store(includes.select("path", "target").distinct(), "includes")
    front = store(spark.createDataFrame([(root, 0)], "path string, depth int"), "include-level")
    paths = [front._ripplet_path]
    for level in range(1, depth):
        seen = spark.read.schema(front.schema).parquet(*paths).select(F.col("path").alias("target"))
        step = front.select("path").join(again(links), "path").select("target").distinct().join(seen, "target", "left_anti")
        front = store(step.select(F.col("target").alias("path"), F.lit(level).alias("depth")), "include-level")
        if front.isEmpty():
            break
        paths.append(front._ripplet_path)
    return spark.read.schema(front.schema).parquet(*paths).where("depth > 0")


def nested_test_config(path: str | Column) -> Column:
    """A runner's or a transform's configuration below the root, outside installed packages."""
    p = _col(path)
    return p.contains("/") & ~p.rlike("(^|/)node_modules/") & basename(path).rlike(r"^(jest\.config\.|vitest\.(config|workspace|projects)\.|babel\.config\.|\.babelrc)")


def next_entry_kind(path: str | Column, is_next: Column) -> Column:
    """The kind of a Next.js entry point by its base name; null elsewhere and in other repositories."""
    stem = F.lower(F.regexp_replace(basename(path), r"\.[^.]*$", ""))
    kinds = {"page": "page", "layout": "layout", "route": "route", "loading": "loading", "error": "error", "template": "template", "not-found": "error", "middleware": "api"}
    named = F.create_map(*(F.lit(x) for k, v in kinds.items() for x in (k, f"next-{v}")))
    return F.when(is_next & F.lower(_col(path)).rlike(CODE), F.when((stem == "api") & _col(path).contains("/api/"), "next-api").otherwise(named[stem]))


def documentation_path(path: str | Column) -> Column:
    return F.lower(_col(path)).rlike(r"\.mdx?$|^(docs?|documentation)/")


def layout(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, is_documentation, is_script) of paths, by source roots(kind, path): a prefix join through ancestor directories."""
    scripts = roots.where("kind in ('scripts', 'operations') and path <> ''").select(F.col("path").alias("dir"), F.lit(True).alias("is_script")).distinct()
    # spread by path first: what is kept a path is then a share of all, and paths are shuffled once
    places = paths.select("path").repartition(tasks(paths.sparkSession), "path").select("path", F.explode(F.concat(F.array("path"), ancestors("path"))).alias("dir"))
    out = places.join(scripts, "dir", "left").groupBy("path").agg(F.coalesce(F.bool_or("is_script"), F.lit(False)).alias("is_script"))
    return out.select("path", documentation_path("path").alias("is_documentation"), "is_script")


def python_source(path: str | Column) -> Column:
    outside = r"(^|/)(\.venv|venv|env|\.env|\.tox|\.nox|site-packages|__pycache__|\.eggs|\.mypy_cache|\.pytest_cache|\.ruff_cache|[^/]*\.egg-info)(/|$)"
    return _col(path).endswith(".py") & ~_col(path).rlike(outside)


def _segment(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c, end = glob[i], glob.find("]", i + 1)
        if c == "[" and end > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
            i = end
        else:
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".+^${}()|\\[]" else c
        i += 1
    return out


def pytest_file(path: str | Column, python_files: list[str], testpaths: list[str]) -> Column:
    """Whether pytest collects a path: its base name fits one of the globs, and it lies below one of the test paths, if there are any."""
    named = basename(path).rlike("|".join(f"^(?:{_segment(g)})$" for g in python_files) or "(?!)")
    places = []
    for root in testpaths:
        clean = root.removeprefix("./").rstrip("/")
        if clean in ("", "."):
            return named
        # ** spans any number of directories
        parts = ["(?:[^/]+/)*" if s == "**" else _segment(s) + "(?:/|$)" for s in clean.split("/")] if any(c in clean for c in "*?[") else [_segment(clean) + "(?:/|$)"]
        places.append("^" + "".join(parts))
    return named & _col(path).rlike("|".join(places)) if places else named


def forces_everything(path: str | Column) -> Column:
    """Paths for which the baseline that knows only paths runs all tasks."""
    p = F.lower(path)
    whole = "package.json go.mod go.sum requirements.txt setup.py pyproject.toml cargo.toml cargo.lock pom.xml build.gradle gradle.lockfile".split()
    return p.isin(whole) | p.rlike(r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.yaml|yarn\.lock|bun\.lockb?)$") | p.rlike(r"^(\.github/workflows/|database/|migrations/|ops/|terraform/|docker|tsconfig|next\.config|eslint\.config|\.eslintrc|vitest\.config|jest\.config)") | p.contains("dockerfile")


def baseline_decision(changed: DataFrame) -> DataFrame:
    """(change, decision) of changed(change, path): `all` if a path forces everything, `none` if all are documentation, else `rules`."""
    g = changed.groupBy("change").agg(F.bool_or(forces_everything("path")).alias("all"), F.bool_and(documentation_path("path")).alias("docs"))
    return g.select("change", F.when(F.col("all"), "all").when(F.col("docs"), "none").otherwise("rules").alias("decision"))


#: Signals in the order in which they are judged, with the reason that each gives.
RISKS = {"config": "CONFIG_GLOBAL", "dependencyManifest": "DEPENDENCY_MANIFEST", "lockfile": "LOCKFILE_GLOBAL", "workflow": "WORKFLOW_GLOBAL", "infrastructure": "INFRASTRUCTURE_GLOBAL", "database": "DATABASE_GLOBAL"}


def risk_fallbacks(signals: DataFrame, covered: DataFrame, workers_outside: bool, most: int = 5) -> DataFrame:
    """(reason, subject, paths, more) of signals(signal, path): what forces a full run.

    A tool configuration that has a name is a row of its own. Infrastructure and database files whose tests are declared
    (covered(path)) are exempt, and so are worker configurations where the suite runs no worker.
    """
    s = signals.where(F.col("signal").isin(*RISKS)).distinct()
    if workers_outside:
        s = s.where(~((F.col("signal") == "infrastructure") & basename("path").rlike(r"^wrangler\.(toml|jsonc?)$")))
    declared = covered.select("path", F.lit(True).alias("declared")).distinct()
    s = s.join(declared, "path", "left").where("declared is null or signal not in ('infrastructure', 'database')")
    s = s.withColumn("subject", F.when(F.col("signal") == "config", tool_subject("path")))
    reason = F.create_map(*(F.lit(x) for kv in RISKS.items() for x in kv))[F.col("signal")]
    grouped = s.groupBy(reason.alias("reason"), "subject", F.when(F.col("subject").isNotNull(), F.col("path")).alias("own")).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return grouped.select("reason", "subject", F.slice("paths", 1, most).alias("paths"), F.greatest(F.size("paths") - most, F.lit(0)).alias("more"))


def route(r: DataFrame) -> DataFrame:
    """r with `route`: the first that fits, in this order.

    r has path, category, change_type and, as booleans that may be null: is_old (the path before a rename), in_graph, is_asset,
    is_lockfile (the lockfile that dependency selection follows), any_lockfile, fixture (owned by tests), testdata (of a Go
    package), embedded, rust_asset, rust_source, cleared (a manifest whose edit changes nothing), worker_outside, infra_code.
    Routes that start with `readers` go on to the search for files that name the path; `full` and `orphan?` say what may end in a full run.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    named = tool_subject("path").isNotNull()
    manifest = F.col("path").endswith("/package.json") & ~F.col("path").rlike("(^|/)node_modules/") & ~yes("cleared") & (F.col("change_type") != "added")
    gone = (F.col("change_type") == "deleted") | (yes("is_old") & (F.col("change_type") == "renamed"))
    is_ = lambda *c: F.col("category").isin(*c)
    unseen = yes("is_asset") & ~yes("in_graph")
    return r.withColumn(
        "route",
        F.when(yes("rust_asset"), "asset").when(yes("rust_source"), "source").when(yes("embedded"), "asset").when(yes("testdata"), "testdata")
        .when(yes("is_lockfile"), "readers-lockfile").when(manifest, "full-manifest")
        .when(is_("test-fixture") & yes("fixture"), "fixture")
        .when(is_("unknown", "test-fixture") & named, "full-tool").when(is_("unknown", "test-fixture"), "readers")
        .when(is_("docs"), "none")
        .when(unseen & ~gone & ~documentation_path("path") & ~yes("any_lockfile"), F.when(yes("fixture"), "fixture").when(named, "full-tool").otherwise("readers"))
        .when(unseen & gone, "removed").when(yes("is_asset"), "asset")
        .when(is_("infrastructure") & yes("worker_outside"), "readers")
        .when(is_("config", "workflow", "infrastructure", "database"), "full-global")
        .when(yes("infra_code") & ~yes("in_graph") & (F.col("change_type") != "deleted"), "readers-infrastructure")
        .when(is_("test"), "test").when((F.col("change_type") == "deleted") & ~yes("in_graph"), "removed").otherwise("source, orphan?"),
    )


def removed_files(removed: DataFrame, nodes: DataFrame, unresolved: DataFrame, present: DataFrame) -> DataFrame:
    """(path, outcome, sibling): what becomes of removed(path) that the graph lacks.

    `present` if the repository has it after all; `blocked` if an unresolved, not computed import(specifier, computed) ends in one
    of its names; else `resolved`, with each node that imports of it may mean now.
    """
    own = removed.select("path").distinct()
    here = own.join(present.select("path").distinct(), "path", "left_semi").withColumn("outcome", F.lit("present"))
    key = module_key("path")
    names = F.array_distinct(F.array(basename("path"), F.regexp_replace(basename("path"), r"\.[^.]+$", ""), basename(key)))
    said = unresolved.where("not computed").select(basename(F.regexp_replace("specifier", "[?#].*$", "")).alias("name")).distinct()
    blocked = own.select("path", F.explode(names).alias("name")).join(said, "name").select("path", F.lit("blocked").alias("outcome")).distinct().join(here, "path", "left_anti")
    told = here.unionByName(blocked)
    siblings = own.select("path", key.alias("key")).join(nodes.select(F.col("path").alias("sibling"), module_key("path").alias("key")), "key").where("path <> sibling").select("path", "sibling")
    rest = own.join(told, "path", "left_anti").withColumn("outcome", F.lit("resolved")).join(siblings, "path", "left")
    return told.withColumn("sibling", F.lit(None).cast("string")).unionByName(rest)


def tool_loaded_orphans(changed: DataFrame, edges: DataFrame, tests: DataFrame, told: DataFrame) -> DataFrame:
    """(path): changed(path, change_type) code that nothing imports and no evidence, told(path), speaks for: a tool may load it by name."""
    loaded = ~F.col("path").contains("/") | basename("path").rlike(r"(^|[.-])(config|rc|setup|plugin|preset|transform|reporter|environment)([.-]|$)")
    some = changed.where("change_type <> 'deleted'").where(F.col("path").rlike(CODE) & ~F.col("path").rlike("(^|/)node_modules/") & loaded).select("path").distinct()
    for known in (tests.select("path"), edges.select(F.col("dst").alias("path")), told.select("path")):
        some = some.join(known.distinct(), "path", "left_anti")
    return some


def always_run(tests: DataFrame, globs: list[str], forced: DataFrame) -> DataFrame:
    """(test): tests(test) that fit one of the policy's globs, and those that are forced(test) anyway."""
    fits = F.col("test").rlike("|".join(f"(?:{test_glob(g)})" for g in globs)) if globs else F.lit(False)
    return tests.where(fits).select("test").unionByName(forced.select("test")).distinct()


def export_filter(tests: DataFrame, reach: DataFrame) -> DataFrame:
    """tests(path, test, by_name) that reach(test, path) their path by name, with those for which names say nothing; one of a path's others stays to load it if none reaches it."""
    kept = tests.where("not by_name")
    named = tests.where("by_name").join(reach.select("test", "path", F.lit(True).alias("reaches")).distinct(), ["test", "path"], "left")
    rolled = named.groupBy("path").agg(F.bool_or(F.coalesce("reaches", F.lit(False))).alias("any"), F.min("test").alias("least"))
    more = named.join(rolled, "path").where("reaches or (not any and test = least)")
    return kept.select("path", "test").unionByName(more.select("path", "test"))


def computed_load_runners(importers: DataFrame, dependents: DataFrame, tests: DataFrame, reach: DataFrame) -> DataFrame:
    """(importer, test) of importers(importer, by_name) of computed modules: the tests among them and dependents(importer, node); where names decide, those that reach the importer."""
    own = importers.join(tests.select(F.col("test").alias("importer")).distinct(), "importer", "left_semi").select("importer", F.col("importer").alias("test"))
    far = importers.join(dependents, "importer").join(tests.select(F.col("test").alias("node")).distinct(), "node", "left_semi").select("importer", "by_name", F.col("node").alias("test"))
    by_name = far.where("by_name").join(reach.select("test", F.col("path").alias("importer")).distinct(), ["importer", "test"], "left_semi")
    return own.unionByName(far.where("not by_name").select("importer", "test")).unionByName(by_name.select("importer", "test")).distinct()


def entry_points(hits: DataFrame, known: DataFrame, is_next: bool) -> DataFrame:
    """(path, kind, reasons) of hits(path, reason, ord): the profile's kind, else the one of its name, else unknown; reasons as first met."""
    first = hits.groupBy("path", "reason").agg(F.min("ord").alias("ord"))
    rolled = first.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "reason"))), lambda x: x.reason).alias("reasons"))
    return rolled.join(known.groupBy("path").agg(F.first("kind").alias("kind")), "path", "left").select("path", F.coalesce("kind", next_entry_kind("path", F.lit(is_next)), F.lit("unknown")).alias("kind"), "reasons")


def undeclared_packages(references: DataFrame, declared: DataFrame) -> DataFrame:
    """(package): packages that external references(specifier, resolution) import and that declared(name) lacks."""
    used = references.where("resolution = 'external-package'").select(package_root("specifier").alias("package")).distinct()
    return used.join(declared.select(F.col("name").alias("package")).distinct(), "package", "left_anti")


def window_start(runs: DataFrame) -> DataFrame:
    """One row (head_sha, source) of runs(ord, kind, head_sha, ancestor, recorded, passed): the newest run that left a detector's record, else the newest green full run, else none."""
    rank = F.when((F.col("kind") == "detector") & F.col("recorded"), 0).when((F.col("kind") == "full") & F.col("passed"), 1)
    best = runs.where("ancestor").withColumn("rank", rank).where("rank is not null").agg(F.min_by(F.struct("head_sha", "rank"), F.struct("rank", F.col("ord"))).alias("b"))
    return best.select(F.col("b.head_sha").alias("head_sha"), F.when(F.col("b.rank") == 0, "detector-record").when(F.col("b.rank") == 1, "green-full-run").otherwise("none").alias("source"))


def newest_receipts(receipts: DataFrame) -> DataFrame:
    """(number, artifact) of receipts(number, ord, artifact, valid): the newest valid one of each pull request; ord counts from the newest."""
    return receipts.where("valid").groupBy("number").agg(F.min_by("artifact", F.struct("ord", "artifact")).alias("artifact"))


def shard_spec(text: str | Column) -> Column:
    """`index/total` as a struct, null unless 1 <= index <= total <= 1000."""
    t = F.trim(_col(text))
    ok = t.rlike(r"^\d{1,9}/\d{1,9}$")
    i, n = (F.when(ok, F.split(t, "/")[k].cast("int")) for k in (0, 1))
    return F.when((i >= 1) & (i <= n) & (n <= 1000), F.struct(i.alias("index"), n.alias("total")))


def bounded(items: str | Column, most: int) -> Column:
    """The first `most` of an array, and how many more there are, as a struct."""
    return F.struct(F.slice(items, 1, most).alias("shown"), F.greatest(F.size(items) - most, F.lit(0)).alias("more"))


def same_json(a: str | Column, b: str | Column) -> Column:
    """Whether two JSON texts are equal but for white space between tokens; the order of keys counts."""
    tight = lambda x: F.regexp_replace(x, r'("(?:[^"\\]|\\.)*")|\s+', "$1")
    return tight(a) == tight(b)


def problems(checks: dict[str, Column]) -> Column:
    """The names of the checks that don't hold; one that is null doesn't."""
    return F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())


def legacy_test_path(path: str | Column, root: str) -> Column:
    """A test's path as recorded baselines have it: slashes, no leading ./, and relative to the root if it is below."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")
    inside = F.regexp_replace(F.regexp_replace(p, r"/\.(?=/|$)", ""), "/{2,}", "/")
    prefix = root.rstrip("/") + "/"
    return F.when(p.startswith("/") & inside.startswith(prefix) & (F.length(inside) > len(prefix)), F.substr(inside, F.lit(len(prefix) + 1))).otherwise(p)


def report_path(path: str | Column, repo: str, root: str = ".") -> Column:
    """A test's path in a report, relative to the checkout; "" if it names no file, absolute if it lies outside."""
    p = F.regexp_replace(path, r"\\", "/")
    bad = (p == "") | p.rlike(r"[\x00-\x1f\x7f]|/\.?$|(^|/)\.\.(/|$)")
    tidy = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(^|/)(\./)+", "$1"), "/{2,}", "/"), r"^\./", "")
    prefix = repo.replace("\\", "/").rstrip("/") + "/"
    absolute = p.rlike("^/|^[A-Za-z]:/")
    return F.when(bad, "").when(absolute, F.when(tidy(p).startswith(prefix), F.substr(tidy(p), F.lit(len(prefix) + 1))).otherwise(p)).when(p.rlike(r"(?i)^[a-z][a-z\d+.-]*:"), "").otherwise(tidy(F.concat(F.lit(f"{root}/"), p)))


def attribute_cases(cases: DataFrame, repo: str, root: str = ".") -> DataFrame:
    """cases(.., file, classname, suite_files, suite_names, suite_level) with `path` and `reason`: the one file that a failed case names, or why there is none."""
    explicit = F.when(F.col("file").isNotNull(), F.array("file")).otherwise(F.coalesce("suite_files", F.array().cast("array<string>")))
    meta = F.filter(F.concat(F.array("classname"), F.coalesce("suite_names", F.array().cast("array<string>"))), lambda x: x.isNotNull() & x.rlike(CODE))
    values = F.when(F.size(explicit) > 0, explicit).otherwise(meta)
    paths = F.transform(values, lambda v: report_path(v, repo, root))
    found = F.array_distinct(F.filter(paths, lambda x: x != ""))
    reason = (
        F.when(F.coalesce("suite_level", F.lit(False)), "suite-level").when(F.size(values) == 0, "no file named")
        .when(F.exists(paths, lambda x: (x == "") | x.rlike("^/|^[A-Za-z]:/")), "invalid or outside").when(F.size(found) != 1, "several files")
    )
    return cases.withColumn("reason", reason).withColumn("path", F.when(reason.isNull(), found[0]))


def reader_chain(references: DataFrame, roots: DataFrame, blockers: DataFrame, depth: int = 5, most: int = 50) -> DataFrame:
    """(root, node, depth, via): files that read a root, or read one that does, up to `depth` steps along references(reader, target).

    A root with a reader among blockers(path) is given up with the level that met it, and so is one with more than `most`
    readers; each has a row with node null, its depth, and `via` saying why.
    """
    spark = references.sparkSession
    links = store(references.select("reader", "target").distinct(), "references")
    stops = store(blockers.select(F.col("path").alias("node"), F.lit(True).alias("stop")).distinct(), "blockers")
    front = store(roots.select(F.col("path").alias("root"), F.col("path").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")).distinct(), "chain")
    paths, given_up = [front._ripplet_path], None
    for level in range(1, depth + 1):
        seen = spark.read.schema(front.schema).parquet(*paths)
        step = front.where("node is not null").join(again(links), F.col("node") == F.col("target")).where("reader <> root")
        step = step.groupBy("root", F.col("reader").alias("n")).agg(F.min("node").alias("by"))
        new = step.join(seen.select("root", F.col("node").alias("n")), ["root", "n"], "left_anti").join(again(stops).withColumnRenamed("node", "n"), "n", "left")
        total = seen.where("depth > 0 and node is not null").groupBy("root").agg(F.count("*").alias("before"))
        state = new.groupBy("root").agg(F.bool_or(F.coalesce("stop", F.lit(False))).alias("stopped"), F.count("*").alias("now")).join(total, "root", "left")
        why = F.when(F.col("stopped"), "blocked").when(F.col("now") + F.coalesce("before", F.lit(0)) > most, "too many")
        state = state.select("root", why.alias("why"))
        rows = new.join(state, "root").where("why is null").select("root", F.col("n").alias("node"), F.lit(level).alias("depth"), F.col("by").alias("via"))
        ended = state.where("why is not null").select("root", F.lit(None).cast("string").alias("node"), F.lit(level).alias("depth"), F.col("why").alias("via"))
        front = store(rows.unionByName(ended), "chain")
        if front.isEmpty():
            break
        paths.append(front._ripplet_path)
    out = spark.read.schema(front.schema).parquet(*paths).where("depth > 0")
    given_up = out.where("node is null").select("root")
    return out.where("node is not null").join(given_up, "root", "left_anti").unionByName(out.where("node is null"))


def test_universe(discovered: DataFrame, adapters: DataFrame) -> DataFrame:
    """(test): the tests that discovery or an adapter knows."""
    return discovered.select("test").unionByName(adapters.select("test")).distinct()


def compiled_projects(roots: DataFrame, configs: DataFrame, named: DataFrame, reach: DataFrame) -> DataFrame:
    """(config, test, path): files of each project that a test compiles. named(test, config) says which tests name which configuration,
    roots(config, path) what it lists; reach(node, dependency) what those import."""
    some = named.join(configs.select("config").distinct(), "config", "left_semi").distinct()
    own = roots.join(some.select("config").distinct(), "config", "left_semi").select("config", "path")
    files = own.unionByName(own.join(reach, F.col("path") == F.col("node")).select("config", F.col("dependency").alias("path"))).unionByName(some.select("config", F.col("config").alias("path"))).distinct()
    return files.join(some, "config").select("config", "test", "path")


