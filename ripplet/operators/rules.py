"""Smaller rules of the impact analysis: what paths are for, what goes with what, and how evidence is folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.functions.globs import test_glob
from ripplet.functions.paths import ancestors, basename, dirname, extension

_col = lambda x: F.col(x) if isinstance(x, str) else x


def tool_subject(path: str | Column) -> Column:
    """What a tool's configuration controls (lint, format, types, bundle, test), null for other files."""
    name = basename(path)
    return (
        F.when(name.rlike(r"^\.?eslint|^biome\.json"), "lint").when(name.rlike(r"^\.?prettier|^\.editorconfig$"), "format").when(name.rlike(r"^tsconfig.*\.json$"), "types")
        .when(name.rlike(r"^(vite|webpack|rollup|esbuild)\.config\."), "bundle").when(name.rlike(r"^(vitest|jest|playwright|cypress)\.config\.|^pytest\.ini$"), "test")
    )


def infrastructure_role(path: str | Column) -> Column:
    """definition, code, documentation or data for a file of the infrastructure; null outside it."""
    p = _col(path)
    inside = p.rlike(r"(^|/)(infra|terraform|k8s|helm|deploy)/|(^|/)Dockerfile")
    return F.when(
        inside,
        F.when(p.rlike(r"\.(tf|tfvars|ya?ml|hcl)$|(^|/)Dockerfile"), "definition").when(extension(p).isin(".ts", ".js", ".py", ".go", ".sh"), "code").when(p.rlike(r"\.(md|txt)$"), "documentation").otherwise("data"),
    )


def implicitly_loaded(path: str | Column) -> Column:
    """Files that tools load without anything that names them."""
    name = basename(path)
    return name.rlike(r"^\.env|^\.npmrc$|^\.nvmrc$|^\.node-version$|^tsconfig.*\.json$|\.config\.[cm]?[jt]s$|^conftest\.py$") | _col(path).rlike("(^|/)(__mocks__|__snapshots__)/")


def go_ignored(path: str | Column) -> Column:
    """Paths that go's own discovery leaves out."""
    return F.exists(F.split(path, "/"), lambda s: (s == "testdata") | s.rlike("^[_.]"))


def matches_suite(path: str | Column, roots: list[str], ignored: list[str], includes: list[str], excludes: list[str]) -> Column:
    """Whether a runner takes a path as a test: outside the roots no, ignored no, excluded no, included yes, else no."""
    p = _col(path)
    any_ = lambda xs, f: F.lit(False) if not xs else p.rlike("|".join(f"(?:{f(x)})" for x in xs))
    under = F.lit(True) if not roots else F.array_contains(F.transform(F.array(*(F.lit(r) for r in roots)), lambda r: p.startswith(F.concat(r, F.lit("/")))), True)
    return F.when(~under, False).when(any_(ignored, lambda x: x), False).when(any_(excludes, test_glob), False).when(any_(includes, test_glob), True).otherwise(False)


def translated_companions(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, original): documents `x.<language>.md` or `<language>/x.md` next to an original `x.md`."""
    one = F.regexp_replace("path", r"\.[a-z]{2}(-[A-Z]{2})?\.md$", ".md")
    two = F.regexp_replace("path", r"(^|/)[a-z]{2}(-[A-Z]{2})?/([^/]+\.md)$", "$1$3")
    cand = paths.select("path", F.explode(F.array(one, two)).alias("original")).where("path <> original")
    return cand.join(files.select(F.col("path").alias("original")).distinct(), "original", "left_semi").select("path", "original").distinct()


def declaration_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with those to the implementation beside each declaration file that an edge leads to."""
    beside = edges.where("dst like '%.d.ts'").select("src", F.explode(F.transform(F.array(*map(F.lit, (".js", ".mjs", ".cjs"))), lambda e: F.concat(F.regexp_replace("dst", r"\.d\.ts$", ""), e))).alias("dst"), "kind")
    return edges.select("src", "dst", "kind").unionByName(beside.join(files.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst", "kind")).distinct()


def bindings(imports: DataFrame) -> DataFrame:
    """(src, dst, whole, names) of imports(src, dst, name): `*` absorbs the names."""
    return imports.groupBy("src", "dst").agg(F.bool_or(F.col("name") == "*").alias("whole"), F.array_sort(F.collect_set("name")).alias("names")).select("src", "dst", "whole", F.when(F.col("whole"), F.array(F.lit("*"))).otherwise(F.col("names")).alias("names"))


def directory_listers(changed: DataFrame, listers: DataFrame) -> DataFrame:
    """(test, path) of listers(test, dir): tests that list a directory above a changed path."""
    return changed.select("path", F.explode(ancestors("path")).alias("dir")).join(listers, "dir").select("test", "path").distinct()


def layout_descendants(layouts: DataFrame, entries: DataFrame) -> DataFrame:
    """(layout, entry): entry points below the directory of a changed layout."""
    return entries.select(F.col("path").alias("entry"), F.explode(ancestors("path")).alias("dir")).join(layouts.select(F.col("path").alias("layout"), dirname("path").alias("dir")), "dir").where("layout <> entry").select("layout", "entry")


def risk_signals(signals: DataFrame) -> DataFrame:
    """(reason, detail): the last signal of each reason."""
    return signals.groupBy("reason").agg(F.max_by("detail", "ord").alias("detail"))


def fallback_messages(reasons: DataFrame, most: int = 5) -> DataFrame:
    """(message, ord) of reasons(ord, text, path): distinct texts as first seen, with up to `most` paths and the number of the others."""
    paths = F.array_sort(F.collect_set("path"))
    rolled = reasons.groupBy("text").agg(F.min("ord").alias("ord"), paths.alias("paths"))
    more = F.when(F.size("paths") > most, F.concat(F.lit(" (+"), (F.size("paths") - most).cast("string"), F.lit(" more)"))).otherwise("")
    return rolled.select(F.concat("text", F.lit(": "), F.array_join(F.slice("paths", 1, most), ", "), more).alias("message"), "ord")


def coverage_counts(coverage: DataFrame) -> DataFrame:
    """One row: tests, and distinct files, of a coverage map."""
    return coverage.agg(F.count_distinct("test").alias("tests"), F.count_distinct(F.when(~F.col("is_dir"), F.col("path"))).alias("files"))


def suite_split(affected: DataFrame, suite: DataFrame) -> DataFrame:
    """(test, inside): whether an affected test belongs to the suite."""
    return affected.select("test").distinct().join(suite.select("test").distinct().withColumn("inside", F.lit(True)), "test", "left").na.fill(False, ["inside"])


def added_entry_points(changed: DataFrame, known: DataFrame) -> DataFrame:
    """Added files that look like entry points of the application and that no profile has yet."""
    looks = F.col("path").rlike(r"(^|/)(app/(.*/)?(page|route|layout)|pages/(.*/)?[^/]+)\.[jt]sx?$")
    return changed.where("change_type = 'added'").where(looks).select("path").distinct().join(known.select("path"), "path", "left_anti")


def stop_decision(sessions: DataFrame, most: int = 3) -> DataFrame:
    """(session, decision) of sessions(session, verification, attempts): allow a pass, block a failure up to `most` times, then let go; what wasn't verified is unknown."""
    return sessions.select("session", F.when(F.col("verification") == "passed", "allow").when(F.col("verification").isNull() | (F.col("verification") == "blocked"), "unknown").when(F.col("attempts") < most, "block").otherwise("give-up").alias("decision"))


_RUNNERS = r"(^|[\s;&|])(vitest|jest|mocha|ava|tap|playwright test|cypress run|pytest|py\.test|go test|cargo (nextest|test)|mvn (-\S+ )*(test|verify)|gradle(w)? (-\S+ )*test|node --test|deno test|bun test|npm (run )?test|pnpm (run )?test|yarn (run )?test)\b"


def is_test_command(command: str | Column) -> Column:
    return F.coalesce(_col(command).rlike(_RUNNERS), F.lit(False))


FRAMEWORKS = {"vitest": ["vitest"], "jest": ["ts-jest", "@swc/jest", "jest"], "mocha": ["mocha"], "playwright": ["@playwright/test"], "cypress": ["cypress"], "ava": ["ava"]}


def declared_frameworks(dependencies: DataFrame) -> DataFrame:
    """(project, framework) of dependencies(project, name)."""
    rows = [(d, f) for f, ds in FRAMEWORKS.items() for d in ds]
    spark = dependencies.sparkSession
    return dependencies.join(F.broadcast(spark.createDataFrame(rows, "name string, framework string")), "name").select("project", "framework").distinct()  # a fixed list


def dependency_basis(facts: DataFrame) -> DataFrame:
    """(repository, basis) of facts(repository, fact): a lockfile pins, a frozen date boxes, else nothing is known."""
    return facts.groupBy("repository").agg(F.bool_or(F.col("fact") == "lockfile").alias("l"), F.bool_or(F.col("fact") == "date").alias("d")).select("repository", F.when(F.col("l"), "pinned").when(F.col("d"), "time-boxed").otherwise("unresolved").alias("basis"))


def global_risk(signals: DataFrame, exempt: DataFrame) -> DataFrame:
    """(signal, path) of signals(signal, path) that force everything to run: all but exempted paths (declared inputs, named tools)."""
    return signals.join(exempt.select("path").distinct(), "path", "left_anti").select("signal", "path")
