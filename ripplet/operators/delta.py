"""What a change set is: kinds, categories, signals, and differences between two versions of keyed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.functions.paths import basename, dirname, extension
from ripplet.functions.values import let

CHANGE_TYPES = {"A": "added", "C": "copied", "D": "deleted", "M": "modified", "R": "renamed", "T": "type-changed", "U": "unmerged"}
SOURCE = ".rs .go .py .vue .ts .tsx .mts .cts .js .jsx .mjs .cjs".split()
ASSETS = ".css .scss .less .svg .png .jpg .gif .webp .woff2 .ico".split()
LOCKFILES = "go.sum Cargo.lock bun.lockb yarn.lock pnpm-lock.yaml package-lock.json".split()


def change_kind(status: str | Column) -> Column:
    """The first letter of a status code; what isn't known counts as modified."""
    letter = F.substring(status, 1, 1)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in CHANGE_TYPES.items() for x in kv)), letter), F.lit("modified"))


def change_paths(changed: DataFrame) -> DataFrame:
    """(ord, path): both sides of a rename."""
    return changed.select("ord", F.explode(F.array_compact(F.array("path", "old_path"))).alias("path"))


def reasons(change_type: str | Column) -> Column:
    c = F.col(change_type) if isinstance(change_type, str) else change_type
    return F.array_compact(F.array(F.lit("DIRECT_CHANGE"), F.when(c == "deleted", F.lit("DELETED_FILE")), F.when(c == "renamed", F.lit("RENAMED_FILE"))))


def is_test(path: str | Column) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return p.rlike(r"[.](spec|test)[.][cm]?[jt]sx?$|_test[.](go|py)$|(^|/)test_[^/]*[.]py$|(^|/)__tests__/")


def category(path: str | Column) -> Column:
    """One of the twelve categories; the order of the questions is part of the answer."""
    p = F.col(path) if isinstance(path, str) else path
    name, ext = basename(p), extension(p)
    return (
        F.when(name.isin("AGENTS.md", "CLAUDE.md", ".cursorrules"), "docs")
        .when(name.isin("package.json", "tsconfig.json", *LOCKFILES) | name.rlike(r"\.config\.[cm]?[jt]s$|^\.?(eslint|prettier|babel)rc"), "config")
        .when(p.rlike(r"^\.github/workflows/|(^|/)(infra|terraform|k8s|helm)/|(^|/)Dockerfile|docker-compose"), "infrastructure")
        .when(p.rlike(r"(^|/)(migrations|prisma)/") | ext.isin(".sql", ".prisma"), "database")
        .when(ext.isin(*SOURCE) & is_test(p), "test")
        .when(ext.isin(*SOURCE) & p.rlike("(^|/)scripts/"), "script")
        .when(ext.isin(*SOURCE) & p.rlike(r"(^|/)(pages|app)/.*(page|route|layout)\.[jt]sx?$"), "entry-point")
        .when(ext.isin(*SOURCE), "source")
        .when(ext.isin(*ASSETS), "asset")
        .when(ext.isin(".md", ".mdx", ".rst") | p.rlike("(^|/)docs?/"), "docs")
        .when(p.rlike("(^|/)(fixtures|__fixtures__|testdata|__snapshots__)/"), "test-fixture")
        .otherwise("unknown")
    )


def signal(path: str | Column) -> Column:
    """The delta signal of a path, null for none."""
    p = F.col(path) if isinstance(path, str) else path
    name, ext = basename(p), extension(p)
    return (
        F.when(name.isin(*LOCKFILES), "lockfile").when(name.isin("package.json", "go.mod", "Cargo.toml", "pom.xml"), "dependencyManifest").when(p.rlike(r"^\.github/workflows/|\.gitlab-ci\.yml$"), "workflow")
        .when(p.rlike(r"(^|/)(infra|terraform|k8s|helm)/|(^|/)Dockerfile"), "infrastructure").when(ext.isin(".sql", ".prisma") | p.rlike("(^|/)migrations/"), "database").when(name.rlike(r"^tsconfig.*\.json$|\.config\.[cm]?[jt]s$"), "config")
    )


def signals(changed: DataFrame) -> DataFrame:
    """(signal, paths): sorted distinct paths of each signal that occurs, from both sides of renames."""
    return change_paths(changed).select(signal("path").alias("signal"), "path").where("signal is not null").groupBy("signal").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def summary(changed: DataFrame) -> DataFrame:
    """One row: how many files each kind of change has, and all."""
    return changed.agg(F.count("*").alias("total"), *(F.count_if(F.col("change_type") == t).alias(t.replace("-", "_")) for t in CHANGE_TYPES.values()))


def directories(changed: DataFrame) -> DataFrame:
    return changed.select(dirname("path").alias("dir")).distinct()


def keyed_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change) of before and after(key, fp): added, removed or changed keys; null fingerprints are values."""
    b = before.select("key", F.col("fp").alias("b"), F.lit(True).alias("was"))
    a = after.select("key", F.col("fp").alias("a"), F.lit(True).alias("now"))
    j = b.join(a, "key", "full_outer").where("was is null or now is null or not (a <=> b)")
    return j.select("key", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


#: Fields of a manifest by what a change of them may affect, worst last.
MANIFEST_FIELDS = {"dependencies": "dependencies", "devDependencies": "dependencies", "peerDependencies": "dependencies", "scripts": "scripts", "exports": "resolution", "main": "resolution", "type": "resolution", "workspaces": "resolution"}


def manifest_change(before: str | Column, after: str | Column) -> Column:
    """none, metadata, dependencies, scripts or resolution: the worst change between two manifests' top-level fields; text that isn't a JSON object is resolution."""
    kinds = F.create_map(*(F.lit(x) for kv in MANIFEST_FIELDS.items() for x in kv))

    def worst(m):
        changed = F.filter(F.array_union(F.map_keys(m.b), F.map_keys(m.a)), lambda k: ~F.try_element_at(m.b, k).eqNullSafe(F.try_element_at(m.a, k)))
        found = F.transform(changed, lambda k: F.coalesce(F.try_element_at(kinds, k), F.lit("metadata")))
        return F.when(m.b.isNull() | m.a.isNull(), "resolution").otherwise(let(found, ranked))

    def ranked(found):
        has = lambda k: F.array_contains(found, k)
        return F.when(F.size(found) == 0, "none").when(has("resolution"), "resolution").when(has("scripts"), "scripts").when(has("dependencies"), "dependencies").otherwise("metadata")

    # each text is parsed once
    return let(F.struct(*(F.from_json(x, "map<string,string>").alias(n) for n, x in (("b", before), ("a", after)))), worst)


def word_edit(before: str | Column, after: str | Column) -> Column:
    """The words that a command gained and lost."""
    b, a = (F.filter(F.split(x, r"\s+"), lambda w: w != "") for x in (before, after))
    return F.struct(F.array_except(a, b).alias("added"), F.array_except(b, a).alias("removed"))


def affected_roots(roots: DataFrame, reach: DataFrame, changed: DataFrame) -> DataFrame:
    """(root, affected) of roots(root), reach(root, key), changed(key); the single row (null, false) if a changed key is reached by no root: it can't be attributed."""
    hit = reach.join(changed.select("key").distinct(), "key", "left_semi").select("root").distinct()
    lost = changed.select("key").distinct().join(reach.select("key").distinct(), "key", "left_anti").agg((F.count("*") > 0).alias("lost"))
    out = roots.select("root").distinct().join(hit.withColumn("hit", F.lit(True)), "root", "left").crossJoin(lost)  # lost is one row
    return out.where("not lost").select("root", F.coalesce("hit", F.lit(False)).alias("affected")).unionByName(lost.where("lost").select(F.lit(None).cast(roots.schema["root"].dataType).alias("root"), F.lit(False).alias("affected")))
