"""Joins that map changed paths to tests, files or tasks: by directory, by glob, by content, by candidate names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.functions.globs import route, task_glob
from ripplet.functions.paths import ancestors, basename, dirname
from ripplet.runtime import again, pairs, store, tasks


def nearest_ancestor(paths: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, owner) of the nearest directory above each path that owners(dir, owner) has; an equi-join on exploded ancestors.

    Paths are spread by themselves first, so that what is kept a path is a share of all, however few tasks read them.
    """
    up = paths.select("path").repartition(tasks(paths.sparkSession), "path").select("path", F.posexplode(ancestors("path")).alias("steps", "dir"))
    return up.join(owners, "dir").groupBy("path").agg(F.min_by("owner", F.struct("steps", "owner")).alias("owner"))


def under(paths: DataFrame, dirs: DataFrame) -> DataFrame:
    """(path, dir): every listed directory above each path; a range join said as an equi-join."""
    return paths.select("path", F.explode(ancestors("path")).alias("dir")).join(dirs.select("dir").distinct(), "dir").select("path", "dir")


def _matching(paths: DataFrame, globs: list[tuple[str, str]]) -> DataFrame:
    """(path, owners): the owners of the globs that fit, where there are some."""
    hits = F.filter(F.array(*(F.when(F.col("path").rlike(task_glob(g)), F.lit(o)) for o, g in globs)), lambda x: x.isNotNull())
    return paths.select("path", F.array_distinct(hits).alias("owners")).where(F.size("owners") > 0)


def glob_matches(paths: DataFrame, globs: list[tuple[str, str]]) -> DataFrame:
    """(path, owner) of paths(path) and a list of (owner, task glob).

    Patterns are a bounded list of the driver: one projection tests all of them, without a join.
    """
    return _matching(paths, globs).select("path", F.explode("owners").alias("owner"))


def declared_tests(changed: DataFrame, tests: DataFrame, declarations: list[tuple[str, str]]) -> DataFrame:
    """(path, test): tests whose glob a declaration (input glob, test glob) gives for a changed path.

    Paths meet tests by the set of declarations that they fit, so that each pair is made once and none has to be dropped.
    """
    inputs = store(_matching(changed.select("path").distinct(), [(str(i), g) for i, (g, _) in enumerate(declarations)]), "declared-inputs")
    wanted = store(_matching(tests.select("path").distinct(), [(str(i), g) for i, (_, g) in enumerate(declarations)]).toDF("test", "theirs"), "declared-tests")
    # sets of declarations, not paths: a bounded list
    met = again(inputs).select("owners").distinct().crossJoin(again(wanted).select("theirs").distinct()).where(F.arrays_overlap("owners", "theirs"))
    return pairs(inputs.join(F.broadcast(met), "owners").select("path", "theirs"), wanted, ["theirs"]).select("path", "test")


def task_triggers(changed: DataFrame, tasks: list[tuple[str, str]]) -> DataFrame:
    return glob_matches(changed, tasks).select(F.col("owner").alias("task"), "path")


def first_existing(references: DataFrame, candidates: Column, files: DataFrame) -> DataFrame:
    """references with `resolved`: the first of an array of candidate paths that files(path) has, null if none."""
    keyed = references.withColumn("key", F.xxhash64(*references.columns))
    c = keyed.select("key", F.posexplode(candidates).alias("n", "path")).join(files.select("path").distinct(), "path")
    best = c.groupBy("key").agg(F.min_by("path", "n").alias("resolved"))
    return keyed.join(best, "key", "left").drop("key")


def import_candidates(base: Column) -> Column:
    """What a relative import may mean, in order: the file, its source extensions, its index files."""
    ends = ["", *".ts .tsx .d.ts .js .jsx .mjs .cjs .json /index.ts /index.tsx /index.js".split()]
    return F.array(*(F.concat(base, F.lit(e)) for e in ends))


def coverage_additions(coverage: DataFrame, changed: DataFrame, selected: DataFrame) -> DataFrame:
    """(test, changed_file): tests whose coverage(test, path, is_dir) holds a changed path or a directory above it; the first changed file counts; selected tests don't."""
    places = changed.select("ord", "path", F.lit(False).alias("is_dir"), F.col("path").alias("place")).unionByName(changed.select("ord", "path", F.lit(True).alias("is_dir"), F.explode(ancestors("path")).alias("place")))
    hit = places.join(coverage.select("test", F.col("path").alias("place"), "is_dir"), ["place", "is_dir"])
    return hit.groupBy("test").agg(F.min_by("path", "ord").alias("changed_file")).join(selected.select("test"), "test", "left_anti")


def fixture_owners(fixtures: DataFrame, tests: DataFrame) -> DataFrame:
    """(path, test): the tests of the nearest directory above a fixture that holds tests directly."""
    n, owned = tasks(fixtures.sparkSession), tests.select(dirname("path").alias("dir"), F.col("path").alias("test"))
    up = fixtures.select("path", F.posexplode(ancestors("path")).alias("steps", "dir")).join(owned.select("dir").distinct(), "dir", "left_semi")
    # the directory is found before its tests are joined
    near = up.groupBy("path").agg(F.min_by("dir", "steps").alias("dir"))
    return near.repartition(n, "dir").join(owned.repartition(n, "dir"), "dir").select("path", "test")


def route_visits(visits: DataFrame, entries: list[tuple[str, str]]) -> DataFrame:
    """(test, entry) of visits(test, url_path) and application entries (entry, route)."""
    hits = F.filter(F.array(*(F.when(F.col("url_path").rlike(route(r)), F.lit(e)) for e, r in entries)), lambda x: x.isNotNull())
    return visits.select("test", F.explode(F.array_distinct(hits)).alias("entry")).distinct()


def visited_paths(text: str | Column) -> Column:
    """Paths of `goto('...')` and `visit("...")` calls and of href attributes, without host, query and fragment."""
    c = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(c, F.lit(r"""(?:(?:goto|visit)\(\s*['"`]|href=["'])([^'"`?#]*)"""), F.lit(1))
    return F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"^\w+://[^/]*", "")), lambda u: u.startswith("/"))


_LEFT, _INNER, _RIGHT = r"""["'`\s=(]""", r"""[^"'`\s=(),;:]""", r"""["'`\s),;:]"""


def reference_tokens(targets: DataFrame, above: bool) -> DataFrame:
    """(target, token, bare, last) of targets(path): what names a file: its path, its base name and, if asked for, the directories above and their names.

    bare: a token without dot or slash, which prose has too; last: its last segment.
    """
    base = F.array("path", basename("path"))
    dirs = F.filter(ancestors("path"), lambda d: d != "")
    tokens = F.concat(base, dirs, F.transform(dirs, lambda d: F.regexp_extract(d, "([^/]*)$", 1))) if above else base
    t = targets.select(F.col("path").alias("target"), F.explode(F.array_distinct(tokens)).alias("token"))
    return t.select("target", "token", ~F.col("token").rlike("[./]"), F.regexp_extract("token", "([^/]*)$", 1)).toDF("target", "token", "bare", "last")


def content_references(files: DataFrame, targets: DataFrame, above: bool = False) -> DataFrame:
    """(reader, target) of files(path, content) that name targets(path), themselves excluded.

    A token counts between quotes, slashes, white space and the like; a bare one only between quotes or slashes. Texts are cut at
    such places into pieces, which meet the tokens by their segments: an inverted index in place of the product of files and
    targets. The whole token is then looked for in the piece.
    """
    piece = rf"(?:^|{_LEFT}){_INNER}+(?={{}})"

    def ending(end: str, quoted: bool) -> Column:
        found = F.array_distinct(F.regexp_extract_all("content", F.lit(f"(?m){piece.format(end)}"), F.lit(0)))
        return F.transform(found, lambda x: F.struct(x.alias("piece"), F.lit(quoted).alias("quoted")))

    found = F.concat(ending(rf"$|{_RIGHT}", False), ending("[\"'`]", True))
    pieces = files.select(F.col("path").alias("reader"), F.explode(found).alias("f")).select("reader", F.regexp_replace("f.piece", f"^{_LEFT}", "").alias("piece"), F.col("f.piece").rlike("^[\"'`]").alias("opened"), F.col("f.quoted").alias("closed"))
    words = pieces.select("*", F.explode(F.array_distinct(F.split("piece", "/"))).alias("last")).where("last <> ''")
    whole = F.concat(F.lit("/"), "piece", F.lit("/"))
    inside = whole.contains(F.concat(F.lit("/"), "token", F.lit("/")))
    first, end = F.col("piece").startswith(F.concat("token", F.lit("/"))), F.col("piece").endswith(F.concat(F.lit("/"), "token"))
    bare = F.col("piece").contains(F.concat(F.lit("/"), "token", F.lit("/"))) | (F.col("opened") & first) | (F.col("closed") & end) | (F.col("opened") & F.col("closed") & (F.col("piece") == F.col("token")))
    hit = words.join(reference_tokens(targets, above), "last").where("reader <> target").where(F.when(F.col("bare"), bare).otherwise(inside))
    return hit.select("reader", "target").distinct()


def path_baseline(changed: DataFrame, tests: DataFrame) -> DataFrame:
    """(test, reason): what a selector that knows only paths would run.

    Documents alone: nothing. A manifest, CI or database path, a path no test directory is above, or no scope: all tests.
    """
    docs = F.col("path").rlike(r"(?i)\.(md|mdx|txt|rst)$") | F.col("path").rlike("^docs/")
    hard = F.col("path").rlike(r"(^|/)(pom[.]xml|Cargo[.]toml|go[.]mod|yarn[.]lock|package(-lock)?[.]json|pnpm-lock[.]yaml)$|^\.github/|(^|/)(migrations|prisma|db|infra|terraform|k8s)/|(^|/)Dockerfile")
    flags = changed.agg(F.coalesce(F.bool_and(docs), F.lit(True)).alias("docs"), F.coalesce(F.bool_or(hard), F.lit(False)).alias("hard"), F.count_if(~docs).alias("code"))
    rows = changed.where(~docs).select("path")
    scopes = tests.select(dirname("path").alias("dir")).where("dir <> ''").distinct().withColumn("owner", F.col("dir"))
    near = nearest_ancestor(rows, scopes)
    scoped = near.agg(F.count_distinct("path").alias("scoped"))
    hit = under(tests.select("path"), near.select(F.col("owner").alias("dir"))).select("path").distinct().withColumn("hit", F.lit(True))
    mode = F.when(F.col("docs"), "none").when(F.col("hard") | (F.col("scoped") < F.col("code")), "all").otherwise("scope")
    out = tests.select("path").distinct().crossJoin(flags).crossJoin(scoped).join(hit, "path", "left").withColumn("mode", mode)  # both are one row
    return out.where("mode = 'all' or (mode = 'scope' and hit)").select(F.col("path").alias("test"), F.col("mode").alias("reason"))


def longest_prefix(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, package): the deepest package root above each path; a path without one is left out (see `unrouted`)."""
    return nearest_ancestor(paths, packages.select(F.col("root").alias("dir"), F.col("package").alias("owner"))).withColumnRenamed("owner", "package")


def unrouted(paths: DataFrame, packages: DataFrame) -> DataFrame:
    return paths.select("path").join(longest_prefix(paths, packages), "path", "left_anti")


def external_importers(references: DataFrame, changed_packages: DataFrame) -> DataFrame:
    """(importer, package): files whose bare specifier belongs to a changed package."""
    from ripplet.functions.paths import package_root

    return references.select("importer", package_root("specifier").alias("package")).join(changed_packages.select("package").distinct(), "package", "left_semi").distinct()
