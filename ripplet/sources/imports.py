"""What JavaScript and TypeScript sources load, read from their text by expressions of the JVM.

There is no parser of the language here, so this is a documented subset: comments are blanked, string literals are kept,
and the forms below are found wherever they stand; text in a string that looks like one of them gives a reference too many,
never one too few. A load whose module is no literal is `computed`, with a pattern if its beginning names a directory.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.functions.paths import ancestors, dirname, package_root
from ripplet.runtime import MOST_BROADCAST, again, pairs, store, tasks

_STRING = r"""("[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`)"""
COMMENT = _STRING + r"|//[^\n]*+|/\*(?:(?!\*/)[\s\S])*+(?:\*/)?"
_QUOTED = r"""(?:"[^"\n]*"|'[^'\n]*')"""
FORMS = (
    r"\bimport\s+(?:type\s+)?[\w$]+\s*=\s*require\s*\(\s*" + _QUOTED + r"\s*\)"
    r"|\bimport\s*" + _QUOTED + r"|\b(?:import|export)\s[^'\"`;()]*?\bfrom\s*" + _QUOTED + r"|\bimport\.meta\.glob\s*\([^)]*\)|(?<![\w$.])(?:import|require)\s*\(\s*(?:" + _QUOTED + r"|`[^`]*`|[^)]*)"
    r"|\b(?:vi|jest)\.(?:mock|doMock|unmock|doUnmock|importActual|requireActual|importMock|requireMock)\s*\(\s*" + _QUOTED
)
ENDS = r"(?:\.[cm]?[jt]sx?|\.json|/index\.[cm]?[jt]sx?)?"
#: What a relative import may mean, in order; a compiled ending stands for its source too.
SUFFIXES = ["", *".ts .tsx .d.ts .js .jsx .mjs .cjs .json /index.ts /index.tsx /index.js /index.jsx".split()]


def without_comments(content: str | Column) -> Column:
    return F.regexp_replace(content, COMMENT, "$1")


def extract_imports(files: DataFrame) -> DataFrame:
    """(importer, ord, kind, specifier, names, computed, base, regex) of files(path, content).

    kind: import, type-import, re-export, require, dynamic-import, mock or glob. names: what is bound by name (`default` for a default
    import, `*` for a whole module), null where nothing says. base, regex: the directory and the rest that a computed specifier has.
    """
    found = files.select(F.col("path").alias("importer"), F.posexplode(F.regexp_extract_all(without_comments("content"), F.lit(FORMS), F.lit(0))).alias("ord", "s"))
    s = F.col("s")
    typed = s.rlike(r"^(?:import|export)\s+type\s+(?!from\b)[\w${*]|^import\s+type\s*\{")
    call = s.rlike(r"^(?:import|require)\s*\(")
    kind = (
        F.when(s.rlike(r"^(?:vi|jest)\."), "mock").when(s.startswith("import.meta"), "glob").when(s.rlike(r"^import\s*\("), "dynamic-import").when(s.startswith("require"), "require")
        .when(typed, "type-import").when(s.startswith("export"), "re-export").when(s.rlike(r"=\s*require"), "require").otherwise("import")
    )
    quoted = F.regexp_extract(s, r"""["']([^"'\n]*)["']\s*\)?$""", 1)
    argument = F.trim(F.regexp_extract(s, r"^[\w$.]+\s*\(\s*([\s\S]*)$", 1))
    template = F.regexp_extract(argument, "^`([^`]*)`", 1)
    # what follows a question mark is for the bundler
    cut = F.regexp_replace(template, r"\?[\s\S]*$", "")
    plain = (template != "") & ~cut.contains("${")
    computed = (call & ~argument.rlike(r"""^["']""") & ~plain) | (F.col("kind") == "glob")
    specifier = F.when(F.col("kind") == "glob", F.regexp_extract(argument, r"""^\[?\s*["'`]([^"'`]*)""", 1)).when(call & plain, cut).when(computed, F.substring(argument, 1, 200)).otherwise(F.regexp_replace(quoted, r"\?.*$", ""))
    clause = F.regexp_extract(s, r"^(?:import|export)\s+(?:type\s+)?([\s\S]*?)\s*\bfrom\b", 1)
    inner = F.regexp_extract(clause, r"\{([^}]*)\}", 1)
    items = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^type\s"))
    named = F.transform(items, lambda x: F.regexp_extract(x, r"^([\w$]+)", 1))
    default = F.regexp_extract(clause, r"^([\w$]+)\s*(?:,|$)", 1)
    names = F.when(clause == "", F.lit(None)).when(clause.contains("*"), F.array(F.lit("*"))).otherwise(F.concat(F.when(default != "", F.array(F.lit("default"))).otherwise(F.array().cast("array<string>")), named))
    rows = found.withColumn("kind", kind).select("importer", "ord", "kind", specifier.alias("specifier"), names.alias("names"), computed.alias("computed"), cut.alias("cut"))
    head = F.regexp_extract("cut", r"^([^$]*/)", 1)
    rest = F.substr("cut", F.length(head) + 1)
    literal = F.transform(F.split(rest, r"\$\{[^}]*\}"), lambda x: F.regexp_replace(x, r"([.*+?^${}()|\[\]\\/])", r"\\$1"))
    pattern = F.col("computed") & (F.col("kind") != "glob") & (head != "")
    glob = F.col("kind") == "glob"
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract("specifier", r"^[^*]*/(.*)$", 1), r"([.+^${}()|\[\]\\])", r"\\$1"), r"\*\*/", "\x01"), r"\*", "[^/]*"), "\x01", "(?:.*/)?")
    return rows.select(
        "importer", "ord", "kind", "specifier", "names", "computed",
        F.when(pattern, head).when(glob, F.regexp_extract("specifier", r"^([^*]*/)", 1)).alias("base"), F.when(pattern, F.concat(F.array_join(literal, ".*"), F.lit(ENDS))).when(glob, flat).alias("regex"),
    )


def resolved(directory: Column, relative: Column) -> Column:
    """A relative path from a directory, without `.` and `..`; null if it leaves the repository."""
    parts = F.split(F.concat_ws("/", directory, relative), "/")
    step = lambda acc, x: (
        F.when((x == "") | (x == "."), acc).when(x == "..", F.when(F.size(acc) == 0, F.lit(None)).otherwise(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))).otherwise(F.concat(acc, F.array(x)))
    )
    return F.aggregate(parts, F.array().cast("array<string>"), step, lambda acc: F.array_join(acc, "/"))


def _by_base(files: DataFrame) -> DataFrame:
    """(base, exact, found): the first of SUFFIXES that makes of a base one of files(path); exact: the path as it is.

    A file is listed under all that an import of it may say, so that a reference is one row and not one a suffix.
    """
    path, n = F.col("path"), len(SUFFIXES)
    key = lambda fits, base, rank, exact=False: F.when(fits, F.struct(base.alias("base"), F.lit(rank).alias("rank"), F.lit(exact).alias("exact")))
    cut = lambda end: F.substr(path, F.lit(1), F.length(path) - len(end))
    keys = [key(path.endswith(e), cut(e), i) for i, e in enumerate(SUFFIXES)]
    compiled = r"\.([cm]?)ts(x?)$"
    keys += [key(path.rlike(compiled), F.regexp_replace(path, compiled, ".$1js$2"), n), key(path.endswith(".tsx"), F.concat(cut(".tsx"), F.lit(".js")), n + 1), key(F.lit(True), path, 0, True)]
    listed = files.select("path", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("k"))
    return listed.groupBy(F.col("k.base").alias("base"), F.col("k.exact").alias("exact")).agg(F.min_by("path", "k.rank").alias("found"))


def resolve_imports(refs: DataFrame, files: DataFrame, aliases: list[tuple[str, str]], packages: DataFrame, builtins: tuple[str, ...] = ()) -> DataFrame:
    """refs that aren't computed with `resolved` and `resolution` (internal, external-package, builtin or unresolved).

    A specifier is relative, or fits an alias (pattern, target; both with one `*` at most; in order), or names an export of one of
    packages(name, subpath, target), subpath `.` or `./x`, or else is another's package.
    """
    refs = refs.where("not computed")
    spec, here = F.col("specifier"), dirname("importer")
    bases = [F.when(spec.rlike(r"^\.\.?(/|$)"), resolved(here, spec))]
    for pattern, target in aliases:
        head, star, tail = pattern.partition("*")
        fits = spec.startswith(head) & spec.endswith(tail) & (F.length(spec) >= len(head) + len(tail)) if star else spec == pattern
        middle = F.substr(spec, F.lit(len(head) + 1), F.length(spec) - len(head) - len(tail)) if star else F.lit("")
        before, _, after = target.partition("*")
        bases.append(F.when(fits & ~spec.startswith("."), resolved(F.lit(""), F.concat(F.lit(before), middle, F.lit(after)))))
    name = package_root("specifier")
    subpath = F.concat(F.lit("."), F.substr(spec, F.length(name) + 1))
    own = packages.select("name", "subpath", F.col("target").alias("\x01export"))
    joined = refs.withColumn("name", name).withColumn("subpath", subpath).join(own, ["name", "subpath"], "left")
    columns = refs.columns
    look = lambda base, n, exact: F.when(base.isNotNull(), F.struct(base.alias("base"), F.lit(n).alias("n"), F.lit(exact).alias("exact")))
    bases = [(b, False) for b in bases] + [(F.col("\x01export"), True)]
    keyed = joined.select(*columns, *(b.alias(f"\x01{n}") for n, (b, _) in enumerate(bases)))
    keyed = keyed.select(*columns, F.monotonically_increasing_id().alias("\x01id"), F.filter(F.array(*(look(F.col(f"\x01{n}"), n, exact) for n, (_, exact) in enumerate(bases))), lambda x: x.isNotNull()).alias("\x01look"))
    keyed = store(keyed, "references")
    have, look = store(_by_base(files).toDF("\x01base", "\x01exact", "\x01found"), "bases"), F.col("\x01look")
    # a reference without a place to look at gets a key of its own that nothing has, so that these don't meet in one task
    one = again(keyed).where(F.size(look) <= 1).withColumn("\x01base", F.coalesce(F.get(look, F.lit(0)).base, F.concat(F.lit("\x01"), F.col("\x01id").cast("string")))).withColumn("\x01exact", F.coalesce(F.get(look, F.lit(0)).exact, F.lit(False)))
    one = one.join(again(have), ["\x01base", "\x01exact"], "left").select(*columns, F.col("\x01found").alias("resolved"), (F.size(look) > 0).alias("\x01local"))
    some = again(keyed).where(F.size(look) > 1).select("\x01id", *columns, F.explode(look).alias("\x01c")).select("\x01id", *columns, F.col("\x01c.base").alias("\x01base"), F.col("\x01c.n").alias("\x01n"), F.col("\x01c.exact").alias("\x01exact"))
    some = some.join(again(have), ["\x01base", "\x01exact"], "left").groupBy("\x01id").agg(*(F.first(c).alias(c) for c in columns), F.min_by("\x01found", F.when(F.col("\x01found").isNotNull(), F.col("\x01n"))).alias("resolved"))
    out = one.unionByName(some.select(*columns, "resolved", F.lit(True).alias("\x01local")))
    local = F.col("specifier").rlike(r"^\.\.?(/|$)") | F.col("\x01local")
    kind = F.when(F.col("resolved").isNotNull(), "internal").when(F.regexp_replace("specifier", "^node:", "").isin(*builtins) | F.col("specifier").startswith("node:"), "builtin").when(local, "unresolved").otherwise("external-package")
    return out.withColumn("resolution", kind).drop("\x01local")


class Expansion(NamedTuple):
    """Computed loads that name files: loads(importer, ord, dir, regex) and, once a pattern, targets(dir, regex, path).

    Loads below one directory share their targets, and their pairs grow with the product; so they are made last or not at all.
    """

    loads: DataFrame
    targets: DataFrame

    def rows(self) -> DataFrame:
        """(importer, ord, target)"""
        return pairs(self.loads, self.targets, ["dir", "regex"]).where("path <> importer").select("importer", "ord", F.col("path").alias("target"))


def expansion(refs: DataFrame, files: DataFrame) -> Expansion:
    """What computed loads with a relative base name of files(path, usable); see `expand_computed`."""
    some = refs.where("computed and base is not null and regex is not null").where(F.col("base").rlike(r"^\.\.?/")).select("importer", "ord", "regex", resolved(dirname("importer"), F.col("base")).alias("dir"))
    some = store(some, "computed-loads")
    below = files.select("path", F.coalesce("usable", F.lit(False)).alias("usable"), F.explode(ancestors("path")).alias("dir"))
    rest = F.when(F.col("dir") == "", F.col("path")).otherwise(F.substr("path", F.length("dir") + 2))
    hit = below.join(again(some).select("dir", "regex").distinct(), "dir").where(F.regexp_like(rest, F.concat(F.lit("^(?:"), F.col("regex"), F.lit(")$"))))
    hit = store(hit.groupBy("dir", "regex", "path").agg(F.bool_and("usable").alias("usable")), "computed-targets")
    bad = F.when(~F.col("usable"), F.col("path"))
    facts = hit.groupBy("dir", "regex").agg(F.min("path").alias("least"), F.max("path").alias("most"), F.min(bad).alias("bad"), F.max(bad).alias("bad_too"))
    # the importer itself is no target of its own load
    own = lambda a, b: (F.col(a) == F.col(b)) & (F.col(a) == F.col("importer"))
    good = some.join(facts, ["dir", "regex"]).where(~own("least", "most") & (F.col("bad").isNull() | own("bad", "bad_too")))
    return Expansion(store(good.select("importer", "ord", "dir", "regex"), "expanded-loads"), again(hit).select("dir", "regex", "path"))


def expand_computed(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, ord, target) of computed loads with a relative base: the files(path, usable) below it that their pattern fits.

    A load none of whose files fit, or one of whose files can't be loaded as a module or asset, stays computed and has no row.
    """
    return expansion(refs, files).rows()


def import_edges(resolutions: DataFrame, expanded: Expansion) -> DataFrame:
    """(src, dst, kind), distinct and in order of both ends and kind: what the graph is built from.

    Edges are made distinct while a load is still one row; loads are then put in order by their importers and are spread out in place.
    """
    spark, dynamic = resolutions.sparkSession, F.lit("dynamic-import").alias("kind")
    loads, targets = again(expanded.loads).select(F.col("importer").alias("src"), "dir", "regex").distinct(), expanded.targets
    several = loads.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").select("src")
    single = store(loads.join(several, "src", "left_anti"), "single-loads")
    more = pairs(loads.join(several, "src", "left_semi"), targets, ["dir", "regex"]).where("path <> src").select("src", F.col("path").alias("dst"), dynamic)
    direct = resolutions.where("resolved is not null and resolved <> importer").select(F.col("importer").alias("src"), F.col("resolved").alias("dst"), "kind").unionByName(more).distinct()
    direct = store(direct, "direct-edges")
    twice = again(direct).where("kind = 'dynamic-import'").join(again(single), "src").join(targets.withColumnRenamed("path", "dst"), ["dir", "regex", "dst"]).select("src", "dst", "kind")
    none = F.lit(None).cast("string")
    rows = direct.join(twice, ["src", "dst", "kind"], "left_anti").select("src", "dst", "kind", none.alias("dir"), none.alias("regex")).unionByName(single.select("src", none.alias("dst"), dynamic, "dir", "regex"))
    named = store(targets, "targets")
    if named.count() <= MOST_BROADCAST:
        placed = rows.repartitionByRange(tasks(spark), "src").join(F.broadcast(again(named)), ["dir", "regex"], "left")
        return placed.select("src", F.coalesce("dst", "path").alias("dst"), "kind").where("src <> dst").sortWithinPartitions("src", "dst", "kind")
    spread = pairs(single, again(named), ["dir", "regex"]).where("path <> src").select("src", F.col("path").alias("dst"), dynamic)
    return rows.where("dst is not null").select("src", "dst", "kind").unionByName(spread).orderBy("src", "dst", "kind")


def resolution_counts(refs: DataFrame, resolutions: DataFrame, expanded: DataFrame) -> DataFrame:
    """(resolution, n): references by how they were resolved; computed ones are expanded(importer, ord) or stay computed."""
    told = expanded.select("importer", "ord").distinct().withColumn("resolution", F.lit("expanded"))
    computed = refs.where("computed").select("importer", "ord").join(told, ["importer", "ord"], "left").select(F.coalesce("resolution", F.lit("computed")).alias("resolution"))
    return resolutions.select("resolution").unionByName(computed).groupBy("resolution").agg(F.count("*").alias("n"))
