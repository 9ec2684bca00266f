"""Operators over a directed file graph: edges(src, dst, kind), `src` depends on `dst`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplet.runtime import again, discard, pairs, store

MAX_LEVELS = 10_000
#: Hubs looked for at most; a matter of speed alone, roots without one are walked.
HUBS = 8


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def runtime_only(edges: DataFrame) -> DataFrame:
    """Without the edges that only types take."""
    return edges.where("kind <> 'type-import'")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root, node): what each node depends on directly."""
    return nodes.select(F.col("node").alias("root")).join(edges.select(F.col("src").alias("root"), F.col("dst").alias("node")).distinct(), "root")


def closure(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, node, depth): all that is reachable from each root's seeds(root, node), with the least number of steps.

    A frontier joins the edges and loses what was reached before, level by level, until it is empty; cycles so end.
    The seeds themselves have depth 0.
    """
    spark = edges.sparkSession
    links = store(edges.select("src", "dst").distinct(), "edges")
    front = store(seeds.select("root", "node").distinct().withColumn("depth", F.lit(0)), "level")
    paths, level = [front._ripplet_path], 0
    while not front.isEmpty() and (depth is None or level < depth):
        level += 1
        if level > MAX_LEVELS:
            raise RuntimeError(f"no end after {MAX_LEVELS} levels")
        seen = spark.read.schema(front.schema).parquet(*paths).select("root", "node")
        step = front.join(again(links), F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        front = store(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(level)), "level")
        paths.append(front._ripplet_path)
    discard(links)
    return spark.read.schema(front.schema).parquet(*paths)


def shortest_paths(edges: DataFrame, roots: DataFrame, depth: int = 8) -> DataFrame:
    """(root, node, path): one shortest path from each root, as a queue that takes neighbours in sorted order would find it."""
    spark = edges.sparkSession
    links = store(edges.select("src", "dst").distinct(), "edges")
    front = store(roots.select("root", F.col("root").alias("node"), F.array("root").alias("path"), F.lit(1).cast("long").alias("rank")), "level")
    paths = [front._ripplet_path]
    for _ in range(depth):
        seen = spark.read.schema(front.schema).parquet(*paths).select("root", "node")
        step = front.join(again(links), F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.col("rank").alias("parent"), F.concat("path", F.array("dst")).alias("path"))
        first = step.groupBy("root", "node").agg(F.min_by("path", "parent").alias("path"), F.min("parent").alias("parent")).join(seen, ["root", "node"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("root").orderBy("parent", "node")).cast("long")
        front = store(first.select("root", "node", "path", rank.alias("rank")), "level")
        if front.isEmpty():
            break
        paths.append(front._ripplet_path)
    return spark.read.schema(front.schema).parquet(*paths).select("root", "node", "path")


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of nodes by kind and of edges, dangling edge ends and isolated nodes."""
    ends = edges.select(F.col("src").alias("path")).unionByName(edges.select(F.col("dst").alias("path"))).distinct()
    dangling = edges.join(nodes.select(F.col("path").alias("dst")), "dst", "left_anti").unionByName(edges.join(nodes.select(F.col("path").alias("src")), "src", "left_anti").select(edges.columns))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        nodes.agg(F.count("*").alias("nodes"), F.count_if("is_source").alias("sources"), F.count_if("is_asset").alias("assets"), F.count_if("is_test").alias("tests")),
        count(edges, "edges"), count(dangling, "critical"), count(nodes.select("path").join(ends, "path", "left_anti"), "isolated"),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # every part is one row


def confidence(facts: DataFrame) -> DataFrame:
    """One row of facts(sources, critical, dynamic, unresolved, references) -> confidence, worst first."""
    return facts.select(
        F.when(F.col("sources") == 0, "UNSAFE").when(F.col("critical") > 0, "UNSAFE").when(F.col("dynamic") > 0, "UNSAFE").when(F.col("unresolved") > 0, "UNSAFE").when(F.col("references") > 0, "PARTIAL").otherwise("COMPLETE").alias("confidence")
    )


def delta_confidence(unresolved: DataFrame, changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, blocking) of each changed node: unresolved(importer, computed) importers that could hide a dependent of it.

    An unresolved importer matters if it is not computed, is the changed node or is reachable from it in either
    direction, and is not its dependent anyway.
    """
    seeds = changed.select(F.col("path").alias("root"), F.col("path").alias("node"))
    down, up = closure(edges, seeds), closure(reverse(edges), seeds)
    near = down.select("root", "node").unionByName(up.select("root", "node")).distinct()
    own = unresolved.where("not computed").select(F.col("importer").alias("node")).distinct()
    hidden = near.join(own, "node").join(up.where("depth > 0").select("root", "node"), ["root", "node"], "left_anti")
    return changed.select(F.col("path").alias("root")).join(hidden.groupBy("root").agg(F.count("*").alias("n")), "root", "left").select("root", F.coalesce("n", F.lit(0)).alias("blocking"))


def export_reach(bindings: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, path, name): the exports that each root's seeds(root, path, name) reach through bindings(path, name, target, imported).

    A binding says that `name` of `path` comes from `imported` of `target`; the name `*` stands for a whole module, which
    reaches all its bindings.
    """
    spark = bindings.sparkSession
    own = store(bindings.select(F.col("path").alias("p"), F.col("name").alias("n"), F.col("target").alias("t"), F.col("imported").alias("i")).distinct(), "bindings")
    front = store(seeds.select("root", "path", "name").distinct(), "reach")
    paths = [front._ripplet_path]
    while not front.isEmpty():
        seen = spark.read.schema(front.schema).parquet(*paths)
        step = front.join(again(own), (F.col("path") == F.col("p")) & ((F.col("name") == F.col("n")) | (F.col("name") == "*") | (F.col("n") == "*")))
        step = step.select("root", F.col("t").alias("path"), F.when((F.col("n") == "*") & (F.col("i") == "*"), F.col("name")).otherwise(F.col("i")).alias("name")).distinct()
        front = store(step.join(seen, ["root", "path", "name"], "left_anti"), "reach")
        paths.append(front._ripplet_path)
    return spark.read.schema(front.schema).parquet(*paths)


def body_edges(runtime: DataFrame, imports: DataFrame, modules: DataFrame, forwards: DataFrame, stars: DataFrame, type_imports: DataFrame | None = None) -> DataFrame:
    """(path, target, name): what running a module's body loads of each runtime(path, target) dependency, `*` for the whole.

    A target from which imports(path, target, name) take names counts by these if modules(path, plain) says that loading it does
    nothing else (plain); one that is only re-exported then isn't loaded at all. Where types are checked as tests run,
    a target of type_imports(path, target) counts as a whole.
    """
    plain = modules.where("plain").select(F.col("path").alias("target"), F.lit(True).alias("plain")).distinct()
    named = imports.groupBy("path", "target").agg(F.collect_set("name").alias("names"))
    passed = forwards.select("path", "target").unionByName(stars.select("path", "target")).distinct().withColumn("passed", F.lit(True))
    r = runtime.select("path", "target").distinct().join(plain, "target", "left").join(named, ["path", "target"], "left").join(passed, ["path", "target"], "left")
    typed = F.lit(False)
    if type_imports is not None:
        r = r.join(type_imports.select("path", "target", F.lit(True).alias("typed")).distinct(), ["path", "target"], "left")
        typed = F.coalesce("typed", F.lit(False))
    whole = typed | (F.col("names").isNull() & F.col("passed").isNull()) | F.col("plain").isNull() | F.array_contains("names", "*")
    names = F.when(whole, F.array(F.lit("*"))).otherwise(F.coalesce("names", F.array().cast("array<string>")))
    return r.select("path", "target", F.explode(names).alias("name"))


def module_reach(modules: DataFrame, own: DataFrame, forwards: DataFrame, stars: DataFrame, body: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, path, name): the exports, `*` for all of a module, that each of roots(path) makes its imports reach.

    modules(path, plain): plain modules do nothing but define, so that one export of them can be taken alone; all others, and
    modules without a row, count as a whole. own(path, name) are the exports that a module defines, forwards(path, name, target,
    imported) those that it passes on by name (`imported` is `*` for a namespace), stars(path, target) what it passes on as a
    whole, and body what its body loads (`body_edges`). A name is looked for among the own ones, whose body then runs; among the
    forwards; and behind the stars that can have it. A name that is nowhere takes the whole module.
    """
    spark = modules.sparkSession
    plain = store(modules.where("plain").select("path").distinct(), "plain-modules")
    fwd = store(forwards.join(again(plain), "path", "left_semi").select("path", "name", "target", "imported").distinct(), "forwards")
    star = store(stars.join(again(plain), "path", "left_semi").select("path", "target").distinct(), "stars")
    mine = store(own.join(again(plain), "path", "left_semi").select("path", "name").distinct(), "own-exports")
    bodies = store(body.select("path", "target", F.col("name").alias("taken")).distinct(), "bodies")
    whole = store(again(bodies).unionByName(forwards.select("path", "target", F.lit("*").alias("taken"))).unionByName(stars.select("path", "target", F.lit("*").alias("taken"))).distinct(), "wholes")
    # what lies behind each star, star after star: the names there, or a module of which anything may come
    behind = closure(again(star).select(F.col("path").alias("src"), F.col("target").alias("dst")), again(star).select(F.col("target").alias("root"), F.col("target").alias("node")).distinct()).select("root", F.col("node").alias("path"))
    behind = store(behind, "behind-stars")
    said = again(mine).unionByName(again(fwd).select("path", "name")).distinct()
    can = store(again(behind).join(said, "path").select(F.col("root").alias("target"), "name").distinct(), "behind-names")
    open_ = store(again(behind).join(again(plain), "path", "left_anti").select(F.col("root").alias("target")).distinct(), "behind-open")
    # which names of which modules lead on to which: the same for all roots, so each is followed once
    front = store(roots.select("path", F.lit("*").alias("name")).distinct(), "module-states")
    states, steps = [front._ripplet_path], []
    mark = lambda df, name, *keys: again(df).select(*keys).distinct().withColumn(name, F.lit(True))
    taken = lambda df, path, name: df.select(F.struct("path", "name").alias("src"), F.struct(F.col(path).alias("path"), F.col(name).alias("name")).alias("dst"))
    while not front.isEmpty():
        f = front.join(mark(plain, "is_plain", "path"), "path", "left").join(mark(mine, "is_own", "path", "name"), ["path", "name"], "left").join(mark(fwd, "is_passed", "path", "name"), ["path", "name"], "left")
        kind = F.when((F.col("name") == "*") | F.col("is_plain").isNull(), "whole").when(F.col("is_own"), "body").when(F.col("is_passed"), "passed").otherwise("star")
        f = f.select("path", "name", kind.alias("kind"))
        by_star = f.where("kind = 'star'").join(again(star), "path")
        by_star = by_star.join(mark(can, "has", "target", "name"), ["target", "name"], "left").join(mark(open_, "any", "target"), "target", "left").where("has or any").select("path", "name", "target")
        nowhere = f.where("kind = 'star'").join(by_star.select("path", "name").distinct(), ["path", "name"], "left_anti")
        step = taken(f.where("kind = 'body'").join(again(bodies), "path"), "target", "taken")
        step = step.unionByName(taken(f.where("kind = 'whole'").unionByName(nowhere).join(again(whole), "path"), "target", "taken"))
        step = step.unionByName(taken(f.where("kind = 'passed'").join(again(fwd), ["path", "name"]), "target", "imported")).unionByName(taken(by_star, "target", "name"))
        step = store(step.distinct(), "module-steps")
        steps.append(step._ripplet_path)
        seen = spark.read.schema(front.schema).parquet(*states)
        front = store(step.select("dst.path", "dst.name").distinct().join(seen, ["path", "name"], "left_anti").select(*front.columns), "module-states")
        states.append(front._ripplet_path)
    if not steps:
        return front.select(F.col("path").alias("root"), "path", "name")
    edges = spark.read.schema(step.schema).parquet(*steps)
    start = roots.select(F.col("path").alias("root"), F.struct("path", F.lit("*").alias("name")).alias("node")).distinct()
    return reach(edges, start).select("root", "node.path", "node.name")


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, node): all that is reachable from each root's seeds(root, node); for graphs in which most roots reach the same nodes.

    What lies behind a hub, a node that much comes to and goes from, is searched once for all roots that reach the hub. Those roots
    are then walked only as far as they are outside of it, and the rest is a join of two lists that needs no shuffle of its rows.
    """
    spark = edges.sparkSession
    links = store(edges.select("src", "dst").distinct(), "links")
    begin = store(seeds.select("root", "node").distinct(), "seeds")
    size = links.count()
    ins, outs = again(links).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("a")), again(links).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("b"))
    left = store(ins.join(outs, "node").select("node", (F.col("a") * F.col("b")).alias("weight")), "hub-weights")
    covered, assigned = [], []
    for n in range(HUBS):
        hub = store(left.orderBy(F.desc("weight"), "node").limit(1), "hub")
        if hub.isEmpty():
            break
        one = again(hub).select(F.lit(n).alias("root"), "node")
        after, before = closure(again(links), one).select("node"), closure(reverse(again(links)), one).select("node")
        after, before = store(after, "after-hub"), store(before, "before-hub")
        met = store(again(begin).join(again(before), "node", "left_semi").select("root").distinct(), "roots-of-hub")
        many, behind = met.count(), after.count()
        if many * behind < size:  # it saves too little to look for more
            break
        covered.append(again(after).select(F.lit(n).alias("hub"), "node"))
        assigned.append(again(met).select("root", F.lit(n).alias("hub"), F.lit(behind).alias("behind")))
        left = store(left.join(again(after), "node", "left_anti").join(again(before), "node", "left_anti"), "hub-weights")
        if again(begin).select("root").distinct().join(reduce(DataFrame.unionByName, (a.select("root") for a in assigned)), "root", "left_anti").isEmpty():
            break
    if not covered:
        return closure(links, begin).select("root", "node")
    cover = store(reduce(DataFrame.unionByName, covered), "behind-hubs")
    of = store(reduce(DataFrame.unionByName, assigned).groupBy("root").agg(F.max_by("hub", F.struct("behind", "hub")).alias("hub")), "hubs-of-roots")
    front = store(again(begin).join(again(of), "root", "left").join(again(cover), ["hub", "node"], "left_anti").select("root", "node", "hub"), "walk")
    paths = [front._ripplet_path]
    while not front.isEmpty():
        step = front.join(again(links), F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), "hub").distinct().join(again(cover), ["hub", "node"], "left_anti")
        seen = spark.read.schema(front.schema).parquet(*paths).select("root", "node")
        front = store(step.join(seen, ["root", "node"], "left_anti").select("root", "node", "hub"), "walk")
        paths.append(front._ripplet_path)
    return spark.read.schema(front.schema).parquet(*paths).select("root", "node").unionByName(pairs(of, cover, ["hub"]).select("root", "node"))
