"""JSON documents with a schema tag: outcome logs, timings, coverage maps, specifications, lockfiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOME_SCHEMA, TIMINGS_SCHEMA = "ripplet.outcome.v1", "ripplet.timings.v1"
OUTCOME = (
    "schema string, seq long, produced_at string, tree_sha string, tool string, runtime string, selection string, verification string, selected_tests array<string>, fallback_reasons array<string>, tests_ms double, "
    "command string, agent string, reused_from string, checks array<struct<id:string,status:string,command:string>>, test_results array<struct<file:string,status:string,ms:double>>"
)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an append-only outcome log; lines that aren't JSON or have another schema tag are left out."""
    raw = spark.read.text(path).withColumn("o", F.from_json("value", OUTCOME, {"mode": "PERMISSIVE"}))
    return raw.where(F.col("o.schema") == OUTCOME_SCHEMA).select("o.*").withColumn("produced_at", F.try_to_timestamp("produced_at"))


def append_outcomes(records: DataFrame, path: str) -> None:
    """One JSON object a line, added to the log."""
    records.withColumn("schema", F.lit(OUTCOME_SCHEMA)).write.mode("append").json(path)


def outcome_tests(outcomes: DataFrame) -> DataFrame:
    """(seq, pos, test, failed, ms): the results of every run."""
    return outcomes.select("seq", F.posexplode("test_results").alias("pos", "r")).select("seq", "pos", F.col("r.file").alias("test"), (F.col("r.status") == "failed").alias("failed"), "r.ms")


def read_timings(texts: DataFrame, column: str) -> DataFrame:
    """(test, ms) of timings documents; a negative or non-finite duration is an error, as is another schema tag."""
    d = F.from_json(column, "schema string, files map<string,double>")
    bad = F.coalesce(d.schema != TIMINGS_SCHEMA, F.lit(True)) | d.files.isNull() | F.exists(F.map_values(d.files), lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf")))
    checked = texts.select(F.when(bad, F.raise_error(F.lit("not a timings document"))).otherwise(d.files).alias("files"))
    return checked.select(F.explode("files").alias("test", "ms"))


def timings_document(timings: DataFrame) -> DataFrame:
    """One row with the JSON text of (test, ms)."""
    files = F.map_from_entries(F.array_sort(F.collect_list(F.struct("test", "ms"))))
    return timings.agg(F.to_json(F.struct(F.lit(TIMINGS_SCHEMA).alias("schema"), files.alias("files"))).alias("value"))


def read_coverage(texts: DataFrame, column: str) -> DataFrame:
    """(test, path, is_dir) of a coverage map; paths that end in a slash are directories."""
    m = F.from_json(column, "tests map<string,array<string>>").tests
    rows = texts.select(F.explode(m).alias("test", "paths")).select("test", F.explode("paths").alias("p"))
    return rows.select("test", F.regexp_replace("p", "/$", "").alias("path"), F.col("p").endswith("/").alias("is_dir")).distinct()


def read_specs(texts: DataFrame, column: str) -> DataFrame:
    """(spec, target): an array of specifications, or an object that holds one."""
    spec = "array<struct<id:string,targets:array<string>>>"
    rows = F.coalesce(F.from_json(column, f"specifications {spec}").specifications, F.from_json(column, spec))
    return texts.select(F.explode(rows).alias("s")).select(F.col("s.id").alias("spec"), F.explode("s.targets").alias("target"))


def read_npm_lock(texts: DataFrame, side: str, column: str) -> DataFrame:
    """(side, key, fp): install paths and fingerprints of npm lockfiles from version 2 on; others give the single row (side, null, null): unknown."""
    d = F.from_json(column, "lockfileVersion int, packages map<string,struct<version:string,resolved:string,integrity:string,link:boolean,dependencies:map<string,string>>>")
    known = F.coalesce((d.lockfileVersion >= 2) & d.packages.isNotNull(), F.lit(False))
    rows = texts.select(F.col(side), F.explode(F.when(known, F.map_entries(d.packages)).otherwise(F.array(F.lit(None)))).alias("e"))
    return rows.select(side, F.col("e.key").alias("key"), F.when(F.col("e").isNotNull(), F.to_json("e.value")).alias("fp"))


def npm_edges(texts: DataFrame, side: str, column: str) -> DataFrame:
    """(side, src, dst): each dependency at the nearest install above its dependent, as node resolves it."""
    d = F.from_json(column, "packages map<string,struct<dependencies:map<string,string>>>").packages
    nodes = texts.select(F.col(side), F.explode(d).alias("src", "v"))
    wants = nodes.select(side, "src", F.explode(F.map_keys("v.dependencies")).alias("name"))
    parts = F.split("src", "/node_modules/")
    up = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/node_modules/"))
    cand = wants.select(side, "src", "name", F.posexplode(F.array_distinct(F.concat(up, F.array(F.lit(""))))).alias("n", "dir"))
    cand = cand.withColumn("dst", F.when(F.col("dir") == "", F.concat(F.lit("node_modules/"), "name")).otherwise(F.concat_ws("/node_modules/", "dir", "name")))
    hit = cand.join(nodes.select(side, F.col("src").alias("dst")), [side, "dst"])
    return hit.groupBy(side, "src", "name").agg(F.min_by("dst", "n").alias("dst")).select(side, "src", "dst")


def cache_key(*columns: str):
    """The key of a cached result: the SHA-256 of the named columns' JSON."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
