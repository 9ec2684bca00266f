import json

import pytest
from pyspark.sql import functions as F

from ripplet.operators.delta import affected_roots, keyed_diff
from ripplet.operators.graph import closure
from ripplet.operators.verdicts import merged_cases
from ripplet.sources import documents as doc
from ripplet.sources import git, junit, runner_output
from ripplet.streaming.outcomes import failure_windows, refresh_history, stream_outcomes


def test_name_status_and_numstat(spark):
    raw = b"A\0p\0R087\0old\0new\0M\0\xc3\xa9.ts\0"
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b""))], "commit int, raw binary")
    got = [tuple(r) for r in git.read_name_status(df, "commit", "raw").orderBy("ord").collect()]
    assert got == [(1, 0, "A", None, "p", None), (1, 1, "R", 87, "new", "old"), (1, 2, "M", None, "é.ts", None)]
    stats = spark.createDataFrame([(1, bytearray(b"1\t2\tp\0-\t-\tbin\0" + b"1\t1\t\0old\0new\0"))], "commit int, raw binary")
    got = {r.path: r.is_binary for r in git.read_numstat(stats, "commit", "raw").collect()}
    assert got == {"p": False, "bin": True, "new": False}
    both = git.with_binary(git.read_name_status(df, "commit", "raw"), git.read_numstat(stats, "commit", "raw"), "commit").collect()
    assert {r.path: r.is_binary for r in both} == {"p": False, "new": False, "é.ts": None}
    with pytest.raises(ValueError):
        git.name_status(b"R100\0only")


XML = """<?xml version="1.0"?><testsuites><testsuite name="outer" file="a.test.ts" tests="3">
<testcase name="one" classname="k"/><testsuite name="inner"><testcase name="two"><failure>x</failure></testcase><testcase name="two" file="other.test.ts"> <skipped message="m"/> </testcase></testsuite>
</testsuite></testsuites>"""


def test_junit(spark):
    df = spark.createDataFrame([(1, XML), (2, "<testsuite tests='2'><testcase name='a'/></testsuite>"), (3, "<a"), (4, None)], "report int, xml string")
    rows = junit.read_junit(df, "report", "xml").collect()
    one = [(r.name, r.file, r.suites, r.failed, r.skipped) for r in sorted(rows, key=lambda r: (r.report, r.ord)) if r.report == 1]
    assert one == [("one", "a.test.ts", ["outer"], False, False), ("two", "a.test.ts", ["outer", "inner"], True, False), ("two", "other.test.ts", ["outer", "inner"], False, True)]
    assert all(r.problem and r.failed is None for r in rows if r.report > 1) and len(rows) == 6
    ids = junit.case_ids(junit.read_junit(df.where("report = 1"), "report", "xml")).withColumn("id", F.regexp_replace("id", "^[^>]*> ", ""))
    merged = {r.id: (r.file, r.failed, r.skipped) for r in merged_cases(ids).collect()}
    assert merged["outer > inner > two"] == ("", True, False)


def test_runner_output(spark):
    text = "\x1b[32m ✓ src/a.test.ts (3 tests) 12ms\x1b[0m\n ❯ src/b.test.ts (1 test | 1 failed) 1.5s\nPASS src/c.spec.js (2 s)\nFAIL src/a.test.ts\ntests/test_x.py::t1 FAILED\ntests/test_x.py::t2 PASSED\nnoise"
    df = spark.createDataFrame([(1, text)], "run int, out string")
    got = {r.file: (r.status, r.ms) for r in runner_output.read_results(df, "run", "out").collect()}
    assert got == {"src/a.test.ts": ("failed", None), "src/b.test.ts": ("failed", 1500.0), "src/c.spec.js": ("passed", 2000.0), "tests/test_x.py": ("failed", None)}
    go = spark.createDataFrame([(1, "ok  \tex/a\t0.5s\nFAIL\tex/b\t1.25s\nFAIL")], "run int, out string")
    assert {r.package: (r.status, r.ms) for r in runner_output.read_go_results(go, "run", "out").collect()} == {"ex/a": ("passed", 500.0), "ex/b": ("failed", 1250.0)}
    names = spark.createDataFrame([(1, "not ok 3 - adds up\n × sub > case 3ms\nFAILED tests/x.py::t\nok 1 - fine")], "run int, out string")
    assert {r.name for r in runner_output.failing_names(names, "run", "out").collect()} == {"adds up", "sub > case", "tests/x.py::t"}


def test_outcome_log_and_streams(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [(i, f"2024-01-0{1 + i // 3}T00:00:00Z", [("a", "failed" if i % 2 else "passed", float(i)), ("b", "passed", None)]) for i in range(6)]
    df = spark.createDataFrame(rows, "seq long, produced_at string, test_results array<struct<file:string,status:string,ms:double>>")
    doc.append_outcomes(df.coalesce(1), log)
    (tmp_path / "log" / "bad.json").write_text('not json\n{"schema": "other.v9", "seq": 99}\n')
    records = doc.read_outcomes(spark, log)
    assert sorted(r.seq for r in records.collect()) == list(range(6)) and records.where("produced_at is null").count() == 0
    tests = doc.outcome_tests(records)
    assert tests.where("failed").count() == 3
    out = str(tmp_path / "out")
    refresh_history(stream_outcomes(spark, log), out, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {r.test: r.ms for r in spark.read.parquet(f"{out}/timings").collect()} == {"a": 3.0}
    q = failure_windows(stream_outcomes(spark, log)).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r.window.start)[:10], r.test, r.runs, r.failures) for r in spark.table("windows").collect()} == {("2024-01-01", "a", 3, 1), ("2024-01-01", "b", 3, 0), ("2024-01-02", "a", 3, 2), ("2024-01-02", "b", 3, 0)}


def test_documents(spark):
    one = lambda x: spark.createDataFrame([(json.dumps(x),)], "t string")
    timings = spark.createDataFrame([("b", 2.0), ("a", 1.5)], "test string, ms double")
    text = doc.timings_document(timings)
    assert {tuple(r) for r in doc.read_timings(text, "value").collect()} == {("a", 1.5), ("b", 2.0)}
    with pytest.raises(Exception, match="not a timings document"):
        doc.read_timings(one({"schema": doc.TIMINGS_SCHEMA, "files": {"a": -1}}), "t").collect()
    assert {tuple(r) for r in doc.read_coverage(one({"tests": {"t": ["src/a.ts", "src/b/"]}}), "t").collect()} == {("t", "src/a.ts", False), ("t", "src/b", True)}
    for x in ([{"id": "s", "targets": ["x"]}], {"specifications": [{"id": "s", "targets": ["x"]}]}):
        assert [tuple(r) for r in doc.read_specs(one(x), "t").collect()] == [("s", "x")]


def test_npm_lockfiles(spark):
    lock = lambda v: json.dumps({"lockfileVersion": 3, "packages": {"": {"dependencies": {"a": "1", "z": "1"}}, "node_modules/a": {"version": "1", "dependencies": {"b": "1"}}, "node_modules/b": {"version": "1"}, "node_modules/a/node_modules/b": {"version": v}, "node_modules/z": {"version": "1", "dependencies": {"b": "1"}}}})
    df = spark.createDataFrame([("before", lock("2")), ("after", lock("3"))], "side string, t string")
    keys = doc.read_npm_lock(df, "side", "t")
    changed = keyed_diff(keys.where("side = 'before'"), keys.where("side = 'after'"))
    assert [tuple(r) for r in changed.collect()] == [("node_modules/a/node_modules/b", "changed")]
    edges = doc.npm_edges(df, "side", "t").select("src", "dst").distinct()
    assert {tuple(r) for r in edges.collect()} == {("", "node_modules/a"), ("", "node_modules/z"), ("node_modules/a", "node_modules/a/node_modules/b"), ("node_modules/z", "node_modules/b")}
    roots = spark.createDataFrame([("node_modules/a",), ("node_modules/z",)], "root string")
    reach = closure(edges, roots.select("root", F.col("root").alias("node"))).select("root", F.col("node").alias("key"))
    assert {(r.root, r.affected) for r in affected_roots(roots, reach, changed).collect()} == {("node_modules/a", True), ("node_modules/z", False)}
    old = spark.createDataFrame([("x", '{"lockfileVersion": 1}'), ("y", "nonsense")], "side string, t string")
    assert {tuple(r) for r in doc.read_npm_lock(old, "side", "t").collect()} == {("x", None, None), ("y", None, None)}
