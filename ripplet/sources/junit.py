"""JUnit reports: cases in document order, with what their suites say about them."""

from __future__ import annotations

import xml.sax
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES, MOST_DEPTH, MOST_TAGS = 16 * 1024 * 1024, 128, 100_000
CASE = "ord int, name string, classname string, file string, suite string, suites array<string>, failed boolean, skipped boolean, suite_level boolean, problem string"


class Invalid(ValueError):
    pass


class _Reader(xml.sax.ContentHandler):
    def __init__(self):
        super().__init__()
        self.cases, self.suites, self.case, self.depth, self.tags, self.counts = [], [], None, 0, 0, []

    def startElement(self, name, attrs):
        self.depth += 1
        self.tags += 1
        if self.depth > MOST_DEPTH or self.tags > MOST_TAGS:
            raise Invalid("the report is too deep or has too many elements")
        name = name.rpartition(":")[2]
        if name == "testsuite":
            self.suites.append((attrs.get("name"), attrs.get("file") or attrs.get("filepath") or (self.suites[-1][1] if self.suites else None)))
            self.counts.append([attrs.get("tests"), 0])
        elif name == "testcase":
            if self.case is not None:
                raise Invalid("a case within a case")
            for c in self.counts:
                c[1] += 1
            self.case = {"name": attrs.get("name") or "", "classname": attrs.get("classname"), "file": attrs.get("file") or (self.suites[-1][1] if self.suites else None), "failed": False, "skipped": False}
        elif name in ("failure", "error") and self.case is not None:
            self.case["failed"] = True
        elif name in ("failure", "error") and self.suites:
            s = self.suites[-1]
            self.cases.append((len(self.cases), s[0] or "", None, s[1], s[0], [x[0] for x in self.suites if x[0]], True, False, True, None))
        elif name == "skipped" and self.case is not None:
            self.case["skipped"] = True

    def endElement(self, name):
        self.depth -= 1
        name = name.rpartition(":")[2]
        if name == "testcase":
            c, self.case = self.case, None
            self.cases.append((len(self.cases), c["name"], c["classname"], c["file"], self.suites[-1][0] if self.suites else None, [x[0] for x in self.suites if x[0]], c["failed"], c["skipped"], False, None))
        elif name == "testsuite":
            self.suites.pop()
            said, has = self.counts.pop()
            if said is not None and said.isdigit() and int(said) != has:
                raise Invalid(f"a suite declares {said} tests and has {has}")


def parse(text: str | None) -> list[tuple]:
    """The cases of a report. A report that can't be read is one row that says why: unknown is never "no failure"."""
    try:
        if text is None or len(text.encode()) > MOST_BYTES:
            raise Invalid("no report, or a too large one")
        r = _Reader()
        xml.sax.parseString(text.encode(), r)
        return r.cases
    except (Invalid, xml.sax.SAXException) as e:
        return [(0, None, None, None, None, [], None, None, None, str(e)[:200])]


def read_junit(reports: DataFrame, key: str, column: str) -> DataFrame:
    """(key, ord, name, classname, file, suite, suites, failed, skipped, suite_level, problem)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, *c) for k, t in zip(f["k"], f["t"]) for c in parse(t)], columns=["k", *(x.split()[0] for x in CASE.split(", "))]).astype({"failed": "boolean", "skipped": "boolean", "suite_level": "boolean"})

    kind = reports.schema[key].dataType.simpleString()
    return reports.select(F.col(key).alias("k"), F.col(column).alias("t")).mapInPandas(run, f"k {kind}, {CASE}").withColumnRenamed("k", key)


def case_ids(cases: DataFrame) -> DataFrame:
    """Cases with `id`: the file, the suites' names and the case's own."""
    return cases.withColumn("id", F.concat_ws(" > ", F.coalesce("file", F.lit("")), F.array_join(F.filter(F.concat("suites", F.array("name")), lambda x: x != ""), " > ")))
