"""Results of single test files, out of what test runners print; native expressions, a line a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.functions.values import duration_ms

_ANSI = "\u001b\\[[0-9;]*[A-Za-z]"
_VITEST = r"^\s*([✓✔❯×✗])\s+(\S+[.](?:spec|test)[.][cm]?[jt]sx?)\b.*?(?:\s([0-9.]+)\s?(ms|s))?\s*$"
_JEST = r"^\s*(PASS|FAIL)\s+(\S+[.](?:spec|test)[.][cm]?[jt]sx?)(?:\s*\(([0-9.]+) ?(ms|s)\))?"
_PYTEST = r"^(\S+\.py)(?:::\S+)?\s+(PASSED|FAILED|ERROR|[.FEsx]+)\b"
_GO = r"^(ok|FAIL|---\s*FAIL:)\s+(\S+)(?:\s+([0-9.]+)(s))?"


def lines(outputs: DataFrame, key: str, column: str) -> DataFrame:
    return outputs.select(F.col(key), F.posexplode(F.split(F.regexp_replace(column, _ANSI, ""), r"\r?\n")).alias("pos", "line"))


def read_results(outputs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, file, status, ms): the last line of a file wins; a Python file that failed once has failed."""
    get = lambda rx, i: F.regexp_extract("line", rx, i)
    ms = lambda rx: F.when(get(rx, 3) != "", duration_ms(get(rx, 3).try_cast("double"), get(rx, 4)))
    status = lambda bad: F.when(bad, "failed").otherwise("passed")
    row = lambda file, bad, time, sticky: F.struct(file.alias("file"), status(bad).alias("status"), time.cast("double").alias("ms"), F.lit(sticky).alias("sticky"))
    found = (
        F.when(F.col("line").rlike(_VITEST), row(get(_VITEST, 2), get(_VITEST, 1).isin("❯", "×", "✗"), ms(_VITEST), False))
        .when(F.col("line").rlike(_JEST), row(get(_JEST, 2), get(_JEST, 1) == "FAIL", ms(_JEST), False))
        .when(F.col("line").rlike(_PYTEST), row(get(_PYTEST, 1), get(_PYTEST, 2).rlike("FAILED|ERROR|[FE]"), F.lit(None), True))
    )
    rows = lines(outputs, key, column).withColumn("r", found).where("r is not null")
    last = F.max_by(F.struct("r.status", "r.ms"), "pos")
    return rows.groupBy(key, F.col("r.file").alias("file")).agg(last.alias("last"), F.bool_or(F.col("r.sticky") & (F.col("r.status") == "failed")).alias("stuck")).select(key, "file", F.when(F.col("stuck"), "failed").otherwise(F.col("last.status")).alias("status"), "last.ms")


def read_go_results(outputs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, package, status, ms) of `go test`."""
    get = lambda i: F.regexp_extract("line", _GO, i)
    rows = lines(outputs, key, column).where(F.col("line").rlike(r"^(ok|FAIL)\s+\S+")).select(key, "pos", get(2).alias("package"), F.when(get(1) == "ok", "passed").otherwise("failed").alias("status"), F.when(get(3) != "", duration_ms(get(3).try_cast("double"), get(4))).cast("double").alias("ms"))
    return rows.groupBy(key, "package").agg(F.max_by(F.struct("status", "ms"), "pos").alias("r")).select(key, "package", "r.status", "r.ms")


def failing_names(outputs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, name): names of failing tests as runners list them."""
    name = F.coalesce(F.nullif(F.regexp_extract("line", r"^ *(?:●|✖|✗|×|FAIL) +(.+?)(?: +[0-9.]+ ?m?s)? *$", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^not ok \d+ - (.+?)\s*$", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^FAILED (\S+)", 1), F.lit("")))
    return lines(outputs, key, column).select(key, name.alias("name")).where("name is not null").distinct()
