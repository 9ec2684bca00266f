"""Numbers, times and error texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: str | Column) -> Column:
    """Rounded half towards plus infinity."""
    return F.floor((F.col(x) if isinstance(x, str) else x) + 0.5)


def upper_median(values: str | Column) -> Column:
    """The upper of the two middle values of an array; null for an empty one."""
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int")))


def minutes(start: str | Column, end: str | Column) -> Column:
    """Minutes from start to end, at least 0; 0 where either is missing."""
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(F.to_timestamp(end)) - F.unix_micros(F.to_timestamp(start))) / 60e6), F.lit(0.0))


def duration_ms(value: str | Column, unit: str | Column) -> Column:
    """A reported duration in milliseconds: seconds are scaled, both are rounded half up."""
    v = F.col(value) if isinstance(value, str) else value
    u = F.col(unit) if isinstance(unit, str) else unit
    return half_up(F.when(u == "s", v * 1000).otherwise(v))


def decay(age: str | Column, half_life: float = 20.0) -> Column:
    return F.pow(F.lit(0.5), (F.col(age) if isinstance(age, str) else age) / half_life)


#: Ordered rules: the first class one of whose expressions is found names the failure.
FAILURE_CLASSES: list[tuple[str, list[str]]] = [
    ("TIMEOUT", ["timed? ?out", "exceeded the timeout", "context deadline exceeded"]),
    ("RUNNER_INFRASTRUCTURE", ["runner has received a shutdown", "lost communication with", "econnreset", "job was canceled", "no space left", r"1101\b", "container start"]),
    ("CONFIGURATION", ["err_unknown_builtin_module", "environment variable .* is not set", "missing required secret", "invalid configuration", r"engines\.node", "unsupported engine"]),
    ("DEPENDENCY", ["npm error (code )?(e404|eresolve|eai_again)", "could not resolve host", "module not found", "cannot find module", "peer dep(endency)? (conflict|missing)"]),
    ("TYPECHECK", [r"error ts\d{4}", "tsc --noemit"]),
    ("LINT", ["eslint", r"\d+ problems? \(\d+ errors?"]),
    ("BUILD", ["build failed", "compilation failed", "webpack (compiled with|failed)"]),
    ("GENERATED_ARTIFACT", ["generated files? (is|are) out of date", "diff detected in generated", "snapshot mismatch"]),
    ("SECURITY_SCAN", ["codeql", "security alert", "vulnerability found"]),
    ("DEPLOYMENT", ["deploy(ment)? failed", "wrangler deploy.*error", "rollout failed"]),
    ("INTEGRATION_TEST", ["integration test"]),
    ("UNIT_TEST", ["err_test_failure", r"not ok \d+", "assertionerror", "expected .* to (equal|be)"]),
]


def failure_class(text: str | Column, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    chain = reduce(lambda c, r: c.when(t.rlike("(?i)" + "|".join(f"(?:{p})" for p in r[1])), r[0]), (rules or FAILURE_CLASSES)[1:], F.when(t.rlike("(?i)" + "|".join(f"(?:{p})" for p in (rules or FAILURE_CLASSES)[0][1])), (rules or FAILURE_CLASSES)[0][0]))
    return chain.otherwise("UNKNOWN")


#: What varies between two reports of one error, in the order in which it is blurred.
BLUR: list[tuple[str, str]] = [
    (r"/[A-Za-z0-9_./-]+[.](?:[jt]sx?|[cm]js)", "<path>"),
    (r"(?::[0-9]+){2}", ""),
    (r"\b[0-9a-fA-F]{7,40}\b", "<hash>"),
    (r"\b[0-9]{4}(?:-[0-9]{2}){2}T[0-9:.]+Z?\b", "<timestamp>"),
    (r"\b(?:[0-9]+m|[0-9]+(?:[.][0-9]+)?)s\b", "<duration>"),
    (r"\b[0-9]+[.][0-9]+\b", "<duration>"),
    (r"[\s]+", " "),
]


def error_text(text: str | Column) -> Column:
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.lower(F.trim(reduce(lambda c, r: F.regexp_replace(c, r[0], r[1].replace("$", r"\$")), BLUR, t)))


def fingerprint(kind: str | Column, job: str | Column, step: str | Column, test: str | Column, text: str | Column) -> Column:
    """The identity of a failure: class, job, step and test, and the start of its blurred text."""
    part = lambda c: F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    return F.concat_ws("|", kind, part(job), part(step), part(test), F.substring(error_text(text), 1, 200))


def signature(path: str | Column, title: str | Column, message: str | Column) -> Column:
    """An annotation's place, title and first line with temporary paths, hashes and numbers blurred; null if it says nothing."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    first = F.regexp_extract(F.trim(F.coalesce(c(message), F.lit(""))), r"^([^\r\n]*)", 1)
    empty = (first == "") & (F.coalesce(c(title), F.lit("")) == "")
    generic = first.rlike("(?i)exited with code|elifecycle|^command failed|process completed with exit code")
    place = F.coalesce(c(path), F.lit(""))
    blurred = F.regexp_replace(F.concat_ws(" :: ", place, F.coalesce(c(title), F.lit("")), first), r"/tmp/\S+|[a-f0-9]{7,}|[0-9]+(?:[.][0-9]+)?", "#")
    return F.when(~empty & ~generic & ~place.isin("", ".github"), F.substring(blurred, 1, 300))


def cost_model(saved_minutes: Column, price: float, watts: float, grams_per_kwh: float) -> Column:
    """Money, energy and carbon of the minutes saved; the factors must be finite and not negative."""
    for x in (price, watts, grams_per_kwh):
        if not 0 <= x < float("inf"):
            raise ValueError("factors must be finite and not negative")
    kwh = saved_minutes / 60 * watts / 1000
    return F.struct((saved_minutes * price).alias("cost"), kwh.alias("kwh"), (kwh * grams_per_kwh).alias("grams"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once; a plain column would be computed again at each use, in a lambda once an element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
