"""Columns over repository paths (`/` between segments, no leading one)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: str | Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def dirname(path: str | Column) -> Column:
    """The directory, "" for the root."""
    return F.regexp_extract(path, "^(?:(.*)/)?[^/]*$", 1)


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def ancestors(path: str | Column) -> Column:
    """The directories above a path, nearest first, the root ("") last."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.transform(F.sequence(n, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def module_key(path: str | Column) -> Column:
    """The path without its last extension and without a final /index: what an import of it may say."""
    return F.regexp_replace(F.regexp_replace(path, r"(\.d)?\.[^./]+$", ""), "/index$", "")


def package_root(specifier: str | Column) -> Column:
    """The package of a bare import: its first segment, or its first two if it is scoped."""
    return F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^@./][^/]*)", 1)


def redacted(path: str | Column) -> Column:
    """Twelve digits of the path's SHA-256, with its extension."""
    return F.concat(F.substring(F.sha2(path, 256), 1, 12), F.regexp_extract(path, r"(\.[^./]+)$", 1))


def normalized(path: str | Column) -> Column:
    """Back slashes to slashes, no leading ./"""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
