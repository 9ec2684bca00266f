"""NUL-separated git output: name-status and numstat, one blob a row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGED = "ord int, status string, similarity int, path string, old_path string"


def name_status(raw: bytes) -> list[tuple]:
    """(ord, status, similarity, path, old_path): renames and copies carry a similarity and two paths."""
    out, parts = [], raw.decode("utf-8", "surrogateescape").split("\0")
    it = iter(parts[:-1] if parts and parts[-1] == "" else parts)
    for code in it:
        if not code:
            continue
        kind, score = code[0], code[1:]
        first = next(it, None)
        second = next(it, None) if kind in "RC" else None
        if first is None or (kind in "RC" and second is None):
            raise ValueError(f"the output ends within {code}")
        out.append((len(out), kind, int(score) if score.isdigit() else None, second or first, first if second else None))
    return out


def numstat(raw: bytes) -> list[tuple]:
    """(path, is_binary): counts of "-" say binary; a rename has an empty path, then the old and the new one."""
    out, it = [], iter(raw.decode("utf-8", "surrogateescape").split("\0"))
    for rec in it:
        if not rec:
            continue
        added, removed, path = rec.split("\t", 2)
        if not path:
            next(it, None)
            path = next(it, "")
        out.append((path, added == "-" and removed == "-"))
    return out


def read_name_status(blobs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, ord, status, similarity, path, old_path) of every blob."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *r) for k, raw in zip(f["k"], f["raw"]) for r in name_status(bytes(raw or b""))]
            d = pd.DataFrame(rows, columns=["k", "ord", "status", "similarity", "path", "old_path"])
            yield d.astype({"similarity": "Int32"})

    kind = blobs.schema[key].dataType.simpleString()
    return blobs.select(F.col(key).alias("k"), F.col(column).alias("raw")).mapInPandas(run, f"k {kind}, {CHANGED}").withColumnRenamed("k", key)


def read_numstat(blobs: DataFrame, key: str, column: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, *r) for k, raw in zip(f["k"], f["raw"]) for r in numstat(bytes(raw or b""))], columns=["k", "path", "is_binary"])

    kind = blobs.schema[key].dataType.simpleString()
    return blobs.select(F.col(key).alias("k"), F.col(column).alias("raw")).mapInPandas(run, f"k {kind}, path string, is_binary boolean").withColumnRenamed("k", key)


def with_binary(changed: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """changed with is_binary by new path; null where git did not say."""
    return changed.join(stats, [key, "path"], "left")
