"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Terms are pairs of adjacent words (A-Z lower-cased). Inverse document frequencies count all files, for the templates' terms; any
other term weighs as one that no file has. Segments of a file are its lines and its runs of neighbouring lines that each
share a term with a template, so that a wrapped header counts as one; a licence file is also compared as a whole. A
segment without a shared term has cosine 0, so nothing else needs to be scored. The best cosine of at least `least`
decides (ties: the smaller template number).

A file without a licence of its own takes that of the nearest directory above it (its own one included) that has a licence file
with one: the distinct directories of all files are exploded into their ancestors, joined by path with the
licensed directories, and the deepest wins; files then join their directory. A hot directory so is one row until the last join.

Defined cases: null or empty text: no licence of its own. Null path: the root directory, no file name. Several licence files
in one directory: the best cosine, then the smaller licence name. Repeated rows get a row each; empty tables give empty
tables. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.llm.cluster import in_arrow, ship, store
from ripplet.llm.licence_texts import TEXTS
from ripplet.llm.lexing import NOT_WORD, U, Words, mix, slices, texts

LEAST = 0.7
LICENCE_FILE = r"(?i)^(un)?(licen[sc]e|copying|notice|copyright)([._-].*)?$"

#: Short notices by which licences are declared, headers and full texts, by SPDX identifier. No full text of AGPL-3.0.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License"),
    ("LGPL-2.1", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", "Released under the ISC License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    *TEXTS,
]


def terms(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, hash of the pair that begins at each word but the last, whether both words are of one row)."""
    w = Words(*texts(column), NOT_WORD)
    h = w.hashes()
    return w, mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:]), w.doc[1:] == w.doc[:-1]


class Templates:
    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        w, pair, ok = terms(pa.array([t for _, t in templates]))
        self.vocabulary = np.unique(pair[ok])
        self.counts = [Counter() for _ in templates]
        for d, c in zip(w.doc[:-1][ok].tolist(), np.searchsorted(self.vocabulary, pair[ok]).tolist()):
            self.counts[d][c] += 1
        self.weigh(0, {})

    def weigh(self, files: int, df: dict[int, int]) -> None:
        """Set the weights from the number of files and the files that have each term."""
        self.rare = math.log(1 + files) + 1
        self.idf = [math.log((1 + files) / (1 + df.get(i, 0))) + 1 for i in range(len(self.vocabulary))]
        self.unit, self.having = [], {}
        for k, c in enumerate(self.counts):
            v = {i: n * self.idf[i] for i, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
            self.unit.append({i: x / norm for i, x in v.items()})
            for i in v:
                self.having.setdefault(i, []).append(k)

    def code(self, pair: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, pair), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == pair, at, -1)

    def best(self, code: np.ndarray, pair: np.ndarray) -> tuple[float, int]:
        """(cosine, template) of a segment's pairs."""
        known = Counter(code[code >= 0].tolist())
        _, other = np.unique(pair[code < 0], return_counts=True)
        norm = math.sqrt(sum((n * self.idf[i]) ** 2 for i, n in known.items()) + float((other.astype(float) ** 2).sum()) * self.rare**2)
        dots: dict[int, float] = {}
        for i, n in known.items():
            for k in self.having[i]:
                dots[k] = dots.get(k, 0.0) + n * self.idf[i] * self.unit[k][i]
        return max(((min(1.0, round(x / norm, 12)), -k) for k, x in dots.items()), default=(0.0, 1))


def _frequencies(t: Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(len(t.vocabulary), np.int64)
            for b in slices(batch, "text"):
                w, pair, ok = terms(b.column("text"))
                code = t.code(pair[ok]) if len(pair) else np.zeros(0, np.int64)
                hit = code >= 0
                once = np.unique(np.stack([w.doc[:-1][ok][hit], code[hit]]), axis=1) if hit.any() else np.zeros((2, 0), np.int64)
                total += np.bincount(once[1], minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["term", "n"])

    return run


def _scan(t: Templates, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                w, pair, ok = terms(b.column("text"))
                found: list[tuple[float, int]] = [(0.0, 1)] * b.num_rows
                if len(pair):
                    code = np.where(ok, t.code(pair), -1)
                    breaks = np.concatenate([[0], np.cumsum(w.buf == 10)])
                    line = breaks[w.start]
                    whole = b.column("file").to_pylist()
                    lines: dict[int, list[int]] = {}
                    for p in np.flatnonzero(code >= 0).tolist():
                        own = lines.setdefault(int(w.doc[p]), [])
                        # a pair across a line's end belongs to both lines
                        for x in (int(line[p]), int(line[p + 1])):
                            if not own or own[-1] != x:
                                own.append(x)
                    for d, own in lines.items():
                        at, end = int(w.first[d]), int(w.first[d + 1])
                        spans, run_at = [(x, x) for x in own], own[0]
                        for x, y in zip(own, [*own[1:], None]):
                            if y is None or y > x + 1:
                                spans.append((run_at, x))
                                run_at = y
                        if whole[d]:
                            spans.append((int(line[at]), int(line[end - 1])))
                        for x, y in set(spans):
                            p, q = at + int(np.searchsorted(line[at:end], x)), at + int(np.searchsorted(line[at:end], y, "right")) - 1
                            found[d] = max(found[d], t.best(code[p:q], pair[p:q]))
                good = [c >= least for c, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in b.schema.names if c != "text"), pa.array([t.names[-k] if g else None for g, (_, k) in zip(good, found)], pa.string()), pa.array([c for c, _ in found], pa.float64())],
                    [*(c for c in b.schema.names if c != "text"), "own", "cosine"],
                )

    return run


def scan_licences(df: DataFrame, key: str, path: str | Column, text: str, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """(key, path, license, basis, cosine, license_dir): basis is `own`, `inherited` or `none`; license_dir, where it is inherited from."""
    spark = df.sparkSession
    ship(spark)
    t = Templates(templates or TEMPLATES)
    p = F.col(path) if isinstance(path, str) else path
    rows = df.select(F.col(key).alias("key"), F.coalesce(p, F.lit("")).alias("path"), F.col(text).alias("text"))
    rows = rows.select("key", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENCE_FILE).alias("file"), "text")
    counted = rows.select("text").transform(in_arrow, _frequencies(t), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most a row a template term
    t.weigh(rows.count(), {r.term: r.n for r in counted})
    kind = df.schema[key].dataType.simpleString()
    scanned = store(rows.transform(in_arrow, _scan(t, least), f"key {kind}, path string, dir string, file boolean, own string, cosine double"), "licences")
    licensed = scanned.where("file and own is not null").groupBy("dir").agg(F.min_by("own", F.struct(-F.col("cosine"), "own")).alias("inherited")).withColumnRenamed("dir", "license_dir")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    dirs = scanned.where("own is null").select("dir").distinct().select("dir", F.explode(F.array_distinct(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(above))).alias("license_dir"))
    nearest = dirs.join(licensed, "license_dir").groupBy("dir").agg(F.max_by(F.struct("inherited", "license_dir"), F.length("license_dir")).alias("near"))
    out = scanned.join(nearest, "dir", "left")
    lent = F.when(F.col("own").isNull(), F.col("near"))
    return out.select(
        F.col("key").alias(key), "path", F.coalesce("own", lent.inherited).alias("license"),
        F.when(F.col("own").isNotNull(), "own").when(lent.isNotNull(), "inherited").otherwise("none").alias("basis"), "cosine", lent.license_dir.alias("license_dir"),
    )


def document_path() -> Column:
    """`documents` has no paths: a source is a root directory, 64 ids in a row a directory in it, and the first of them its licence file."""
    name = F.when(F.col("doc_id") % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return F.concat_ws("/", F.col("source"), F.floor(F.col("doc_id") / 64).cast("string"), name)


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", document_path(), "text")
