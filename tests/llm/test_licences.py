import math
import re
from collections import Counter

from ripplet.llm import licences as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
APACHE = "# Licensed under the Apache License,\n# Version 2.0."


def pairs(t):
    w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    return list(zip(w, w[1:]))


def brute(files, least=L.LEAST):
    """All runs of lines of every file, against all templates."""
    n = len(files)
    df = Counter(p for _, _, t in files for p in set(pairs(t)))
    known = {p for _, t in L.TEMPLATES for p in pairs(t)}
    idf = lambda p: math.log((1 + n) / (1 + df[p])) + 1 if p in known else math.log(1 + n) + 1
    vec = lambda ps: {p: c * idf(p) for p, c in Counter(ps).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1
    own = {}
    for key, path, t in files:
        best = (0.0, 1)
        lines = (t or "").split("\n")
        shares = [bool(set(pairs(x)) & known) for x in lines]
        # pairs across a line's end count for both lines
        for i in range(len(lines) - 1):
            if set(pairs("\n".join(lines[i : i + 2]))) & known - set(pairs(lines[i])) - set(pairs(lines[i + 1])):
                shares[i] = shares[i + 1] = True
        runs, i = [], 0
        while i < len(lines):
            j = i
            while j < len(lines) and shares[j]:
                j += 1
            runs += [(i, j)] * (j > i) + [(k, k + 1) for k in range(i, j)]
            i = max(j, i + 1)
        if re.match(L.LICENCE_FILE, path.rpartition("/")[2]):
            runs.append((0, len(lines)))
        for a, b in runs:
            v = vec(pairs("\n".join(lines[a:b])))
            for k, (_, template) in enumerate(L.TEMPLATES):
                u = vec(pairs(template))
                c = sum(x * u.get(p, 0) for p, x in v.items()) / norm(v) / norm(u)
                best = max(best, (min(1.0, round(c, 9)), -k))
        own[key] = L.TEMPLATES[-best[1]][0] if best[0] >= least else None
    return own


FILES = [
    (1, "a/LICENSE", "Some title\n\nReleased under the MIT License.\nmore words here"), (2, "a/b/x.py", "print(1)"), (3, "a/b/c/y.py", APACHE + "\ncode"),
    (4, "a/b/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), (5, "a/b/c/d/e/z.py", ""), (6, "q/w.py", None),
    (7, "ab/x.py", "the license is under the sea, of the public"), (8, "a/b/c/d/LICENSE", "nothing known"), (9, "top.txt", "Licensed under CC BY-NC 4.0."), (10, "a/é.md", "x"), (10, "a/é.md", "x"),
]


def test_against_brute_force_and_inheritance(spark):
    df = spark.createDataFrame([(*f, "clash") for f in FILES], "doc_id long, path string, text string, own string")
    got = {r.doc_id: r for r in L.scan_licences(df, "doc_id", "path", "text").collect()}
    own = brute(FILES)
    for k, lic in own.items():
        assert (got[k].license if got[k].basis == "own" else None) == lic, k
    assert own[1] == "MIT" and own[3] == "Apache-2.0" and own[4] == "GPL-3.0" and own[9] == "CC-BY-NC-4.0" and own[7] is None
    want = {2: ("MIT", "inherited", "a"), 5: ("GPL-3.0", "inherited", "a/b/c"), 8: ("GPL-3.0", "inherited", "a/b/c"), 10: ("MIT", "inherited", "a"), 6: (None, "none", None), 7: (None, "none", None)}
    assert {k: (got[k].license, got[k].basis, got[k].license_dir) for k in want} == want


def test_root_licence_and_empty_table(spark):
    df = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "x/y/z", "t"), (3, None, "t")], "doc_id long, path string, text string")
    assert sorted((r.doc_id, r.license, r.license_dir) for r in L.scan_licences(df, "doc_id", "path", "text").collect()) == sorted([(1, "MIT", None), (2, "MIT", ""), (3, "MIT", "")])
    assert L.scan_licences(df.limit(0), "doc_id", "path", "text").count() == 0


def test_headers_and_full_texts_tell_neighbouring_licences_apart(spark):
    header = "/* This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU {}General Public License as published by\n * the Free Software Foundation; either version {} of the License, or\n * (at your option) any later version. */\nint main"
    one = "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"
    files = [("GPL-2.0", "a.c", header.format("", "2")), ("GPL-2.0", "b.c", one), ("GPL-3.0", "c.c", header.format("", "3")), ("LGPL-2.1", "d.c", header.format("Lesser ", "2.1")), ("AGPL-3.0", "e.c", header.format("Affero ", "3"))]
    files += [(name, f"{k}/LICENSE", "Copyright (c) 2020 Jane Doe\n\n" + text) for k, (name, text) in enumerate(L.TEMPLATES) if text.count("\n") > 5]
    assert {"ISC", "BSD-2-Clause", "BSD-3-Clause", "LGPL-2.1", "MIT"} <= {name for name, _, _ in files}
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "doc_id long, want string, path string, text string")
    got = {r.doc_id: r.license for r in L.scan_licences(df, "doc_id", "path", "text").collect()}
    assert [got[i] for i in range(len(files))] == [f[0] for f in files]
