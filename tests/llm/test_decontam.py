import hashlib
import random
import re

import numpy as np
import pytest

from ripplet.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, size):
    grams = [(i, tuple(w[k : k + size])) for i, w in ((i, words(t)) for i, t in items) if w for k in range(max(1, len(w) - size + 1))]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, g in grams:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found.add(i)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("size", [3, 5])
def test_against_brute_force(spark, size):
    rng = random.Random(size)
    prose = lambda n, v: " ".join(rng.choice(v) + rng.choice(["", ".", ","]) for _ in range(n))
    v = ["aa", "b", "Çe", "d4", "E"]
    items = [(str(i), prose(rng.randint(1, 9), v)) for i in range(12)] + [("x", None), ("y", ""), ("z", "..."), ("1b", "aa b"), ("0", "aa B")]
    docs = [(i, prose(rng.randint(0, 60), v + ["other", "words"] * rng.randint(0, 3))) for i in range(60)] + [(100, None), (101, ""), (102, "!!"), (None, "aa b"), (7, "aa b"), (7, "aa b")]
    d = spark.createDataFrame([(a, b, "clash") for a, b in docs], "doc_id long, text string, key string")
    b = spark.createDataFrame(items, "item_id string, text string")
    got = [tuple(r)[:6] for r in decontam.decontaminate(d, b, window=size).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items, size), key=str)


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 4)
    items = [(str(i), f"one two three w{i % 3} five six") for i in range(9)]
    docs = [(1, "zero one two three w1 five six w2 five six"), (2, "nothing")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert sorted(tuple(r)[:6] for r in decontam.decontaminate(d, b, window=3).collect()) == brute(docs, items, 3)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    assert decontam.decontaminate(d, b).count() == 0
    assert [tuple(r)[1:4] for r in decontam.decontaminate(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), b).collect()] == [(2, 0, 0)]


def test_index_locates_every_occurrence():
    rng = np.random.default_rng(1)
    s = np.concatenate([np.append(rng.integers(1, 5, n), 0) for n in (1, 7, 40, 300, 300)] + [np.tile([1, 2, 3], 50), [0]])
    index = decontam.FMIndex(s, 5)
    for n in (1, 2, 5, 9):
        patterns = np.array([s[i : i + n] for i in range(0, len(s) - n, 7) if (s[i : i + n] > 0).all()])
        which, at = index.search(patterns)
        want = {(k, i) for k, p in enumerate(patterns) for i in range(len(s) - n + 1) if (s[i : i + n] == p).all()}
        assert set(zip(which.tolist(), at.tolist())) == want and len(which) == len(want)


CLASHING = "doc_id long, text string, key string, n_words string, n_hit string, items string, spans string, contaminated string, row string, ends string, c0 string"


def cut(docs, items, size):
    """Rows without the hit words by plain loops, as lists of the words that are left."""
    grams = {tuple(w[k : k + size]) for w in (words(t) for _, t in items) if w for k in range(max(1, len(w) - size + 1))}
    out = []
    for i, t in docs:
        w, hit = words(t), set()
        for g in grams:
            hit.update(x for k in range(len(w) - len(g) + 1) if tuple(w[k : k + len(g)]) == g for x in range(k, k + len(g)))
        left = [x for k, x in enumerate(w) if k not in hit]
        if left or not hit:
            out.append((i, left))
    return out


@pytest.mark.parametrize("block", [7, 400_000])
def test_hits_are_removed_whatever_the_other_columns_are_called(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    rng = random.Random(4)
    prose = lambda n, v: " ".join(rng.choice(v) + rng.choice(["", ".", ","]) for _ in range(n))
    v = ["aa", "b", "Çe", "d4", "E"]
    items = [(str(i), prose(rng.randint(1, 30), v)) for i in range(8)] + [("x", None)]
    docs = [(i, prose(rng.randint(0, 60), v + ["other", "words"] * rng.randint(0, 3))) for i in range(40)] + [(100, None), (101, ""), (None, "aa b"), (7, "other")]
    d = spark.createDataFrame([(a, b, *"xyzxyzxyz") for a, b in docs], CLASHING)
    b = spark.createDataFrame(items, "item_id string, text string")
    out = decontam.remove_hits(d, b, window=4)
    assert out.schema == d.schema
    got = out.collect()
    assert sorted(((r.doc_id, words(r.text)) for r in got), key=str) == sorted(cut(docs, items, 4), key=str)
    assert all(tuple(r)[2:] == tuple("xyzxyzxyz") for r in got)
    assert sorted((tuple(r)[:6] for r in decontam.decontaminate(d, b, window=4).collect()), key=str) == sorted(brute(docs, items, 4), key=str)


def test_several_real_blocks_give_what_one_does(spark, monkeypatch):
    rng = random.Random(12)
    items = [(str(i), " ".join(f"w{rng.randint(0, 3000)}" for _ in range(700))) for i in range(60)]
    docs = [(i, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(100)) + " " + " ".join(items[i % 60][1].split()[i : i + 30])) for i in range(80)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    one = sorted(tuple(r) for r in decontam.decontaminate(d, b).collect())
    assert sum(r[2] for r in one) == 80 * 30
    sizes = []
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 10_000)
    for block in decontam.load(b, "item_id", "text", 13):
        sizes.append(sum(w.nbytes for w, _ in block.windows) + block.item.nbytes + block.start.nbytes + block.words.nbytes)
    assert len(sizes) == 4 and max(sizes) < 100 * 11_000
    assert sorted(tuple(r) for r in decontam.decontaminate(d, b).collect()) == one
