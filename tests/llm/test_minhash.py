import random

import numpy as np

from ripplet.llm import minhash


def brute(rows, percent=85):
    def grams(t):
        w = [x for x in (t or "").translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    s = [(i, grams(t)) for i, t in rows]
    comp = {i: i for i, _ in s if i is not None}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, (i, g) in enumerate(s):
        for j, h in s[:k]:
            if g and i is not None and j is not None and 100 * len(g & h) >= percent * len(g | h):
                a, b = sorted((top(i), top(j)))
                comp[b] = a
    return sorted(((i, len(g), top(i) if i is not None else None) for i, g in s), key=str)


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for base in range(25):
        w = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([3, 5, 8, 60, 150, 400]))]
        for k in range(rng.randint(1, 6)):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                v[rng.randrange(len(v))] = "changed"
            rows.append((len(rows), rng.choice([" ", "  ", "\n"]).join(v)))
    # a chain in which neighbours are alike, but not the ends
    chain = [f"c{i}" for i in range(200)]
    for k in range(12):
        rows.append((len(rows), " ".join(chain[k * 6 : k * 6 + 120])))
    rng.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a B"), (904, "A b"), (None, rows[0][1]), (rows[1][0], rows[1][1])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, a string")
    got = minhash.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.component_id is None or r.component_id == r.doc_id) for r in got)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_sketches_tell_similarity():
    rng = np.random.default_rng(5)
    for j, most in ((0.85, minhash.MOST_APART), (0.97, 30)):
        apart = []
        for _ in range(60):
            n = 400
            union = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            only = int(n * (1 - j) / 2)
            _, a = minhash.sketches(minhash.samples(np.sort(union[only:]))[None])
            _, b = minhash.sketches(minhash.samples(np.sort(union[: n - only]))[None])
            apart.append(int(np.bitwise_count((a ^ b).view(np.uint64)).sum()))
        assert max(apart) <= most
        k = minhash.BANDS * minhash.ROWS
        estimate = 1 + minhash.SKETCH_BITS / (4 * k) * np.log(1 - 2 * np.mean(apart) / minhash.SKETCH_BITS)
        assert abs(estimate - j) < 0.03


def templated(rng, n, shared=300, own=120):
    """Documents of a common template with words of their own: similarities of about 0.55."""
    template = [f"t{rng.randint(0, 10**6)}" for _ in range(shared)]
    return [" ".join(template + [f"o{rng.randint(0, 10**7)}" for _ in range(own)]) for _ in range(n)]


def test_documents_of_one_template_make_few_pairs(spark, monkeypatch):
    rng = random.Random(31)
    rows = list(enumerate(templated(rng, 2000)))
    w = rows[1500][1].split()
    rows.append((3000, " ".join([*w[:-6], *"u v w x y z".split()])))
    counts = []
    plain = minhash.compare
    monkeypatch.setattr(minhash, "compare", lambda pairs, *more: counts.append(pairs.count()) or plain(pairs, *more))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 1500 if i == 3000 else i for i, _ in rows}
    # of 2,001,000 pairs
    assert sum(counts) < 60_000, counts


def test_buckets_of_several_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rng = random.Random(32)
    rows = []
    for text in templated(rng, 40):
        for k in range(rng.choice((1, 1, 2, 3))):
            w = text.split()
            for _ in range(rng.choice((0, 1, 2, 6))):
                w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    rows += [(rows[0][0], rows[5][1]), (rows[1][0], rows[1][1])]
    for percent in (80, 85):
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, percent)


def test_sketch_bounds_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(6)
    for percent in (80, 85, 95):
        n, apart = 4000, []
        for _ in range(120):
            union = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            only = int(n * (1 - percent / 100) / 2)
            a, b = (minhash.sketches(minhash.samples(np.sort(u))[None])[1] for u in (union[only:], union[: n - only]))
            apart.append(int(np.bitwise_count((a ^ b).view(np.uint64)).sum()))
        # far enough from what was drawn to be rare, and not so far that it says nothing
        assert np.mean(apart) + 4.5 * np.std(apart) < minhash.most_apart(percent) < np.mean(apart) + 7 * np.std(apart)
