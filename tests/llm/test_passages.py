import random

import numpy as np

from ripplet.llm import passages as P


def prose(rng, n):
    return " ".join(f"w{rng.randint(0, 4000)}" for _ in range(n))


def test_windows_are_the_tree_nodes_of_enough_span():
    rng = np.random.default_rng(3)
    for n in (1, 5, 30, 200):
        sh = rng.integers(0, 1 << 62, n).astype(np.uint64)
        for k in range(2):
            v = [int(x) for x in P.values(sh, np.zeros(n), k)[0]]
            want = []
            for c in range(n):
                left = c
                while left > 0 and v[left - 1] > v[c]:
                    left -= 1
                right = c
                while right < n - 1 and v[right + 1] > v[c]:
                    right += 1
                if right - left + 1 >= 6:
                    want.append((left, c, right))
            assert sorted(P.windows(sh, 6, k), key=lambda x: x[1]) == want
            f, left, c, right = P.all_windows(sh, 6)
            assert [(x, y, z) for g, x, y, z in zip(f, left, c, right) if g == k] == want


def test_repeats_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(8)
    texts = {i: prose(rng, rng.randint(0, 400)) for i in range(60)}
    passage, longer = prose(rng, 51), prose(rng, 300).split()
    for i in (3, 17, 40, 41):
        w = texts[i].split()
        k = rng.randint(0, len(w))
        texts[i] = " ".join([*w[:k], *passage.split(), *w[k:]])
    near = list(longer)
    for k in (40, 150, 260):
        near[k] = "changed"
    texts[21] += " " + " ".join(longer)
    texts[50] += "\n" + " ".join(near).upper()
    line = "released under the terms of the public licence version two"
    for i in range(30):
        texts[i + 5] += " " + line
    texts[70] = texts[12]
    df = spark.createDataFrame([*texts.items(), (80, None), (81, ""), (None, texts[3])], "doc_id long, text string")
    got = P.repeated_passages(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {i for i in by if i != 70} == {17, 40, 41, 50}
    assert all(r.source == 3 and r.stop - r.start >= 51 for i in (17, 40, 41) for r in by[i])
    r = max(by[50], key=lambda r: r.stop - r.start)
    assert r.source == 21 and r.similarity >= 0.8 and r.stop - r.start >= 290
    if len(texts[12].split()) >= 50:
        assert by[70][0].source == 12 and (by[70][0].start, by[70][0].stop) == (0, len(texts[12].split()))
    left = {r.doc_id: r.text for r in P.remove_passages(df, P.repeated_passages(df)).collect()}
    assert passage in left[3] and not any(passage in left[i] for i in (17, 40, 41)) and left[21] == texts[21] and 70 not in left
    assert left[0] == texts[0] and left[80] is None and left[81] == ""


def test_a_first_document_without_the_passage_hides_no_link(spark):
    rng = random.Random(9)
    passage = prose(rng, 60).split()
    rows = [(0, " ".join([prose(rng, 80), *passage[k : k + 30], prose(rng, 80)])) for k in (0,)] + [(9, prose(rng, 50) + " " + " ".join(passage)), (10, " ".join(passage) + " " + prose(rng, 50))]
    got = P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source) for r in got} == {(10, 9)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.repeated_passages(df).count() == 0 and P.remove_passages(df, P.repeated_passages(df)).count() == 0


def test_cut():
    assert P.cut("a b  c\nd", [(1, 3)]) == "a \nd" and P.cut("a b", [(0, 2), (0, 1)]) == "" and P.cut("é b c", [(2, 3), (0, 1)]) == " b "


def one(text):
    return P.pa.RecordBatch.from_arrays([P.pa.array([1]), P.pa.array([text])], ["id", "text"])


def signatures(text):
    t = P.Text(next(P._words(iter([one(text)]))).column("w")[0].as_py(), 46)
    k, _, c, _ = P.all_windows(t.sh, 46)
    return set(zip(k.tolist(), t.sh[c].tolist()))


def links(spark, texts):
    return {(r.doc_id, r.source) for r in P.repeated_passages(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}


def test_a_pair_with_one_common_signature_is_compared(spark):
    rng = random.Random(26)
    passage = prose(rng, 50).split()
    near = " ".join([*passage[:24], "changed", *passage[25:]])
    texts = {0: prose(rng, 60) + " " + " ".join(passage) + " " + prose(rng, 60), 1: near}
    assert len(signatures(texts[0]) & signatures(near)) == 1
    assert links(spark, texts) == {(1, 0)}


def test_the_second_look_finds_a_source_that_is_not_open(spark):
    rng = random.Random(1)
    a = prose(rng, 120).split()
    b = [*a[:24], "another", *a[25:72], "other", *a[73:]]
    c = [*b[:48], "changed", *b[49:96], "different", *b[97:]]
    texts = {i: " ".join(w) for i, w in enumerate((a, b, c))}
    s = [signatures(texts[i]) for i in range(3)]
    # all that c shares with b, a has too
    assert s[1] & s[2] <= s[0]
    assert links(spark, texts) == {(1, 0), (2, 1)}


def test_an_exact_repeat_is_found_whose_signatures_lead_elsewhere(spark):
    rng = random.Random(23)
    passage = prose(rng, 50).split()
    at = sorted(P.all_windows(P.Text(next(P._words(iter([one(" ".join(passage))]))).column("w")[0].as_py(), 46).sh, 46)[2].tolist())
    parts = [prose(rng, 25) + " " + " ".join(passage[c : c + 5]) + " " + prose(rng, 25) for c in at[:3]]
    texts = {0: " ".join(parts), 1: prose(rng, 60) + " " + " ".join(passage) + " " + prose(rng, 60), 2: " ".join(passage)}
    s = [signatures(texts[i]) for i in range(3)]
    assert len(s[0] & s[2]) == 3 and len(s[2] - s[0]) == 1 and s[2] <= s[1]
    assert links(spark, texts) == {(2, 1)}


def test_a_stretch_that_fails_is_judged_in_parts():
    def text(w):
        return P.Text(next(P._words(iter([one(" ".join(w))]))).column("w")[0].as_py(), 46)

    rng = random.Random(5)
    x, y, line = prose(rng, 60).split(), prose(rng, 60).split(), prose(rng, 12).split()
    # an insertion in the source
    got = P.passages(text([*x, *prose(rng, 30).split(), *y]), text([*x, *y]), 0.8)
    assert sorted((p, q) for p, q, *_ in got) == [(0, 55), (60, 115)]
    # a copy, and a line that both have at another distance
    copy = prose(rng, 200).split()
    got = P.passages(text([*copy, *prose(rng, 75).split(), *line]), text([*copy, *prose(rng, 15).split(), *line]), 0.8)
    assert [(p, q, u, v) for p, q, u, v, _ in got] == [(0, 195, 0, 195)]


def corpus(rng, documents, phrases, passages, near):
    """Texts of prose, common phrases and planted passages, some of which have a word changed here and there."""
    phrases = [prose(rng, rng.randint(8, 35)).split() for _ in range(phrases)]
    # a passage is made of common phrases too, so that its signatures lead to many documents without it
    planted = []
    for _ in range(passages):
        w = []
        while len(w) < rng.randint(50, 120):
            w += rng.choice(phrases) if rng.random() < 0.6 else prose(rng, rng.randint(3, 20)).split()
        planted.append(w)
    texts = {}
    for i in range(documents):
        parts = [prose(rng, rng.randint(1, 40)).split() for _ in range(rng.randint(1, 4))]
        parts += [rng.choice(phrases) for _ in range(rng.randint(0, 4))]
        for _ in range(rng.choice((0, 0, 1, 2))):
            w = list(rng.choice(planted))
            if rng.random() < near:
                for k in range(rng.randint(10, 40), len(w), 70):
                    w[k] = f"x{rng.randint(0, 10**6)}"
            parts.append(w)
        rng.shuffle(parts)
        texts[i] = [x for p in parts for x in p]
    return texts


def found_words(spark, texts):
    out = {i: set() for i in texts}
    for r in P.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect():
        assert r.source < r.doc_id and r.similarity >= 0.8
        a, b = (set(zip(*(t[k:] for k in range(5)))) for t in (texts[r.doc_id][r.start : r.stop], texts[r.source][r.source_start : r.source_stop]))
        assert abs(len(a & b) / len(a | b) - r.similarity) < 1e-9
        out[r.doc_id].update(range(r.start, r.stop))
    return out


def test_every_exact_repeat_of_fifty_words_is_found_against_brute_force(spark):
    for seed in range(3):
        texts = corpus(random.Random(seed), 250, 12, 10, 0.2)
        found = found_words(spark, texts)
        seen, missed, repeated = set(), [], 0
        for i in sorted(texts):
            windows = list(zip(*(texts[i][k:] for k in range(50))))
            for k, w in enumerate(windows):
                if w in seen:
                    repeated += 1
                    if not found[i].issuperset(range(k, k + 50)):
                        missed.append((i, k))
            seen.update(windows)
        assert repeated > 1000 and not missed, (seed, repeated, missed[:10])


def test_near_repeats_are_found_against_brute_force(spark):
    caught = total = 0
    for seed in (11,):
        texts = corpus(random.Random(seed), 160, 12, 10, 0.9)
        found = found_words(spark, texts)
        # every window of 60 words of a document against every one of smaller ids, by a count of common shingles
        gram = {i: [hash(g) for g in zip(*(w[k:] for k in range(5)))] for i, w in texts.items()}
        grid = []
        for i in sorted(texts):
            own = np.array([np.unique(gram[i][k : k + 56]) for k in range(0, len(gram[i]) - 55, 4) if len(set(gram[i][k : k + 56])) == 56])
            for row in own:
                if grid:
                    common = max(int(np.isin(g, row).sum(axis=1).max()) for g in grid)
                    if common / (112 - common) >= 0.8:
                        total += 1
                        k = next(k for k in range(0, len(gram[i]) - 55, 4) if set(gram[i][k : k + 56]) == set(row.tolist()))
                        caught += len(found[i] & set(range(k, k + 60))) >= 45
            if len(own):
                grid.append(own)
    assert total > 100 and caught >= 0.95 * total, (caught, total)
