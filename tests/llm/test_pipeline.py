import hashlib
import random


import corpus_pipeline
from ripplet.llm import bpe

VOWELS = {"en": "aeiou", "de": "äöüei"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice(VOWELS[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n))


def brute(rows, items):
    """Survivors by id with their texts: the near-duplicate, passage and benchmark rules by plain loops."""
    words = lambda t: t.split()
    grams = lambda t, n=5: {tuple(words(t.lower())[i : i + n]) for i in range(max(1, len(words(t)) - n + 1))}
    left = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        if t is None or not any(c.isalpha() for c in t) or i in left:
            continue
        g = grams(t)
        if not any(100 * len(g & grams(u)) >= 85 * len(g | grams(u)) for u in left.values()):
            left[i] = t
    done = {}
    for i, t in left.items():
        w, cut = words(t), set()
        for u in [u for j, u in left.items() if j < i]:
            v = grams(u, 50)
            for k in range(len(w) - 49):
                if tuple(x.lower() for x in w[k : k + 50]) in v:
                    cut.update(range(k, k + 50))
        rest = [x for k, x in enumerate(w) if k not in cut]
        for item in items:
            b = words(item)
            for size in [13]:
                windows = {tuple(b[k : k + size]) for k in range(len(b) - size + 1)}
                hit = {k + d for k in range(len(rest) - size + 1) if tuple(rest[k : k + size]) in windows for d in range(size)}
                rest = [x for k, x in enumerate(rest) if k not in hit]
        if rest:
            done[i] = rest
    return done


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    rows = [(i, prose(rng, lang, rng.randint(60, 200)), lang, "s", 0, "more") for i, lang in enumerate(["en", "de"] * 30)]
    text = lambda i: rows[i][1]
    item, passage = prose(rng, "en", 40), prose(rng, "en", 80)
    rows[7] = (7, text(7) + " " + item, *rows[7][2:])
    rows[10] = (10, text(10) + "\n" + passage, *rows[10][2:])
    rows[31] = (31, passage + " " + text(31), *rows[31][2:])
    rows += [(100, text(4), "en", "s", 0, ""), (101, text(5).replace(" ", "  ") + " changed", "de", "s", 0, ""), (102, None, "en", "s", 0, ""), (103, "12 34 !", None, "s", 0, ""), (104, item, "en", "s", 0, ""), (9, text(9), "de", "s", 0, "more")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("q", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(rows, [item])
    assert 104 not in want and 100 not in want and 101 not in want and 31 in want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    got = {r.doc_id: r for r in docs.collect()}
    assert {i: r.text.split() for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    coder = bpe.coder(*bpe.vocabulary())
    assert last.keys() == got.keys()
    for i, r in last.items():
        ids = coder.encode_ordinary(got[i].text)
        assert bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in ids) and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(got[i].text.encode()).hexdigest()


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_documents_with_a_similarity_of_four_fifths_are_near_duplicates(spark):
    words = [f"w{i}" for i in range(104)]
    # one change in the middle of 100 shingles costs each side five: 95 of 105; two cost ten: 90 of 110
    near = [*words[:30], "other", *words[31:70], "another", *words[71:]]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    common, total = len(grams(words) & grams(near)), len(grams(words) | grams(near))
    assert 80 * total <= 100 * common < 85 * total
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "something else altogether")], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, None).collect()} == {1, 3}


def test_stages_survive_columns_with_clashing_names(spark, tmp_path):
    rng = random.Random(3)
    names = ["score", "rejected", "lang_pred", "n_words", "n_hit", "items", "spans", "row", "start", "stop", "source_start", "id", "key", "kept", "component_id", "n_shingles", "w", "keys", "c0", "ids"]
    rows = [(i, prose(rng, lang, 80), lang, "s", 0, *names) for i, lang in enumerate(["en", "de"] * 12)]
    item = prose(rng, "en", 20)
    rows[3] = (3, rows[3][1] + " " + item, *rows[3][2:])
    rows[5] = (5, rows[5][1] + " " + rows[1][1], *rows[5][2:])
    spark.createDataFrame([("q", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.schema.names == docs.schema.names
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
    left = {r.doc_id: r for r in docs.collect()}
    assert len(left) == 24 and item not in left[3].text and rows[1][1] not in left[5].text
    assert all(tuple(r)[5:] == tuple(names) for r in left.values()) and out.count() == 24
