import base64
import fnmatch
import hashlib
import random
import re

import pytest

from ripplet.llm import bpe, embed_dedup, url_filter, warc
from ripplet.llm.cluster import components, shared_dir


def test_automaton_against_regular_expressions():
    rng = random.Random(5)
    rules = [url_filter.Rule("block", "".join(rng.choice("ab.*?") for _ in range(rng.randint(1, 8))) + "/" + "".join(rng.choice("xy*?/") for _ in range(rng.randint(0, 9)))) for _ in range(40)]
    auto = url_filter.Automaton(rules)

    def fits(r, host, path):
        h, _, p = r.pattern.partition("/")
        to = lambda g: "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g)
        return re.fullmatch(r"(?:.*)\." + to(h), "." + host, re.S) and re.match(to("/" + p), path, re.S)

    urls = [("".join(rng.choice("ab.") for _ in range(rng.randint(0, 12))), "/" * rng.randint(0, 1) + "".join(rng.choice("xy/.a") for _ in range(rng.randint(0, 15)))) for _ in range(600)]
    got = auto.match([b"." + h.encode() + b"\xff" + p.encode() for h, p in urls])
    for (h, p), k in zip(urls, got):
        want = next((i for i, r in enumerate(auto.rules) if fits(r, h, p)), -1)
        assert k == want, (h, p, auto.rules[k].pattern, auto.rules[want].pattern)


def test_urls_with_odd_rows(spark):
    rows = [(1, "https://A.Example.NET/en/x?q#f", "n"), (2, None, None), (3, "no scheme", ""), (4, "http://example.net", ""), (4, "http://example.net", ""), (None, "ftp://x.example.com/de/", "")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), "page_id", "url", url_filter.RULES).collect()
    assert [tuple(r)[1:] for r in got] == [("a.example.net", "/en/x", "example.net/en/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.net", "", None, "allow"), ("example.net", "", None, "allow"), ("x.example.com", "/de/", "example.com/de/", "block")]


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}\n é", f"<p>{i % 7} text</p>" * 50) for i in range(60)] + [(70, None, None), (71, "u", ""), (None, "u", "x"), (5, "again", "<p>5 text</p>" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_warc(warc.write_warc(df, shared_dir(spark, "t"))).collect()
    assert len(got) == len(rows) and all(r.digest_ok in (True, None) for r in got)
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", -1))
    by = {i: h or "" for i, _, h in rows}
    for r in got:
        if r.page_id is None:
            assert r.record_type == "response"
            continue
        want = top[by[r.page_id]]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == want else ("revisit", want))
        assert r.payload_bytes == len(by[r.page_id].encode())


def test_warc_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(df, shared_dir(spark, "t"))).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(40, 12), (200, 50)])
def test_bpe_chunks_give_the_library_ids(spark, chunk, overlap):
    rng = random.Random(chunk)
    path, pattern = bpe.vocabulary()
    c = bpe.coder(path, pattern)
    parts = ["word ", "don't ", "  \n\n ", " ", "\x1c", "日本語のテキスト", "12 345", "!!! ", " x", "éà ", "<|endoftext|>", "🙂"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(60)] + [None, "", "a" * 1000, " " * 500, "x" * 39 + " y", "same text " * 30, "same text " * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "null id")], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip(df, "doc_id", "text", path, pattern, chunk, overlap).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        ids = c.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), (i, t)


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(None, 1), (2, 2)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_with_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.link(df, "vec_id", "embedding").collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False)} | {i: (0, i, True) for i in range(4, 12)}
    assert embed_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("block", [7, 2048])
def test_embeddings_against_brute_force_with_buckets_of_several_blocks(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(block)
    base = rng.standard_normal((30, 16))
    x = np.concatenate([base[rng.integers(0, 30, 300)] + rng.standard_normal((300, 16)) * rng.choice([0.05, 0.2, 0.3], 300)[:, None], base[:5], base[:5] * 3]).astype(np.float32)
    # pairs at the threshold itself: an angle in a plane
    for k, c in enumerate((0.9 - 1e-6, 0.9 - 1e-7, 0.9 + 1e-7, 0.9 + 1e-6)):
        two = np.zeros((2, 16), np.float32)
        two[0, 2 * k], two[1, 2 * k : 2 * k + 2] = 1, (c, np.sqrt(1 - c * c))
        x = np.concatenate([x, two])
    ids = [int(i) for i in rng.permutation(len(x))]
    rows = [(i, v.tolist(), "a", "b", 1, "c") for i, v in zip(ids, x)] + [(None, x[0].tolist(), "a", "b", 1, "c"), (ids[3], x[3].tolist(), "a", "b", 1, "c"), (5000, None, "a", "b", 1, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, class string, v string, n int, cid string")
    got = embed_dedup.link(df, "vec_id", "embedding").collect()
    y = np.array([r[1] or [0.0] * 16 for r in rows], np.float64)
    y /= np.maximum(np.sqrt((y * y).sum(axis=1)), 1e-300)[:, None]
    linked = y @ y.T >= 0.9
    np.fill_diagonal(linked, False)
    key = [r[0] for r in rows]
    comp = {i: i for i in key if i is not None}
    while True:
        low = {i: min([comp[i], *(comp[key[b]] for a in range(len(key)) if key[a] == i for b in np.flatnonzero(linked[a]) if key[b] is not None)]) for i in comp}
        if low == comp:
            break
        comp = low
    want = sorted((str(i), int(n.sum()), str(comp.get(i))) for i, n in zip(key, linked))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == want


def frames(data):
    """(dictionary, sizes of the frames after it, their contents) of an archive, by the library's frame readers."""
    import zstandard

    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    size = int.from_bytes(data[4:8], "little")
    raw, rest, sizes, records = data[8 : 8 + size], data[8 + size :], [], []
    while rest:
        o = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).decompressobj()
        records.append(o.decompress(rest))
        sizes.append(len(rest) - len(o.unused_data))
        rest = o.unused_data
    return raw, sizes, records


@pytest.mark.parametrize("pages,size", [(1, 10), (3, 400), (40, 2_000), (30, 250_000), (3, 3_000_000)])
def test_every_archive_begins_with_a_dictionary_that_helps_and_has_a_frame_a_record(pages, size):
    import zstandard

    rng = random.Random(pages)
    words = [f"<p class='c{i}'>" + "".join(rng.choice("abcdefgh ") for _ in range(40)) + "</p>" for i in range(300)]
    records = [warc.record(i, f"http://h/{i}", "".join(rng.choice(words) for _ in range(1 + size // 50)).encode()[:size], "X", None) for i in range(pages)]
    raw, sizes, got = frames(warc.pack(records))
    assert got == records and len(sizes) == pages and raw
    if pages > 3:
        assert len(raw) > 1000 and zstandard.ZstdCompressionDict(raw).dict_id()
        plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
        assert sum(sizes) < plain


def test_warc_with_large_pages_several_archives_a_task_and_clashing_names(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(warc, "FILE_BYTES", 700_000)
    rows = [(i, f"http://h/{i}", f"{i % 5} " * 150_000, "x", "y", "z", "w") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, id string, payload string, sha string, refers string").coalesce(1)
    listed = warc.write_warc(df, shared_dir(spark, "t"))
    assert listed.count() > 1 and listed.selectExpr("sum(records)").first()[0] == 9
    for r in listed.collect():
        raw, sizes, _ = frames(open(r.path.removeprefix("file://"), "rb").read())
        assert raw and len(sizes) == r.records
    got = {r.page_id: r for r in warc.read_warc(listed).collect()}
    for i, _, h, *_ in rows:
        top = max(j for j, _, x, *_ in rows if x == h)
        assert (got[i].payload_bytes, got[i].refers_to) == (len(h), None if i == top else top)
        assert base64.b32decode(got[i].payload_digest) == hashlib.sha1(h.encode()).digest()
