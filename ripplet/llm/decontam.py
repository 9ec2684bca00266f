"""Benchmark decontamination: an FM-index per shard of the corpus, searched for the windows of the benchmark.

A shard is a run of whole documents of about SHARD_BYTES (a longer document is a shard of its own). Its words are coded by
the benchmark's vocabulary; other words and the ends of documents are separators, each of which sorts as a symbol of
its own, so that no match crosses one. Stretches shorter than the shortest window can't hold an occurrence and are left
out; everything else of the shard is indexed: suffixes are sorted, the Burrows-Wheeler transform goes into a wavelet
matrix, and every SAMPLE-th position of a stretch is kept. All windows are searched backwards at once by rank queries;
occurrences are located by stepping back to a sampled position, and merged into the spans to remove.

The benchmark is read in blocks of about BLOCK_WORDS words (an item of more is read in pieces that overlap by a window less a
word), one at a time by the driver, and one at a time is sent to the workers: at a window of 13 words a block takes some
25 MB there. With several blocks the rows are numbered and stored, each block's hits are found in a pass of its own,
and merged by row; the result is that of one block.

Defined cases: null or empty text, or text without words: 0 words, not contaminated, no spans. Items without words are ignored; items with
equal windows each count, but rows of the same item id as one. Null item ids count as the empty string. Repeated rows and null ids give a row each. Empty
tables: no rows, or rows without hits. Further columns, whatever their names, are ignored by `decontaminate` and carried along by
`remove_hits`. A text is held whole by its task, with about 60 bytes for each byte of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.llm.cluster import in_arrow, ship, split, store
from ripplet.llm.lexing import NOT_WORD, U, Words, slices, texts

WINDOW, SHARD_BYTES, SAMPLE, BLOCK_WORDS = 13, 2_000_000, 8, 400_000


class Benchmark:
    """The distinct windows of some items.

    words: sorted word hashes; windows: (matrix of codes, number of the first) for each length; the items of window n are
    item[start[n]:start[n + 1]], and ids has their names.
    """

    def __init__(self, ids: list[str], column: pa.Array, window: int):
        w = Words(*texts(column), NOT_WORD)
        h = w.hashes()
        self.ids, self.words = ids, np.unique(h)
        code = np.searchsorted(self.words, h).astype(np.int32) + 1
        count = np.diff(w.first)
        self.windows: list[tuple[np.ndarray, int]] = []
        numbers, owners, base = [], [], 0
        for n in sorted({*np.minimum(count, window).tolist()} - {0}):
            some = np.flatnonzero(np.minimum(count, window) == n)
            per = count[some] - n + 1
            owner = np.repeat(some, per)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per) + w.first[owner]
            rows = np.ascontiguousarray(code[at[:, None] + np.arange(n)])
            _, first, inverse = np.unique(rows.view(np.dtype((np.void, rows.itemsize * n))).ravel(), return_index=True, return_inverse=True)
            self.windows.append((rows[first], base))
            numbers.append(inverse + base)
            owners.append(owner)
            base += len(first)
        pairs = np.unique(np.concatenate(numbers).astype(np.int64) * max(1, len(ids)) + np.concatenate(owners)) if numbers else np.zeros(0, np.int64)
        self.count = base
        self.start = np.searchsorted(pairs // max(1, len(ids)), np.arange(base + 1))
        self.item = (pairs % max(1, len(ids))).astype(np.int32)
        self.shortest = self.windows[0][0].shape[1] if self.windows else 0
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.words >> U(48)).astype(np.int64)] = True

    def codes(self, h: np.ndarray) -> np.ndarray:
        """The code of each word hash, 0 for words that the benchmark lacks."""
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.filter[(h >> U(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, h[maybe]), len(self.words) - 1)
        hit = self.words[at] == h[maybe]
        out[maybe[hit]] = at[hit] + 1
        return out


class Bits:
    """A bit vector with rank in constant time: packed words and the count before each."""

    def __init__(self, bit: np.ndarray):
        n = len(bit) // 64 + 1
        padded = np.zeros(n * 64, np.uint8)
        padded[: len(bit)] = bit
        self.word = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.word).astype(np.int64))])
        self.zeros = int(len(bit) - self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        mask = (U(1) << (i & 63).astype(np.uint64)) - U(1)
        return self.before[w] + np.bitwise_count(self.word[w] & mask)


class FMIndex:
    """Over a sequence of symbols; 0 is a separator. Stretches begin after a separator or at the start."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        n = len(symbols)
        order = self._suffixes(symbols)
        before = symbols[order - 1]
        before[order == 0] = 0
        self.count = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))])
        self.levels: list[Bits] = []
        self.width = max(1, int(alphabet).bit_length())
        row = before
        for k in reversed(range(self.width)):
            bit = (row >> k) & 1
            self.levels.append(Bits(bit))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.before = before
        at = np.arange(n)
        start = np.maximum.accumulate(np.where((symbols == 0), at + 1, 0))
        self.sampled = Bits(((at - start) % SAMPLE == 0)[order] | (symbols[order] == 0))
        self.position = order[((at - start) % SAMPLE == 0)[order] | (symbols[order] == 0)]

    @staticmethod
    def _suffixes(symbols: np.ndarray) -> np.ndarray:
        """Suffix order where each separator is a symbol of its own, smaller than all others: by prefix doubling of the suffixes that are still tied."""
        n = len(symbols)
        at = np.arange(n)
        sep = symbols == 0
        order = np.argsort(np.where(sep, at, symbols + n), kind="stable")
        key = np.where(sep, at, symbols + n)[order]
        rank = np.zeros(n + 1, np.int64)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order] = np.maximum.accumulate(np.where(new, at, 0))
        step = 1
        while True:
            own = rank[order]
            tied = np.zeros(n, bool)
            tied[1:] = own[1:] == own[:-1]
            tied[:-1] |= tied[1:]
            some = np.flatnonzero(tied)
            if not len(some):
                return order
            p = order[some]
            group = rank[p]
            nxt = rank[np.minimum(p + step, n)]
            nxt[p + step >= n] = -1
            by = np.lexsort((nxt, group))
            order[some] = p[by]
            g, x = group[by], nxt[by]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])])
            rank[p[by]] = np.maximum.accumulate(np.where(new, some, 0))
            step *= 2

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before position i."""
        start = np.zeros_like(i)
        for k, bits in zip(reversed(range(self.width)), self.levels):
            one = ((symbol >> k) & 1).astype(bool)
            ri, rs = bits.rank(i), bits.rank(start)
            i = np.where(one, bits.zeros + ri, i - ri)
            start = np.where(one, bits.zeros + rs, start - rs)
        return i - start

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every occurrence of the rows of `windows`."""
        some = np.arange(len(windows))
        lo = self.count[windows[:, -1]]
        hi = self.count[windows[:, -1] + 1]
        for k in range(windows.shape[1] - 2, -1, -1):
            keep = lo < hi
            some, lo, hi = some[keep], lo[keep], hi[keep]
            if not len(some):
                break
            c = windows[some, k]
            lo, hi = self.count[c] + self.rank(c, lo), self.count[c] + self.rank(c, hi)
        keep = lo < hi
        some, lo, hi = some[keep], lo[keep], hi[keep]
        n = hi - lo
        row = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        window, out, back = np.repeat(some, n), np.zeros(len(row), np.int64), 0
        left = np.arange(len(row))
        while len(left):
            r = row[left]
            here = self.sampled.rank(r + 1) > self.sampled.rank(r)
            out[left[here]] = self.position[self.sampled.rank(r[here])] + back
            left = left[~here]
            r = row[left]
            c = self.before[r]
            row[left] = self.count[c] + self.rank(c, r)
            back += 1
        return window, out


def find(w: Words, bench: Benchmark) -> tuple[np.ndarray, list[set[str]]]:
    """(which words are hit, the items that occur in each row)."""
    rows = len(w.off) - 1
    edge, items = np.zeros(len(w.start) + 1, np.int64), [set() for _ in range(rows)]
    h = w.hashes()
    code = bench.codes(h) if bench.shortest and len(h) else np.zeros(0, np.int64)
    if not code.any():
        return np.zeros(len(h), bool), items
    # stretches: runs of known words within a document
    cut = np.ones(len(code), bool)
    cut[1:] = (code[1:] == 0) | (code[:-1] == 0) | (w.doc[1:] != w.doc[:-1])
    begin = np.flatnonzero(cut)
    size = np.diff(np.concatenate([begin, [len(code)]]))
    use = (size >= bench.shortest) & (code[begin] > 0)
    begin, size = begin[use], size[use]
    if not len(begin):
        return np.zeros(len(h), bool), items
    total = int(size.sum()) + len(size)
    where = np.full(total, -1, np.int64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    slot = np.repeat(np.cumsum(size + 1) - size - 1, size) + inner
    where[slot] = np.repeat(begin, size) + inner
    index = FMIndex(np.where(where >= 0, code[where], 0), len(bench.words))
    for windows, base in bench.windows:
        which, at = index.search(windows)
        first = where[at]
        edge += np.bincount(first, minlength=len(edge))
        edge -= np.bincount(first + windows.shape[1], minlength=len(edge))
        for x in np.unique(w.doc[first] * bench.count + which + base).tolist():
            d, n = divmod(x, bench.count)
            items[d].update(bench.ids[i] for i in bench.item[bench.start[n] : bench.start[n + 1]].tolist())
    return np.cumsum(edge[:-1]) > 0, items


def runs(w: Words, hit: np.ndarray) -> list[list[tuple[int, int]]]:
    """The runs of hit words of each row, by word numbers of the batch."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(w.off) - 1)]
    for a, z in np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).reshape(-1, 2).tolist():
        while a < z:  # a run may go on in the next document
            d = int(w.doc[a])
            stop = min(z, int(w.first[d + 1]))
            out[d].append((a, stop))
            a = stop
    return out


def load(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded size, in the order of its ids; at least one."""
    ids, held, size, some = [], [], 0, False
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.coalesce(text, F.lit("")).alias("t")).orderBy("i", "t")
    for r in rows.toLocalIterator():
        raw = r.t.encode()
        w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NOT_WORD)
        piece = max(BLOCK_WORDS, 2 * window)
        for at in range(0, max(1, len(w.start) - window + 1), piece - window + 1):
            part = raw[int(w.start[at]) : int(w.end[min(at + piece, len(w.end)) - 1])] if len(w.start) else b""
            ids.append(r.i)
            held.append(part.decode())
            size += min(piece, len(w.start) - at)
            if size >= BLOCK_WORDS:
                yield Benchmark(ids, pa.array(held, pa.string()), window)
                ids, held, size, some = [], [], 0, True
    if ids or not some:
        yield Benchmark(ids, pa.array(held, pa.string()), window)


def _search(docs: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str, window: int, result, schema) -> DataFrame:
    """What `result` makes of (batch, its words, which of them are hit, items of each row); the batch's columns are c0, c1, ..."""
    spark = docs.sparkSession
    ship(spark)
    t = f"c{docs.columns.index(text)}"
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    blocks = load(benchmark, item, item_text, window)
    shared, following = spark.sparkContext.broadcast(next(blocks)), next(blocks, None)

    def words(b: pa.RecordBatch) -> Words:
        return Words(*texts(b.column(t)), NOT_WORD)

    if following is None:

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch, t, SHARD_BYTES):
                    w = words(b)
                    yield result(b, w, *find(w, shared.value))

        return rows.transform(in_arrow, once, schema)
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    parts = []
    while shared:

        def hits(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch, t, SHARD_BYTES):
                    w = words(b)
                    hit, items = find(w, shared.value)
                    found = [(row, [x - int(w.first[d]) for a in own for x in a], sorted(named)) for d, (row, own, named) in enumerate(zip(b.column("row").to_pylist(), runs(w, hit), items)) if own]
                    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["row", "ends", "items"])

        parts.append(store(rows.select(t, "row").transform(in_arrow, hits, "row long, ends array<long>, items array<string>"), "block-hits"))
        shared.destroy()
        shared, following = spark.sparkContext.broadcast(following) if following else None, next(blocks, None)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = store(found.groupBy("row").agg(F.flatten(F.collect_list("ends")).alias("ends"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "hits")
    touched, clean = split(rows, "row", found.select("row"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, t, SHARD_BYTES):
                w = words(b)
                edge = np.zeros(len(w.start) + 1, np.int64)
                for d, ends in enumerate(b.column("ends").to_pylist()):
                    np.add.at(edge, np.array(ends or [], np.int64) + w.first[d], np.tile([1, -1], len(ends or []) // 2))
                yield result(b, w, np.cumsum(edge[:-1]) > 0, [set(x or []) for x in b.column("items").to_pylist()])

    nothing = clean.selectExpr("*", "cast(null as array<long>) as ends", "cast(null as array<string>) as items")
    return touched.join(found, "row").select(nothing.columns).unionByName(nothing).transform(in_arrow, merge, schema)


SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:int,stop:int>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated, items, spans).

    spans: merged runs of hit words as byte positions in the UTF-8 text.
    """

    def result(b: pa.RecordBatch, w: Words, hit: np.ndarray, items: list[set[str]]) -> pa.RecordBatch:
        words, total = np.diff(w.first), np.concatenate([[0], np.cumsum(hit)])
        per = total[w.first[1:]] - total[w.first[:-1]]
        named = [sorted(x) for x in items]
        spans = [[{"start": int(w.start[a] - w.off[d]), "stop": int(w.end[z - 1] - w.off[d])} for a, z in own] for d, own in enumerate(runs(w, hit))]
        return pa.RecordBatch.from_arrays(
            [
                b.column("c0"),
                pa.array(words, pa.int64()),
                pa.array(per, pa.int64()),
                pa.array([len(x) for x in named], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], pa.string()),
                pa.array((per > 0) & (20 * per >= words), pa.bool_()),
                pa.array(named, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            ],
            [key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
        )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return _search(rows, "text", benchmark, item, item_text, window, result, f"`{key}` {docs.schema[key].dataType.simpleString()}, {SCHEMA}")


def remove_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` with the hit words cut out, from the first to the last of each run; documents of which no word is left by that go."""
    cols = docs.columns
    at = cols.index(text)

    def result(b: pa.RecordBatch, w: Words, hit: np.ndarray, items: list[set[str]]) -> pa.RecordBatch:
        own = {d: x for d, x in enumerate(runs(w, hit)) if x}
        arrays, keep = [b.column(f"c{i}") for i in range(len(cols))], np.ones(b.num_rows, bool)
        if own:
            out = arrays[at].to_pylist()
            for d, x in own.items():
                raw, stop, parts = w.buf[w.off[d] : w.off[d + 1]].tobytes(), 0, []
                for a, z in x:
                    parts.append(raw[stop : int(w.start[a] - w.off[d])])
                    stop = int(w.end[z - 1] - w.off[d])
                rest = b"".join([*parts, raw[stop:]])
                out[d], keep[d] = rest.decode(), bool((~NOT_WORD[np.frombuffer(rest, np.uint8)]).any())
            arrays[at] = pa.array(out, arrays[at].type)
        return pa.RecordBatch.from_arrays(arrays, cols).filter(pa.array(keep))

    return _search(docs, text, benchmark, item, item_text, window, result, docs.schema)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, bench).drop("items", "spans")


ORACLE = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
bw as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bn as (select item_id, unnest(list_transform(range(1, greatest(2, len(ws) - 11)), lambda i: array_to_string(ws[i : i + 12], ' '))) as g, least(13, len(ws)) as n from bw where len(ws) > 0),
n as (select distinct n from bn),
dn as (select doc_id, n, unnest(range(1, cast(len(ws) - n + 2 as bigint))) as i, ws from dw, n where len(ws) >= n),
hit as (select distinct doc_id, i, dn.n, item_id from dn join bn on bn.n = dn.n and bn.g = array_to_string(dn.ws[i : cast(i + dn.n - 1 as bigint)], ' ')),
pos as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, cast(i + n as bigint))) as p from (select distinct doc_id, i, n from hit)) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from hit) group by doc_id)
select dw.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from dw left join pos on pos.doc_id = dw.doc_id left join it on it.doc_id = dw.doc_id
"""
