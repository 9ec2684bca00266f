"""Substring dedup: near-duplicate passages of different documents, by compact windows.

A text is the sequence of its 5-word shingles. For each of HASHES hash functions, the compact windows of a text are the
nodes of the Cartesian tree over its shingles' hashes that span at least `least` words: node (l, c, r) stands for all
subsequences within l..r that hold c, whose min-hash is c's; texts that share a signature (function, shingle at c) so
share subsequences with equal min-hash.

1. Every text's windows of BANDS pairs of functions, by sliding minima (a node spans enough words exactly if it is a minimum of
   some subsequence of `least` words). Where a window of one function and one of the other of its pair meet in `least` words or
   more, both values are a key: the interval join of a text's own windows.
2. Documents that share a key meet at the smallest of their ids: a star for each key, never all pairs.
3. For each pair the windows of both are joined again by signature; a seed grows to the longest stretch whose shingles
   agree in the given proportion, along one diagonal with some drift, and the Jaccard similarity of both passages' full
   shingle sets has the last word; a stretch that fails is parted where it jumps, and its parts are judged.
4. The smallest id of a key may lack the passage that others of the key share. A document none of whose passages holds
   the key's minima looks again, at the smallest id among those that are left like it; and wherever `least` words in a row
   have all their keys in common with others but lie in no passage yet, the documents with the very same words meet.

A passage that is repeated exactly, with `least` words or more, shares all keys of its words, whatever surrounds it, and so
is found in 2 or 4 for certain. One at the lowest similarity and length shares no key with a chance of (1 - 0.8**2)**BANDS =
0.017; longer ones have more windows. Every step is linear in keys; nothing is capped.

Defined cases: null, empty and short texts repeat nothing; null ids are left out; of repeated ids every row counts, but a
document never matches itself; empty tables give empty tables. Further columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.llm.cluster import discard, in_arrow, only, ship, split, store
from ripplet.llm.lexing import SPACE, U, Words, mix, shingles, slices, texts

HASHES, SHINGLE, LEAST, SIMILAR = 4, 5, 50, 0.8
#: Pairs of functions by whose common minima documents meet; records that are combined before they are shuffled, and documents of a key in these from which on they are.
BANDS, COMBINED, HOT = 4, 500_000, 64
#: Shingles by which the two passages of a pair may drift apart; unmatched shingles in a row that end a passage.
DRIFT, GAP = 64, 24
_rng = np.random.Generator(np.random.PCG64(909))
_FUNCTION = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_LOW = U(0xFFFFFFFF)


def values(sh: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.uint64]:
    """(hash of each shingle with its position in the low bits, mask of these).

    A shingle like the one before it adds nothing to a set and is never the smallest: a word said a hundred times is no hundred windows.
    """
    n = len(sh)
    low = (U(1) << U(max(1, (n - 1).bit_length()))) - U(1)
    v = mix(sh * _FUNCTION[k]) & ~low
    v[1:][(sh[1:] == sh[:-1]) & (row[1:] == row[:-1])] = ~low
    return v | np.arange(n, dtype=np.uint64), low


def minima(sh: np.ndarray, row: np.ndarray, span: int, k: int) -> np.ndarray:
    """Positions whose node in the Cartesian tree of function k spans at least `span` shingles of one row."""
    n = len(sh)
    if n < span:
        return np.zeros(0, np.int64)
    v, low = values(sh, row, k)
    width = 1
    while width * 2 <= span:
        v = np.minimum(v[: len(v) - width], v[width:])
        width *= 2
    if width < span:
        v = np.minimum(v[: n - span + 1], v[span - width :])
    v = v[row[: n - span + 1] == row[span - 1 :]]
    if not len(v):
        return np.zeros(0, np.int64)
    keep = np.ones(len(v), bool)
    keep[1:] = v[1:] != v[:-1]
    return (v[keep] & low).astype(np.int64)


def windows(sh: np.ndarray, span: int, k: int) -> list[tuple[int, int, int]]:
    """The compact windows (l, c, r) of one text for function k."""
    row = np.zeros(len(sh), np.int8)
    at = minima(sh, row, span, k)
    v = values(sh, row, k)[0][at].tolist() if len(at) else []
    # the smaller neighbours of a node that spans enough span enough themselves, so the nodes are enough to find the ends
    left, right, stack = [0] * len(v), [len(sh) - 1] * len(v), []
    for i, x in enumerate(v):
        while stack and v[stack[-1]] > x:
            right[stack.pop()] = int(at[i]) - 1
        if stack:
            left[i] = int(at[stack[-1]]) + 1
        stack.append(i)
    return list(zip(left, at.tolist(), right))


class Runs:
    """Of each band, the runs of windows of `span` shingles that have the same two minima: the places where a compact window of either function meet.

    Of band b: key[b], row[b], first[b] (the first window), low[b] and high[b] (the places of the minima); ok: the windows within one row.
    """

    def __init__(self, sh: np.ndarray, row: np.ndarray, span: int):
        n = len(sh)
        self.count = max(0, n - span + 1)
        self.ok = row[: self.count] == row[n - self.count :] if self.count else np.zeros(0, bool)
        self.key, self.row, self.first, self.low, self.high = [], [], [], [], []
        for band in range(BANDS if self.ok.any() else 0):
            m = []
            for k in (2 * band, 2 * band + 1):
                v, low = values(sh, row, k)
                width = 1
                while width * 2 <= span:
                    v = np.minimum(v[: len(v) - width], v[width:])
                    width *= 2
                m.append(np.minimum(v[: self.count], v[span - width : span - width + self.count]) if width < span else v)
            new = np.ones(self.count, bool)
            new[1:] = (m[0][1:] != m[0][:-1]) | (m[1][1:] != m[1][:-1]) | ~self.ok[:-1]
            at = np.flatnonzero(new & self.ok)
            x, y = ((v[at] & low).astype(np.int64) for v in m)
            self.key.append(mix(mix(sh[x] + U(band + 1)) + sh[y] * _FUNCTION[63]).view(np.int64))
            self.row.append(row[at])
            self.first.append(at)
            self.low.append(np.minimum(x, y))
            self.high.append(np.maximum(x, y))

    def windows(self, band: int, chosen: np.ndarray) -> np.ndarray:
        """Which windows lie in a chosen run of the band."""
        edge = np.zeros(self.count + 1, np.int8)
        edge[self.first[band]] = 1
        run = np.maximum(np.cumsum(edge[:-1], dtype=np.int64) - 1, 0)
        return chosen[run] & self.ok if len(chosen) else np.zeros(self.count, bool)


KEYS = "key long, id long, source long, local boolean"
_KEYS = ["key", "id", "source", "local"]


def _combined(key: np.ndarray, ident: np.ndarray) -> pa.RecordBatch:
    """One row for each key and id, without a source. Of a key with HOT ids or more the smallest has itself as source, and the others, that are local, have it."""
    order = np.lexsort((ident, key))
    key, ident = key[order], ident[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])
    key, ident = key[new], ident[new]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(key)))
    hot = np.repeat(size >= HOT, size)
    local = hot.copy()
    local[first] = False
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ident), pa.array(np.repeat(ident[first], size), mask=~hot), pa.array(local)], _KEYS)


def _merged(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """`_combined` of (keys, ids) in portions of about COMBINED records."""
    held, size = [], 0
    for key, ident in parts:
        held.append((key, ident))
        size += len(key)
        if size >= COMBINED:
            yield _combined(*(np.concatenate(x) for x in zip(*held)))
            held, size = [], 0
    if size:
        yield _combined(*(np.concatenate(x) for x in zip(*held)))


def _signatures(span: int):
    def parts(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for b in slices(batch, "text"):
                w = Words(*texts(b.column("text")), SPACE)
                sh, starts = shingles(w.hashes() & _LOW, w.first, SHINGLE)
                runs = Runs(sh, np.repeat(np.arange(len(starts) - 1), np.diff(starts)), span)
                ids = b.column("id").to_numpy(zero_copy_only=False)
                for key, row in zip(runs.key, runs.row):
                    # a text's runs of one key need one record
                    keep = np.unique(mix(key.view(np.uint64) + row.astype(np.uint64) * _FUNCTION[62]), return_index=True)[1]
                    yield key[keep], ids[row[keep]]

    return lambda batches: _merged(parts(batches))


def _centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of key and id: each gets the smallest id of its key as source; a key of one document goes. Local rows pass."""
    last: tuple[int, int] | None = None  # the key that the batches before ended in, and its smallest id
    held: pa.RecordBatch | None = None  # its row, as long as no other has met it
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ident = (batch.column(c).to_numpy() for c in ("key", "id"))
        raw = batch.column("source")
        source = raw.fill_null(-1).to_numpy()
        alone = raw.is_null().to_numpy(zero_copy_only=False)
        own = np.flatnonzero(~batch.column("local").to_numpy(zero_copy_only=False))
        passed = np.ones(len(key), bool)
        passed[own] = False
        if len(own):
            k, i = key[own], ident[own]
            head = np.ones(len(k), bool)
            head[1:] = k[1:] != k[:-1]
            goes_on = last is not None and int(k[0]) == last[0]
            first = np.flatnonzero(head)
            size = np.diff(np.append(first, len(k)))
            centre = i[first].copy()
            if goes_on:
                centre[0] = last[1]
                if held is not None:
                    yield held
                    held = None
            centre = np.repeat(centre, size)
            several = np.repeat(size > 1, size)
            if goes_on:
                several[: size[0]] = True
            shared = several | ~alone[own]
            source = source.copy()
            source[own] = centre
            passed[own] = shared
            last = (int(k[-1]), int(centre[-1]))
            held = None if shared[-1] else pa.RecordBatch.from_arrays([pa.array(k[-1:]), pa.array(i[-1:]), pa.array(centre[-1:]), pa.array([False])], _KEYS)
        some = np.flatnonzero(passed)
        yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(ident[some]), pa.array(source[some]), batch.column("local").take(pa.array(some))], _KEYS)


def _stars(keys: DataFrame, name: str) -> DataFrame:
    """(key, id, source) of the documents of every key that several have; source: the smallest id. A stored table.

    Of a hot key a row a portion is shuffled; the rows that were combined then meet that one's source in a join, which has
    one row a key on its other side and so can be split where it is skewed.
    """
    place = F.when(F.col("local"), F.xxhash64("id")).otherwise(F.col("key"))
    met = keys.withColumn("place", place).repartition("place").drop("place").sortWithinPartitions("key", "id").transform(in_arrow, _centred, KEYS)
    met = store(met, name)
    hot = met.where("local").select("key", "id")
    if hot.isEmpty():
        return _with_path(met.drop("local"), met)
    centres = met.join(hot.select("key").distinct(), "key", "left_semi").where("not local").groupBy("key").agg(F.min("source").alias("source"))
    out = store(met.where("not local").drop("local").unionByName(hot.join(centres, "key").select("key", "id", "source")), name)
    discard(met)
    return out


def _with_path(df: DataFrame, stored: DataFrame) -> DataFrame:
    df._ripplet_path = stored._ripplet_path
    return df


def nodes(sh: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(function, c) of the compact windows of one text for every function, by place."""
    n = len(sh)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.zeros(n, np.int8)
    v = np.stack([values(sh, row, k)[0] for k in range(HASHES)])
    low = (U(1) << U(max(1, (n - 1).bit_length()))) - U(1)
    m, width = v, 1
    while width * 2 <= span:
        m = np.minimum(m[:, : m.shape[1] - width], m[:, width:])
        width *= 2
    if width < span:
        m = np.minimum(m[:, : n - span + 1], m[:, span - width :])
    new = np.ones(m.shape, bool)
    new[:, 1:] = m[:, 1:] != m[:, :-1]
    k, at = np.nonzero(new)
    c = (m[k, at] & low).astype(np.int64)
    order = np.argsort(c, kind="stable")
    return k[order], c[order]


def all_windows(sh: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function, l, c, r) of the compact windows of one text for every function, by place; the same as `windows`, at once."""
    k, c = nodes(sh, span)
    left, right, row = np.zeros(len(c), np.int64), np.full(len(c), len(sh) - 1), np.zeros(len(sh), np.int8)
    for f in range(HASHES):
        own = np.flatnonzero(k == f)
        x, places, stack = values(sh, row, f)[0][c[own]].tolist(), c[own].tolist(), []
        for i, value in enumerate(x):
            while stack and x[stack[-1]] > value:
                right[own[stack.pop()]] = places[i] - 1
            if stack:
                left[own[i]] = places[stack[-1]] + 1
            stack.append(i)
    return k, left, c, right


class Text:
    """A text of a pair: its shingles and, made when they are asked for, their order and its windows by signature."""

    def __init__(self, word: bytes, span: int):
        w = np.frombuffer(word, np.uint32).astype(np.uint64)
        self.sh, _ = shingles(w, np.array([0, len(w)]), SHINGLE)
        self.span = span

    @cached_property
    def order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingles in order, their places, key of value and place): among equal ones places ascend."""
        place = np.argsort(self.sh, kind="stable")
        value = self.sh[place]
        rank = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]]))
        return value, place, rank

    @cached_property
    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """(signature, place) of the compact windows, by place."""
        k, c = nodes(self.sh, self.span)
        return self.sh[c] + _FUNCTION[k], c

    @cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """The same, by signature; among equal ones places ascend."""
        signature, c = self.nodes
        order = np.argsort(signature, kind="stable")
        return signature[order], c[order]


def aligned(a: Text, b: np.ndarray, at: int, shift: int) -> np.ndarray:
    """For each shingle of b, the first of which has place `at`, the place of an equal one of a within DRIFT of (its own place + shift); -1 without."""
    value, place, rank = a.order
    n = len(value)
    out = np.full(len(b), -1, np.int64)
    first = np.minimum(np.searchsorted(value, b), n - 1)
    some = np.flatnonzero(value[first] == b)
    key = rank * (2 * n + 2) + place
    aim = some + at + shift
    own = rank[first[some]]
    pos = np.searchsorted(key, own * (2 * n + 2) + np.clip(aim, 0, 2 * n))
    for cand in (pos, pos - 1):
        c = np.clip(cand, 0, n - 1)
        off = np.abs(place[c] - aim)
        better = (rank[c] == own) & (off <= DRIFT) & ((out[some] < 0) | (off < np.abs(out[some] - aim)))
        out[some[better]] = place[c[better]]
    return out


def dense(hit: np.ndarray, span: int, ratio: float) -> list[tuple[int, int]]:
    """Intervals of at least `span`, from hit to hit, in which at least `ratio` of all are hits: the longest, then those left and right of it."""
    out, todo = [], [(0, len(hit))]
    while todo:
        at, end = todo.pop()
        places = np.flatnonzero(hit[at:end])
        if len(places) < ratio * span or places[-1] - places[0] + 1 < span:
            continue
        # a tail reaches back to the first head whose total is no larger: totals before heads fall as a running minimum
        total = places * ratio - np.arange(len(places))  # misses so far, less what is allowed
        before = np.maximum.accumulate(total)
        pick = np.searchsorted(before, total + ratio - 1 - 1e-9, "left")
        size = np.where(pick < len(places), places - places[np.minimum(pick, len(places) - 1)] + 1, 0)
        best = int(size.argmax())
        if size[best] < span:
            continue
        x, y = at + int(places[pick[best]]), at + int(places[best])
        out.append((x, y))
        todo += [(at, x), (y + 1, end)]
    return out


def _stretches(hit: np.ndarray, span: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, whether it can hold a passage) of each run of hits without a gap above GAP."""
    places = np.flatnonzero(hit)
    if not len(places):
        return places, places, np.zeros(0, bool)
    cuts = np.flatnonzero(np.diff(places) > GAP + 1)
    first, last = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(places) - 1]])
    return places[first], places[last], (places[last] - places[first] + 1 >= span) & (last - first + 1 >= ratio * span)


def parted(place: np.ndarray, x: int, y: int) -> list[tuple[int, int]]:
    """The two parts of x..y on either side of its widest jump, by misses and change of diagonal; of equal ones, the middlemost."""
    own = x + np.flatnonzero(place[x : y + 1] >= 0)
    wide = np.diff(own) - 1 + np.abs(np.diff(place[own] - own))
    if not wide.any():
        return []
    best = np.flatnonzero(wide == wide.max())
    k = int(best[np.abs(own[best] - (x + y) / 2).argmin()])
    return [(x, int(own[k])), (int(own[k + 1]), y)]


def passages(a: Text, b: Text, similar: float) -> list[tuple[int, int, int, int, float]]:
    """Passages of b that repeat ones of a, by shingles: (b first, b last, a first, a last, similarity)."""
    n, span = len(b.sh), b.span
    if not len(a.sh) or n < span:
        return []
    ratio = 2 * similar / (1 + similar)
    # wherever they are in a: a passage has no fewer hits than this in some window
    value = a.order[0]
    hit = value[np.minimum(np.searchsorted(value, b.sh), len(value) - 1)] == b.sh
    total = np.concatenate([[0], np.cumsum(hit)])
    least = span - int((1 - ratio) * 2 * span)
    if (total[span:] - total[:-span]).max() < least:
        return []
    lo, hi, room = _stretches(hit, span, ratio)
    signature, c = b.nodes
    block = np.searchsorted(lo, c, "right") - 1
    some = np.flatnonzero(hit[c] & room[np.maximum(block, 0)])
    known, places = a.index
    lower, upper = (np.searchsorted(known, signature[some], side) for side in ("left", "right"))
    both = upper > lower
    seeds = zip(some[both].tolist(), lower[both].tolist(), upper[both].tolist())
    found: list[tuple[int, int, int, int, float]] = []
    done, tried = np.zeros(n, bool), set()
    for i, near, far in seeds:
        at = int(c[i])
        if done[at]:
            continue
        x0, x1 = int(lo[block[i]]), int(hi[block[i]])
        for m in places[near:far].tolist():
            # an alignment tolerates drift, so that near shifts of one stretch share it; it is searched once, for all seeds on it
            key = (x0, (at - m) // (DRIFT // 4))
            if key in tried:
                continue
            tried.add(key)
            place = aligned(a, b.sh[x0 : x1 + 1], x0, m - at)
            todo = [(int(f), int(g)) for f, g, wide in zip(*_stretches(place >= 0, span, ratio)) if wide]
            while todo:
                first, last = todo.pop()
                for x, y in dense(place[first : last + 1] >= 0, span, ratio):
                    x, y = first + x, first + y
                    if done[x0 + x : x0 + y + 1].all():
                        continue
                    p = place[x : y + 1]
                    p = p[p >= 0]
                    u, v = int(p.min()), int(p.max())
                    sa, sb = np.unique(a.sh[u : v + 1]), np.unique(b.sh[x0 + x : x0 + y + 1])
                    common = len(np.intersect1d(sa, sb, assume_unique=True))
                    jaccard = common / (len(sa) + len(sb) - common)
                    if jaccard >= similar and v - u + 1 >= span * similar:
                        found.append((x0 + x, x0 + y, u, v, jaccard))
                        done[x0 + x : x0 + y + 1] = True
                    else:
                        todo += parted(place, x, y)
            if done[at]:
                break
    return found


FOUND = "id long, start long, stop long, source long, source_start long, source_stop long, similarity double"


def _compare(span: int, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict = OrderedDict()  # sources met before: a passage of many documents has one source
        for batch in batches:
            rows = []
            for i, s, x, y in zip(*(batch.column(c) for c in ("id", "source", "x", "y"))):
                s, raw = s.as_py(), y.as_py()
                t = recent.pop((s, raw), None) or Text(raw, span)
                recent[s, raw] = t
                if len(recent) > 64:
                    recent.popitem(last=False)
                for p, q, u, v, j in passages(t, Text(x.as_py(), span), similar):
                    rows.append((i.as_py(), p, q + SHINGLE, s, u, v + SHINGLE, j))
            kinds = [pa.int64()] * 6 + [pa.float64()]
            names = ["id", "start", "stop", "source", "source_start", "source_stop", "similarity"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            buf, off = texts(b.column("text"))
            w = Words(buf, off, SPACE)
            h = w.hashes().astype(np.uint32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([h[i:j].tobytes() for i, j in zip(w.first[:-1], w.first[1:])], pa.binary())], ["id", "w"])


def _among(key: np.ndarray, row: np.ndarray, listed: pa.ListArray) -> np.ndarray:
    """Whether each key is in its row's list."""
    size = np.diff(listed.offsets.to_numpy())
    salt = lambda k, r: mix(k.view(np.uint64) + r.astype(np.uint64) * _FUNCTION[62])
    have = np.sort(salt(listed.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)))
    if not len(have):
        return np.zeros(len(key), bool)
    want = salt(key, row)
    return have[np.minimum(np.searchsorted(have, want), len(have) - 1)] == want


def _shared_windows(b: pa.RecordBatch, span: int):
    """(shingles, row of each, its first one, runs, for each band which runs have a key of their row's `keys`, windows of which that is true for all bands)."""
    raw = b.column("w").cast(pa.large_binary())
    off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    word = np.frombuffer(raw.buffers()[2], np.uint32)[off[0] // 4 : off[-1] // 4].astype(np.uint64)
    sh, starts = shingles(word, (off - off[0]) // 4, SHINGLE)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    runs = Runs(sh, row, span)
    listed = b.column("keys")
    own = [_among(k, r, listed) for k, r in zip(runs.key, runs.row)]
    every = runs.ok.copy()
    for band, chosen in enumerate(own):
        every &= runs.windows(band, chosen)
    return sh, row, starts, runs, own, every


def _covered(n: int, starts: np.ndarray, spans: pa.ListArray, span: int) -> np.ndarray:
    """Which places begin `span` shingles that all lie in one of their row's found passages."""
    edge = np.zeros(n + 1, np.int64)
    flat = spans.flatten()
    row = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
    x, y = (flat.field(c).to_numpy() for c in ("start", "stop"))
    first, last = starts[row] + x, starts[row] + y - SHINGLE - span + 2
    some = last > first
    np.add.at(edge, first[some], 1)
    np.add.at(edge, last[some], -1)
    return np.cumsum(edge[:-1]) > 0


def _open(span: int):
    """Of documents with the keys by which they were compared and their found passages: (key, id, exact). exact: the key is one of a
    window outside all found passages, and so are all others of that window; else: not both minima of its run lie in a found passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "w"):
                sh, row, starts, runs, own, every = _shared_windows(b, span)
                every &= ~_covered(len(sh), starts, b.column("spans"), span)[: runs.count]
                within = _covered(len(sh), starts, b.column("spans"), 1)
                ids = b.column("id").to_numpy()
                for band, chosen in enumerate(own):
                    first = runs.first[band]
                    open_at = np.logical_or.reduceat(every, first) if len(first) else chosen
                    for exact, some in ((True, chosen & open_at), (False, chosen & ~(within[runs.low[band]] & within[runs.high[band]]))):
                        yield pa.RecordBatch.from_arrays([pa.array(runs.key[band][some]), pa.array(ids[runs.row[band][some]]), pa.array(np.full(int(some.sum()), exact))], ["key", "id", "exact"])

    return run


def _whole_windows(span: int):
    """(hash of all shingles, id) of the windows that have all their keys in their document's list."""

    def parts(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for b in slices(batch, "w"):
                sh, row, _, _, _, every = _shared_windows(b, span)
                at = np.flatnonzero(every)
                total = np.concatenate([[U(0)], np.cumsum(mix(sh))])
                yield mix(total[at + span] - total[at]).view(np.int64), b.column("id").to_numpy()[row[at]]

    return lambda batches: _merged(parts(batches))


def _confirm(pairs: DataFrame, word: DataFrame, span: int, similar: float) -> DataFrame:
    """The passages of the pairs (id, source)."""
    # by source first: the comparison then runs where the ids are, and a source of many documents is no hot task
    both = pairs.select("id", "source").join(word.select(F.col("id").alias("source"), F.col("w").alias("y")), "source").join(word.withColumnRenamed("w", "x"), "id")
    return store(both.select("id", "source", "x", "y").transform(in_arrow, _compare(span, similar), FOUND).distinct(), "passages")


def repeated_passages(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """(key, start, stop, source, source_start, source_stop, similarity): words start..stop of a document repeat words of `source`, a smaller id."""
    spark = df.sparkSession
    ship(spark)
    span = max(1, least - SHINGLE + 1)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    shared = _stars(rows.transform(in_arrow, _signatures(span), KEYS), "signatures")
    pairs = store(shared.where("id <> source").select("id", "source").distinct(), "passage-pairs")
    ids = store(shared.select("id").distinct(), "passage-ids")
    word = store(only(rows, ids).transform(in_arrow, _words, "id long, w binary"), "passage-words")
    found = _confirm(pairs, word, span, similar)
    # what is still open: windows that share all their keys but lie in no passage, and keys of which no minimum does
    spans = found.groupBy("id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    # a document that is the smallest of a key has no smaller one with the same window
    listed = shared.where("id <> source").groupBy("id").agg(F.collect_set("key").alias("keys")).join(spans, "id", "left")
    listed = listed.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:long,stop:long>>)")))
    left = store(word.join(listed, "id").transform(in_arrow, _open(span), "key long, id long, exact boolean").distinct(), "open-keys")
    # a star with the smallest id of those that are still open
    again = _stars(left.where("not exact").select("key", "id", F.lit(None).cast("long").alias("source"), F.lit(False).alias("local")), "open-stars")
    # and one with the smallest id of those that have the very same window
    exact = shared.join(left.where("exact").select("key").distinct(), "key", "left_semi").groupBy("id").agg(F.collect_set("key").alias("keys"))
    same = _stars(word.join(exact, "id").transform(in_arrow, _whole_windows(span), KEYS), "same-windows")
    more = again.unionByName(same).where("id <> source").select("id", "source").distinct().join(pairs, ["id", "source"], "left_anti")
    more = store(more, "open-pairs")
    if not more.isEmpty():
        found = found.unionByName(_confirm(more, word, span, similar))
    discard(shared, pairs, ids, left, again, same, more, word)
    # equal passages all have the smallest id that holds them, so one row says as much as one for each smaller id
    equal = found.where("similarity = 1").groupBy("id", "start", "stop").agg(F.min(F.struct("source", "source_start", "source_stop")).alias("s"))
    found = found.where("similarity < 1").unionByName(equal.select("id", "start", "stop", "s.*", F.lit(1.0).alias("similarity")))
    return found.withColumnRenamed("id", key)


def remove_passages(df: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with the repeated passages cut out of the documents of larger id; documents of which no word is left go."""
    ship(df.sparkSession)
    cols = df.columns
    spans = store(found.groupBy(F.col(key).alias("\x01id")).agg(F.collect_set(F.struct("start", "stop")).alias("\x01spans")), "spans")
    # texts without a passage stay where they are; passages go only from the larger id to a smaller one, so that each is kept somewhere
    touched, clean = split(df, key, spans.select("\x01id"))
    both = touched.join(spans, F.col(key) == F.col("\x01id")).drop("\x01id")
    at = cols.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, keep = [], []
            for t, spans in zip(b.column(text).to_pylist(), b.column("\x01spans").to_pylist()):
                t = cut(t or "", [(s["start"], s["stop"]) for s in spans])
                out.append(t)
                keep.append(bool(t.strip()))
            arrays = [b.column(c) for c in cols]
            arrays[at] = pa.array(out, b.schema.field(text).type)
            yield pa.RecordBatch.from_arrays(arrays, cols).filter(pa.array(keep, pa.bool_()))

    return clean.select(*cols).unionByName(both.transform(in_arrow, run, df.schema))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (word numbers)."""
    raw = text.encode()
    w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), SPACE)
    out, at = [], 0
    for a, z in sorted(spans):
        if a >= len(w.start) or z <= a:
            continue
        x, y = int(w.start[a]), int(w.end[min(z, len(w.end)) - 1])
        if y <= at:
            continue
        out.append(raw[at : max(x, at)])
        at = y
    return b"".join([*out, raw[at:]]).decode()


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
