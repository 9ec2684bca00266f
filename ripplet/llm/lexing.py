"""Words and shingles of a batch of texts as numpy arrays over their UTF-8 bytes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(lower: bool = True) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(20240229))
    t = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
    if lower:
        t[65:91] = t[97:123]
    return t


BYTE_HASH = _table()

#: Bytes that end a word: ASCII white space; or all ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x41:0x5B] = NOT_WORD[0x61:0x7B] = NOT_WORD[0x80:] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Bytes whose hashes are summed at once: what is kept by a worker between batches are two tables of so many powers.
PIECE = 1 << 17


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least `n` of each. Tables beyond PIECE are not kept."""
    size = max(PIECE, n)
    if size in _powers:
        return _powers[size]
    out = []
    for m in (_MULTIPLIER, _INVERSE):
        a = np.full(size, m, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    if size == PIECE:
        _powers[size] = tuple(out)
    return tuple(out)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of text (a longer text makes a part of its own), so memory is bounded."""
    if not batch.num_rows:
        return
    _, off = texts(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """The words of a batch. start, end: byte positions; doc: row of each word; first: its first word of each row, plus the end."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, separators: np.ndarray):
        self.buf, self.off = buf, off
        n, rows = len(buf), len(off) - 1
        sep = separators[buf]
        inside = ~sep
        head = inside.copy()
        head[1:] &= sep[:-1]
        tail = inside.copy()
        tail[:-1] &= sep[1:]
        # rows follow each other without a byte between them
        cuts = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
        head[cuts] = inside[cuts]
        tail[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(head)
        self.end = np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word with A-Z lower-cased: a mixed polynomial over random byte values modulo 2**64."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            base = int(self.start[at])
            stop = max(at + 1, int(np.searchsorted(self.end, base + PIECE - 1, "right")))  # whole words; a longer one has a piece of its own
            x, y = self.start[at:stop] - base, self.end[at:stop] - base
            n = int(y[-1])
            power, inverse = powers(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_HASH[self.buf[base : base + n]] * power[:n], out=total[1:])
            out[at:stop] = mix((total[y] - total[x]) * inverse[x] + (y - x).astype(np.uint64))
            at = stop
        return out


_FACTORS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)


def shingles(word: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, starts): the n-word shingles of each row in order, row r's at starts[r]:starts[r + 1].

    A row of fewer words, but not none, has one shingle of all its words.
    """
    count = np.diff(first)
    per = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(per)])
    total = int(starts[-1])
    out = np.zeros(total, np.uint64)
    if not total:
        return out, starts
    at = np.arange(total) - np.repeat(starts[:-1], per) + np.repeat(first[:-1], per)
    full = np.repeat(count >= n, per)
    if full.all():
        for j in range(n):
            out += word[at + j] * _FACTORS[j]
    else:
        size = np.minimum(np.repeat(count, per), n)
        for j in range(n):
            has = size > j
            out[has] += word[at[has] + j] * _FACTORS[j]
        out[~full] += size[~full].astype(np.uint64) * U(0xD6E8FEB86659FD93)
    return mix(out), starts
