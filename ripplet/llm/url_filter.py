"""URL filters: a bit-parallel wildcard automaton (multiword Shift-And) over canonical URLs.

A rule is a glob over the canonical form `.host 0xFF path`: host lower-cased, a dot before it and the byte 0xFF, which no
UTF-8 text holds, between host and path. `*` stands for any bytes, `?` for one. All rules are packed, longest first, into
64-bit words: one bit a state, one mask a byte value, so that a step over one byte of a URL advances every rule at once
(`state = ((state << 1 | start) & mask[byte]) | (state & loop[byte])`). URLs of a batch are stepped together, longest
first, so that the active set shrinks. Cost: URL bytes x words; memory: rows of a batch x words.

Nulls, URLs without "://" and empty ones have empty host and path, fit no rule and get the default verdict; repeated rows
are judged each for itself; an empty table gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.llm.cluster import in_arrow, ship

U = np.uint64
SPLIT = 0xFF


@dataclass(frozen=True)
class Rule:
    """`pattern`: `host/path` (that host and its subdomains, paths that start so; either part may hold `*` and `?`)."""

    verdict: str
    pattern: str

    def tokens(self) -> list[int | str]:
        """The canonical glob: byte values, "*" (any bytes) and "?" (any byte but the boundary)."""
        host, slash, path = self.pattern.partition("/")
        out: list[int | str] = ["*", ord(".")]
        for part, end in ((host.lower(), SPLIT), (slash + path, "*")):
            for ch in part:
                out += [ch] if ch in "*?" else list(ch.encode())
            out.append(end)
        return out


class Automaton:
    """Rules packed into Shift-And masks, in order of priority: longer patterns first, of equal ones the earlier."""

    def __init__(self, rules: list[Rule]):
        self.rules = sorted(rules, key=lambda r: -len(r.pattern))
        states: list[tuple[int | str, bool]] = []  # what a state takes to be entered; whether it then stays
        self.first, self.last = [], []
        for r in self.rules:
            tokens, own, loop = r.tokens(), [], False
            for t in tokens:
                if t == "*":
                    if own:
                        own[-1] = (own[-1][0], True)
                    else:
                        loop = True
                else:
                    own.append((t, False))
            self.first.append((len(states), loop))
            states += own
            self.last.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros(self.words, np.uint64)
        self.begin = np.zeros(self.words, np.uint64)  # states that a rule may enter at the first byte
        self.again = np.zeros(self.words, np.uint64)  # and at any byte: rules that begin with "*"
        self.head = np.zeros(self.words, np.uint64)  # first states take nothing from the state before them
        for i, (t, loop) in enumerate(states):
            w, b = i // 64, U(1) << U(i % 64)
            if t == "?":
                self.step[:SPLIT, w] |= b
            else:
                self.step[t, w] |= b
            if loop:
                self.stay[w] |= b
        for i, loop in self.first:
            w, b = i // 64, U(1) << U(i % 64)
            self.head[w] |= b
            self.begin[w] |= b
            if loop:
                self.again[w] |= b
        self.accept = np.zeros(self.words, np.uint64)
        for i in self.last:
            self.accept[i // 64] |= U(1) << U(i % 64)
        self.rule_of = {i: k for k, i in enumerate(self.last)}

    def match(self, urls: list[bytes]) -> np.ndarray:
        """The index in self.rules of the best rule that accepts each canonical URL; -1 if none does."""
        out = np.full(len(urls), -1, np.int64)
        if not self.rules or not urls:
            return out
        length = np.array([len(u) for u in urls])
        order = np.argsort(-length, kind="stable")
        data = np.frombuffer(b"".join(urls), np.uint8)
        start = np.concatenate([[0], np.cumsum(length)])[:-1][order]
        length = length[order]
        state = np.zeros((len(urls), self.words), np.uint64)
        final = np.zeros_like(state)
        active = len(urls)
        # "*" that stays may not leave the host: a loop state never survives the boundary byte, unless it is in the path
        host_stay = self._host_loops()
        for at in range(int(length[0])):
            while active and length[active - 1] <= at:
                active -= 1
                final[active] = state[active]
            c = data[start[:active] + at]
            s = state[:active]
            carry = s >> U(63)
            shifted = s << U(1)
            shifted[:, 1:] |= carry[:, :-1]
            shifted &= ~self.head
            shifted |= self.begin if at == 0 else self.again
            keep = s & self.stay
            keep[c == SPLIT] &= ~host_stay
            state[:active] = (shifted & self.step[c]) | keep
        final[:active] = state[:active]
        hit = final & self.accept
        some = np.flatnonzero(hit.any(axis=1))
        word = (hit[some] != 0).argmax(axis=1)
        value = hit[some, word]
        low = value & (~value + U(1))
        bit = np.log2(low.astype(np.float64)).astype(np.int64)
        out[order[some]] = [self.rule_of[int(i)] for i in word * 64 + bit]
        return out

    def _host_loops(self) -> np.ndarray:
        mask, at = np.zeros(self.words, np.uint64), 0
        for r in self.rules:
            split = False
            for t in r.tokens():
                if t == "*":
                    continue
                if not split and t != SPLIT:
                    mask[at // 64] |= U(1) << U(at % 64)
                split |= t == SPLIT
                at += 1
        return mask & self.stay


URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = {i: i + 32 for i in range(65, 91)}


def host_path(url: str | None) -> tuple[str, str]:
    m = URL.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


SCHEMA = "host string, path string, rule string, verdict string"


def judge_urls(df: DataFrame, key: str, url: str, rules: list[Rule], default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) of each row: the rule is the longest that fits, null if none does."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(rules)
        names = [r.pattern for r in auto.rules] + [None]
        verdicts = [r.verdict for r in auto.rules] + [default]
        for b in batches:
            parts = [host_path(u) for u in b.column("url").to_pylist()]
            best = auto.match([b"." + h.encode() + bytes([SPLIT]) + p.encode() for h, p in parts])
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([names[k] for k in best], pa.string()), pa.array([verdicts[k] for k in best], pa.string())],
                [key, "host", "path", "rule", "verdict"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(url).alias("url")).transform(in_arrow, run, f"`{key}` {kind}, {SCHEMA}")


RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", RULES)


_FITS = "((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
ORACLE = """
with u as (
  select page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') as raw, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages
), h as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from u),
r as (select *, case {cases} end as rule from h)
select page_id, host, path, rule, case {verdicts} else 'allow' end as verdict from r
""".format(
    cases=" ".join(f"when {_FITS.format(h=r.pattern.partition('/')[0], p='/' + r.pattern.partition('/')[2])} then '{r.pattern}'" for r in sorted(RULES, key=lambda r: -len(r.pattern))),
    verdicts=" ".join(f"when rule = '{r.pattern}' then '{r.verdict}'" for r in RULES),
)
