"""MinHash near-dedup with odd sketches.

1. Each text becomes the set of its distinct 5-word shingles (64-bit hashes), of which come a set hash, BANDS x ROWS
   MinHash samples and an odd sketch: SKETCH_BITS parity bits, one flipped for each (sample, value).
2. Rows of equal sets form a class; its smallest id stands for it. Exact copies so cost one grouped minimum, not pairs.
3. Representatives that share a band meet in its bucket. Every member is first compared with the bucket's smallest id,
   a star and never all pairs; the XOR population count of two sketches estimates their similarity and drops the
   pairs that are far below the threshold; full sets confirm the rest.
4. Buckets whose members lie in one component after that are done. The others are cut into blocks of about BLOCK members; each
   pair of blocks is a unit of work that compares sizes, sketches and known distances from the bucket's smallest id of its
   members in different components, by arrays, and gives the pairs that may be linked, to be confirmed in the same way.
   A bucket of documents that only share a template costs array operations, not rows, as its sketches tell them apart.

With 25 bands of 5 rows a pair at 0.85 shares no band with a chance of 4e-7, and its sketches differ in more than
most_apart(percent) bits with one of about 1e-7. Links are confirmed on the full sets of 64-bit shingle hashes, without any cap.

Defined cases: null or empty text, or text without words: an empty set, no links, its own component. A text of one to
four words: one shingle. Null id: the row links with nothing, its component is null and it is kept. Rows that repeat an
id are one vertex. An empty table gives an empty table. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.llm.cluster import components, discard, in_arrow, only, ship, store
from ripplet.llm.lexing import SPACE, U, Words, mix, shingles, slices, texts

BANDS, ROWS, SKETCH_BITS, BLOCK = 25, 5, 1024, 1024


def most_apart(percent: int) -> int:
    """Bits in which the sketches of two sets of that similarity differ with a chance of hardly more than 1e-7: 5.3 deviations above the mean."""
    j, k = percent / 100, BANDS * ROWS
    mean = SKETCH_BITS / 2 * (1 - math.exp(-4 * k * (1 - j) / SKETCH_BITS))
    slope = 2 * math.exp(-4 * k * (1 - j) / SKETCH_BITS)  # bits a sample that differs
    return math.ceil(mean + 5.3 * math.sqrt(slope**2 * k * j * (1 - j) + mean * (1 - slope / 2)))


MOST_APART = most_apart(85)

_rng = np.random.Generator(np.random.PCG64(4711))
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)[:, None]
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * U(2) + U(1)
_SAMPLE = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    buf, off = texts(column)
    w = Words(buf, off, SPACE)
    sh, at = shingles(w.hashes(), w.first)
    return [np.unique(sh[a:b]) for a, b in zip(at[:-1], at[1:])]


def samples(s: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that isn't empty."""
    h = (s >> U(32)).astype(np.uint32)
    out = None
    for k in range(0, len(h), 2048):
        m = (h[None, k : k + 2048] * _A + _B).min(axis=1)
        out = m if out is None else np.minimum(out, m)
    return out


def sketches(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bands, odd sketches) of rows of samples."""
    bands = mix((m.reshape(len(m), BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=2) + np.arange(BANDS, dtype=np.uint64))
    bit = mix(m.astype(np.uint64) + _SAMPLE) % U(SKETCH_BITS)
    odd = np.zeros((len(m), SKETCH_BITS), np.uint8)
    np.bitwise_xor.at(odd, (np.arange(len(m))[:, None], bit.astype(np.int64)), 1)
    return bands, np.packbits(odd, axis=1).view(np.int64)


SIGNED = "id long, n_shingles long, set_hash binary, bands array<long>, sketch array<long>"


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        for b in slices(batch, "text"):
            own = sets(b.column("text"))
            some = [i for i, s in enumerate(own) if len(s)]
            bands: list = [None] * len(own)
            sketch: list = [None] * len(own)
            if some:
                x, y = sketches(np.stack([samples(own[i]) for i in some]))
                for i, p, q in zip(some, x.view(np.int64).tolist(), y.tolist()):
                    bands[i], sketch[i] = p, q
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"),
                    pa.array([len(s) for s in own], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in own], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketch, pa.list_(pa.int64())),
                ],
                ["id", "n_shingles", "set_hash", "bands", "sketch"],
            )


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.tobytes() for s in sets(b.column("text"))], pa.binary())], ["id", "sh"])


def apart(a: str, b: str):
    """Bits in which two sketches differ."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))


def compare(pairs: DataFrame, rows: DataFrame, repeated: bool = True) -> DataFrame:
    """(a, b, common, total) of the pairs (a, b): the sizes of the intersection and of the union of their full sets. repeated: whether rows may repeat an id."""
    ids = store(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "candidates")
    some = only(rows, ids)
    if repeated:  # else texts needn't be shuffled to meet their like
        some = some.dropDuplicates(["id", "text"])
    full = store(some.transform(in_arrow, _shingle_rows, "id long, sh binary"), "full-sets")
    both = pairs.select("a", "b").join(full.withColumnRenamed("id", "b").withColumnRenamed("sh", "y"), "b").join(full.withColumnRenamed("id", "a").withColumnRenamed("sh", "x"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            common, total = [], []
            for x, y in zip(b.column("x"), b.column("y")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(p, q)
                common.append(int((p[np.minimum(at, len(p) - 1)] == q).sum()))
                total.append(len(p) + len(q) - common[-1])
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "common", "total"])

    out = store(both.select("a", "b", "x", "y").transform(in_arrow, run, "a long, b long, common long, total long"), "compared")
    discard(full, ids)
    return out


def _unit(rows: list[tuple], i: int, j: int, percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (larger id, smaller id) of two blocks of a bucket that may be linked."""
    mine, ident, c, n = (np.array([r[k] for r in rows], np.int64) for k in range(4))
    d = np.array([np.nan if r[4] is None else r[4] for r in rows])
    sketch = np.array([r[5] for r in rows], np.int64).view(np.uint64)
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    bits = np.zeros((len(left), len(right)), np.uint16)
    for k in range(SKETCH_BITS // 64):
        bits += np.bitwise_count(sketch[left, k][:, None] ^ sketch[right, k][None])
    a, b = np.nonzero((bits <= most) & (c[left][:, None] != c[right][None]))
    a, b = left[a], right[b]
    keep = percent * np.maximum(n[a], n[b]) <= 100 * np.minimum(n[a], n[b])
    # Jaccard distance is a metric: two sets are at least as far apart as their distances from a third differ
    keep &= ~(np.abs(d[a] - d[b]) > 1 - percent / 100 + 1e-9)
    if i == j:
        keep &= a < b
    a, b = ident[a[keep]], ident[b[keep]]
    return np.maximum(a, b), np.minimum(a, b)


def crossed(members: DataFrame, percent: int) -> DataFrame:
    """(a, b), distinct: pairs of members(key, id, c, n, d, sketch) of a key, in different components c, that may be linked by their sizes, distances d and sketches."""
    most = most_apart(percent)
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = (
        members.join(sizes, "key")
        .withColumn("mine", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "c", "n", "d", "sketch")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch:
            a, b = _unit(held, at[1], at[2], percent, most)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for key, i, j, *rest in zip(*(x.to_pylist() for x in batch.columns)):
                if (key, i, j) != at:
                    if len(held) > 1:
                        yield done()
                    at, held = (key, i, j), []
                held.append(rest)
        if len(held) > 1:
            yield done()

    return placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").transform(in_arrow, run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    docs = rows.where("id is not null")
    signed = store(rows.transform(in_arrow, sign, SIGNED), "signed")
    some = signed.where("set_hash is not null and id is not null")
    classes = store(some.groupBy("set_hash").agg(F.min("id").alias("rep")), "classes")
    # rows of a representative's id that have another set stay in: an id is one vertex
    reps = signed.join(classes.select(F.col("set_hash").alias("h"), "rep"), (F.col("id") == F.col("rep")) & (F.col("set_hash") == F.col("h")), "left_semi").dropDuplicates(["id", "set_hash"])
    reps = store(reps.select("id", F.col("n_shingles").alias("n"), "bands", "sketch"), "representatives")
    sketch = reps.select("id", "n", "sketch")
    buckets = reps.select(F.explode("bands").alias("key"), "id").distinct()
    stars = buckets.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("most")).where("b < most").drop("most")
    members = store(buckets.join(stars, "key"), "buckets")  # of shared buckets alone
    linked_size = f"{percent} * greatest(n, m) <= 100 * least(n, m)"
    other = sketch.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("t"))

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and sketches let them be linked."""
        with_a = pairs.join(sketch.withColumnRenamed("id", "a"), "a").withColumnRenamed("sketch", "s")
        return with_a.join(other, "b").where(linked_size).where(apart("s", "t") <= most_apart(percent)).select("a", "b").distinct()

    pairs = store(alike(members.where("id > b").select(F.col("id").alias("a"), "b").distinct()), "pairs")
    # classes join ids with several sets, or the same set under several ids, to their representative
    same = some.join(classes, "set_hash").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    linked = f"100 * common >= {percent} * total"
    repeated = not signed.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()
    first = compare(pairs, docs, repeated)
    comp = components(first.where(linked))
    # buckets that still hold more than one component
    placed = members.join(comp, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    # each member's distance from its bucket's smallest id, as far as it is known
    known = first.groupBy(F.col("a").alias("id"), "b").agg(F.min(1 - F.col("common") / F.col("total")).alias("d"))
    open_rows = store(placed.join(mixed, "key", "left_semi").join(known, ["id", "b"], "left").withColumn("d", F.when(F.col("id") == F.col("b"), 0.0).otherwise(F.col("d"))), "open")
    more = first.where(linked).select("a", "b")
    if not open_rows.isEmpty():
        inside = open_rows.join(sketch, "id").select("key", "id", "c", "n", "d", "sketch")
        cross = store(crossed(inside, percent).join(pairs, ["a", "b"], "left_anti"), "cross-pairs")
        if not cross.isEmpty():
            more = more.unionByName(compare(cross, docs, repeated).where(linked).select("a", "b"))
    final = components(more.unionByName(same))
    out = signed.select("id", "n_shingles").join(final, "id", "left")
    out = out.select(F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    discard(members, open_rows, pairs, comp, reps)
    return out.withColumn("kept", F.col("component_id").isNull() | (F.col(key) == F.col("component_id")))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), d as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) end) as s from w
), c as (select s, min(doc_id) as rep from (select doc_id, list_sort(s) as s from d where len(s) > 0) group by s),
u as (select rep, len(s) as n, unnest(s) as x from c),
i as (select a.rep as a, b.rep as b, a.n + b.n - count(*) as un, count(*) as common from u a join u b on a.x = b.x and a.rep < b.rep group by a.rep, b.rep, a.n, b.n),
l as (select a, b from i where 100 * common >= 85 * un
  union all select d.doc_id, c.rep from d join c on list_sort(d.s) = c.s where d.doc_id <> c.rep),
e as (select a, b from l union select b, a from l),
r(id, k) as (select doc_id, doc_id from d union select e.b, r.k from r join e on e.a = r.id),
m as (select id, min(k) as component_id from r group by id)
select d.doc_id, len(d.s) as n_shingles, m.component_id, d.doc_id = m.component_id as kept from d join m on m.id = d.doc_id
"""
