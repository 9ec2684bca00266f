"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Identical vectors form one class, of which one row stands for all; every class enters each table under its signature of
`bits` signs. A bucket is cut into blocks of about BLOCK rows, and each pair of blocks is one unit of work: the cosines of
all its pairs. What is shuffled to the tables are vectors rounded to 16 bits a component, with a bound of the error: a pair
whose cosine is nearer to the threshold than that bound is judged by the exact cosine of both whole vectors, in double
precision, that are fetched for it. A pair counts in the first table where its signatures agree, so that no
pair is ever counted twice; a unit returns, a row, the number of its links, a spanning forest of its
links for the components, and the pairs that are too near to tell.

`tables` is chosen so that a pair at the threshold is missed with a chance of at most MISS; `bits` grows with the
logarithm of the number of rows, so that buckets of unlike vectors keep their size (both: see `plan`).

Defined cases: null or empty vectors, null or non-finite components, all zeros: no links, a component of their own. A
null id: no component, kept. Vectors of different lengths never link. Rows that repeat an id are one vertex, each row with its own links. An empty table gives
an empty table. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.llm.cluster import BROADCAST_IDS, components, discard, in_arrow, ship, store

BLOCK, MISS, BUCKET = 2048, 1e-4, 1024


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for so many rows."""
    bits = min(48, max(6, math.ceil(math.log2(max(rows, 1) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


def planes(table: int, bits: int, dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([815, table, dim])).standard_normal((dim, bits))


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of equal length from a binary column of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Positions in (a, b) of the edges of a spanning forest over n vertices."""
    parent, keep = list(range(n)), []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            parent[y] = x
            keep.append(i)
    return keep


def link(df: DataFrame, key: str, vector: str, threshold: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept) of each row."""
    spark = df.sparkSession
    ship(spark)
    v = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), F.when(F.coalesce(good, F.lit(False)), v).alias("v")).withColumn("class", F.when(F.col("v").isNotNull(), F.sha1(F.to_json(F.struct("v")))))
    rows = store(rows.select("id", "class", "v"), "vectors")
    sized = rows.where("class is not null").groupBy("class").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("v").alias("v"))
    classes = store(sized, "classes")
    total = classes.count()
    bits, tables = plan(total, threshold)
    kind = np.int16 if bits < 16 else np.int32 if bits < 32 else np.int64
    width = np.dtype(kind).itemsize

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.asarray(pa.compute.list_value_length(b.column("v")))
            for dim in np.unique(lengths):
                part = b.filter(pa.array(lengths == dim))
                x = np.asarray(part.column("v").flatten(), np.float64).reshape(-1, dim)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                # signatures, one column a table: the sign bits
                sig = np.stack([((x @ planes(t, bits, dim)) > 0) @ (np.int64(1) << np.arange(bits)) for t in range(tables)], axis=1)
                scale = np.abs(x).max(axis=1) / 32767
                short = np.rint(x / scale[:, None]).astype(np.int16)
                raw = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    # vectors of other lengths get other buckets
                    [part.column("class"), part.column("n"), part.column("least"), raw(x), raw(short), pa.array(scale), raw(sig.astype(kind)), pa.FixedSizeListArray.from_arrays(pa.array((sig * 4096 + dim % 4096).ravel(), pa.int64()), tables).cast(pa.list_(pa.int64()))],
                    ["class", "n", "least", "v", "short", "scale", "packed", "sig"],
                )

    signed = store(classes.transform(in_arrow, sign, "class string, n long, least long, v binary, short binary, scale double, packed binary, sig array<long>").withColumn("cid", F.xxhash64("class")), "signed")
    entries = signed.select(F.posexplode("sig").alias("t", "s"), "cid", "n", "least")
    sizes = entries.groupBy("t", "s").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    sizes = store(sizes, "bucket-sizes")
    # some rows / BUCKET for each table: as long as they are few, entries needn't be shuffled to meet them
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes
    placed = (
        signed.select(F.posexplode("sig").alias("t", "s"), "cid", "n", "least", "short", "scale", "packed")
        .join(sizes, ["t", "s"])
        .withColumn("mine", F.pmod(F.xxhash64("cid", "t"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("t", "s", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cid", "n", "least", "short", "scale", F.substring("packed", F.lit(1), F.col("t") * width).alias("before"))
    )

    def unit(rows: list[tuple], t: int, i: int, j: int):
        """Links of one unit: per row the links found, and a forest of edges."""
        mine = np.array([r[0] for r in rows])
        cid = np.array([r[1] for r in rows], np.int64)
        n = np.array([r[2] for r in rows], np.int64)
        x = np.frombuffer(b"".join(r[4] for r in rows), np.int16).reshape(len(rows), -1).astype(np.float64)
        scale = np.array([r[5] for r in rows])
        x *= scale[:, None]
        before = np.frombuffer(b"".join(r[6] for r in rows), kind).reshape(len(rows), t)
        left = np.flatnonzero(mine == i)
        right = np.flatnonzero(mine == j)
        if not len(left) or not len(right):
            return
        # rounding moves a unit vector by at most half a step a component
        off = scale * (math.sqrt(x.shape[1]) / 2)
        cosine = x[left] @ x[right].T
        bound = off[left][:, None] + off[right][None] + off[left][:, None] * off[right][None] + 1e-9
        a, b = np.nonzero(cosine >= threshold - bound)
        sure = cosine[a, b] >= threshold + bound[a, b]
        del cosine, bound
        a, b = left[a], right[b]
        keep = np.ones(len(a), bool) if i != j else a < b
        for k in range(0, len(a) if t else 0, 50_000):
            keep[k : k + 50_000] &= (before[a[k : k + 50_000]] != before[b[k : k + 50_000]]).all(axis=1)
        a, b, sure = a[keep], b[keep], sure[keep]
        near, edge = {}, {}
        for y, z in zip(a[~sure].tolist(), b[~sure].tolist()):
            near.setdefault(y, []).append(int(cid[z]))
        a, b = a[sure], b[sure]
        links = np.bincount(a, n[b], len(rows)) + np.bincount(b, n[a], len(rows))
        for k in forest(a, b, len(rows)):
            edge.setdefault(int(a[k]), []).append(rows[int(b[k])][3])
        for r in np.flatnonzero((links > 0) | np.isin(np.arange(len(rows)), list(near))):
            yield int(cid[r]), int(links[r]), rows[r][3], edge.get(int(r), []), near.get(int(r), [])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.list_(pa.int64())), ("near", pa.list_(pa.int64()))])
        at, held, out = None, [], []
        for b in batches:
            for t, s, i, j, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if (t, s, i, j) != at:
                    if len(held) > 1:
                        out += unit(held, at[0], at[2], at[3])
                    at, held = (t, s, i, j), []
                    if len(out) > 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)], schema=schema)
                        out = []
                held.append(rest)
        if len(held) > 1:
            out += unit(held, at[0], at[2], at[3])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)], schema=schema)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cosine = [float(np.frombuffer(x.as_buffer(), np.float64) @ np.frombuffer(y.as_buffer(), np.float64)) for x, y in zip(b.column("vcid"), b.column("vother"))]
            yield b.select([c for c in b.schema.names if c[0] != "v"]).filter(pa.array(np.array(cosine) >= threshold, pa.bool_()))

    found = store(
        placed.repartition("t", "s", "i", "j").sortWithinPartitions("t", "s", "i", "j").transform(in_arrow, compare, "cid long, links long, a long, b array<long>, near array<long>"), "links"
    )
    close = found.select("cid", F.explode("near").alias("other"))
    told = found.select("cid", "links")
    edges = found.select("a", F.explode("b").alias("b"))
    if not close.isEmpty():
        one, two = (signed.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("least").alias(f"l{c}"), F.col("v").alias(f"v{c}")) for c in ("cid", "other"))
        pairs = close.join(one, "cid").join(two, "other").select("cid", "other", "ncid", "nother", "lcid", "lother", "vcid", "vother").transform(in_arrow, exact, "cid long, other long, ncid long, nother long, lcid long, lother long")
        pairs = store(pairs, "exact-pairs")
        told = told.unionByName(pairs.select("cid", F.col("nother").alias("links"))).unionByName(pairs.select(F.col("other").alias("cid"), F.col("ncid").alias("links")))
        edges = edges.unionByName(pairs.select(F.col("lcid").alias("a"), F.col("lother").alias("b")))
    links = told.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = components(edges)
    per_class = (
        signed.select("class", "cid", "n", "least")
        .join(links, "cid", "left")
        .join(comp.withColumnRenamed("id", "least"), "least", "left")
        .select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component"))
    )
    per_class = store(per_class, "per-class")
    out = rows.select("id", "class").join(per_class, "class", "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    discard(signed, classes, found, comp)
    return out.withColumn("kept", F.col("component_id").isNull() | (F.col(key) == F.col("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


ORACLE = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
g as (select vec_id, e from v where e is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
r(id, c) as (select vec_id, vec_id from v union select l.b, r.c from r join l on l.a = r.id),
k as (select id, min(c) as component_id from r group by id),
n as (select a, count(*) as n from l group by a)
select v.vec_id, coalesce(n.n, 0) as n_links, k.component_id, v.vec_id = k.component_id as kept
from v join k on k.id = v.vec_id left join n on n.a = v.vec_id
"""
