"""Byte-level BPE encoding and decoding of whole texts, by a vocabulary file of ranks.

Texts of up to CHUNK characters are encoded where they are. Longer ones are cut into overlapping chunks, spread over the
cluster and pre-tokenised in parallel; the pre-token boundaries of a chunk and of the next in their overlap are
compared, and the two streams are stitched at the first boundary that both have: the pre-tokeniser looks only ahead, so
from a common boundary on they agree for good. Then the pieces between stitches are encoded in parallel and their ids
put together in order. Where an overlap holds no common boundary (such as 2,000 letters without a break) the text is
encoded whole by one task. Boundaries within reach of a chunk's end count as unknown.

Defined cases: null and empty texts have no tokens; repeated rows are each returned; texts are never cut short; an empty
table gives an empty table. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ripplet.llm.cluster import in_arrow, ship, store

CHUNK, OVERLAP = 40_000, 2_000
#: Characters that the pre-tokeniser may look ahead of a boundary (a contraction has three).
LOOK = 3
_coders: dict = {}

# \s of the pattern as tiktoken's engine has it (Unicode White_Space)
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def coder(path: str, pattern: str):
    """The tiktoken coder of a vocabulary file, made once a worker."""
    if (path, pattern) not in _coders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _coders[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _coders[path, pattern]


def splitter(pattern: str):
    """The pre-tokeniser as a compiled expression with the same white space as tiktoken's."""
    if pattern not in _coders:
        import regex

        own = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        _coders[pattern] = regex.compile(own)
    return _coders[pattern]


def boundaries(text: str, pattern: str) -> list[int]:
    """Positions where pre-tokens end, but for those too near the end of the text, as what follows might change them,
    and those after white space: a piece that ended there would lose what its last pre-token has to look at."""
    return [e for m in splitter(pattern).finditer(text) if (e := m.end()) <= len(text) - LOOK and not text[e - 1].isspace()]


def encode_texts(df: DataFrame, key: str, text: str, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids) of each row: the ids as little-endian unsigned 32-bit integers."""
    spark = df.sparkSession
    ship(spark)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            ids = pa.array((c.encode_to_numpy(t.as_py(), disallowed_special=()).astype("<u4").tobytes() for t in b.column("text")), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("key"), ids], ["key", "ids"])

    short = rows.where(F.length("text") <= chunk).transform(in_arrow, whole, f"key {kind}, ids binary")

    # a long text, once for all rows that repeat it: spread by its hash, cut into overlapping chunks
    long = rows.where(F.length("text") > chunk).withColumn("sha", F.sha1("text"))
    keys = long.select("key", "sha")
    texts = long.select("sha", "text").groupBy("sha").agg(F.min("text").alias("text"))
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk))
    chunks = texts.select("sha", F.length("text").alias("size"), "text", F.explode(starts).alias("start")).select("sha", "size", "start", F.substring("text", F.col("start") + 1, F.lit(chunk + overlap)).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails = [], []
            for start, size, t in zip(b.column("start").to_pylist(), b.column("size").to_pylist(), b.column("text").to_pylist()):
                ends = [0, *boundaries(t, pattern)]
                heads.append([start + e for e in ends if e < overlap])
                tails.append([start + e for e in ends if e >= chunk])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, kind), pa.array(tails, kind)], [*b.schema.names, "head", "tail"])

    cut = chunks.repartition("sha", "start").transform(in_arrow, split, "sha string, size int, start int, text string, head array<int>, tail array<int>")
    w, every = Window.partitionBy("sha").orderBy("start"), Window.partitionBy("sha")
    stitched = (
        cut.withColumn("stop", F.array_min(F.array_intersect("tail", F.lead("head").over(w))))
        .withColumn("last", F.col("start") + chunk >= F.col("size"))
        .withColumn("stop", F.when(F.col("last"), F.col("size")).otherwise(F.col("stop")))
        .withColumn("begin", F.coalesce(F.lag("stop").over(w), F.lit(0)))
        .withColumn("joined", F.min(F.col("stop").isNotNull()).over(every))
        .select("sha", "start", "joined", F.when(F.col("joined"), F.substring("text", F.col("begin") - F.col("start") + 1, F.col("stop") - F.col("begin"))).alias("text"))
    )
    stitched = store(stitched, "bpe-pieces")
    pieces = stitched.where("joined").select(F.struct("sha", "start").alias("key"), "text")
    unjoined = texts.join(stitched.where("not joined").select("sha").distinct(), "sha", "left_semi").select(F.struct("sha", F.lit(0).alias("start")).alias("key"), "text")
    parts = pieces.unionByName(unjoined).transform(in_arrow, whole, "key struct<sha:string,start:int>, ids binary")
    merged = parts.groupBy("key.sha").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key.start", F.hex("ids").alias("ids")))), lambda x: x.ids), "").alias("ids"))
    done = keys.join(merged, "sha").select("key", F.unhex("ids").alias("ids"))
    return short.unionByName(done).withColumnRenamed("key", key)


def decode_ids(df: DataFrame, key: str, ids: str, path: str, pattern: str) -> DataFrame:
    """(key, bytes) of each row: the bytes of its ids, one after another."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            out = pa.array((c.decode_bytes(memoryview(x.as_py() or b"").cast("I").tolist()) for x in b.column("ids")), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("key"), out], [key, "bytes"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).transform(in_arrow, run, f"`{key}` {kind}, bytes binary")


def round_trip(df: DataFrame, key: str, text: str, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, keep_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) and, if asked for, the ids: each text encoded, and its ids decoded again."""
    encoded = encode_texts(df, key, text, path, pattern, chunk, overlap)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            n, a, d = [], [], []
            for x in b.column("ids"):
                raw = x.as_buffer()
                ids = memoryview(raw).cast("B").cast("I") if raw.size else []
                n.append(len(ids))
                a.append(hashlib.sha256(raw).hexdigest())
                d.append(hashlib.sha256(c.decode_bytes(list(ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), *([b.column("ids")] * keep_ids)], [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])

    return encoded.transform(in_arrow, run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", *vocabulary())
