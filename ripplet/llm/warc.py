"""WARC archives, dictionary-compressed: a Zstandard dictionary in a leading skippable frame, then one frame a record.

Writing: rows with equal payloads (SHA-1) are written once; the one with the largest id is a `response`, the others are
`revisit` records without payload that refer to it (payloads shorter than `least` are always responses). Each task
writes files of a bounded size under names that no retry repeats, and only the files that a finished task lists are
read, so that a lost executor leaves at most orphans. Each file has a dictionary, trained on pieces that are spread evenly
over all bytes of its own records; the file's records are held until it is written.

Defined cases: null payload: empty. Null url: `urn:page:<id>` as target. Rows that repeat id and payload are all
responses when theirs is the largest id. Null ids never count as largest; a group of only null ids is all responses.
Empty table: no files, no rows. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.llm.cluster import in_arrow, shared_dir, ship, store

SKIPPABLE = 0x184D2A5D
#: Bytes of payload in one archive; bytes of records that train its dictionary, and of one piece of them; bytes of that dictionary.
FILE_BYTES, SAMPLE_BYTES, PIECE_BYTES, DICTIONARY_BYTES = 24_000_000, 1_600_000, 4096, 16_384
DATE = "2024-01-01T00:00:00Z"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC/1.1 record, its block an HTTP response (headers only for a revisit)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in url) if url else f"urn:page:{page}"
    kind = "response" if refers is None else "revisit"
    more = f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:{refers}>\r\n" if refers is not None else ""
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{'' if page is None else page}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {target}\r\n"
        f"WARC-Payload-Digest: sha1:{digest}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    ).encode()
    return head + block + b"\r\n\r\n"


def train(records: list[bytes]):
    """A dictionary from pieces of the records, spread evenly over all their bytes; of what is too little to train on, its beginning."""
    import zstandard

    total = sum(map(len, records))
    size = max(64, min(PIECE_BYTES, total // 16))
    step = size * max(1, -(-total // SAMPLE_BYTES))
    sample, at = [], 0  # at: the next piece, from the start of the record
    for r in records:
        while at < len(r):
            sample.append(r[at : at + size])
            at += step
        at -= len(r)
    most = min(DICTIONARY_BYTES, max(256, total // 8))
    try:
        return zstandard.train_dictionary(most, sample, k=200, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:most], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes]) -> bytes:
    """An archive: the skippable frame with the dictionary, then every record as a frame of its own."""
    import zstandard

    d = train(records)
    c, raw = zstandard.ZstdCompressor(level=3, dict_data=d), d.as_bytes()
    return b"".join([SKIPPABLE.to_bytes(4, "little"), len(raw).to_bytes(4, "little"), raw, *map(c.compress, records)])


def unpack(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard

    head = stream.read(8)
    assert int.from_bytes(head[:4], "little") == SKIPPABLE, "no leading dictionary frame"
    raw = stream.read(int.from_bytes(head[4:], "little"))
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    rest = b""
    while rest or (rest := stream.read(1 << 20)):
        o, parts = z.decompressobj(), []
        while not o.eof:
            if not rest and not (rest := stream.read(1 << 20)):
                raise ValueError("the archive ends within a record")
            parts.append(o.decompress(rest))
            rest = o.unused_data if o.eof else b""
        yield b"".join(parts)


def parse(rec: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = lambda raw: dict(x.split(": ", 1) for x in raw.decode().split("\r\n")[1:])
    warc = fields(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _open(path: str, mode: str):
    """A file of the shared folder, wherever that is."""
    from pyarrow import fs

    # the names that Hadoop and pyarrow give to the same stores differ
    where, p = fs.FileSystem.from_uri(re.sub(r"^dbfs:/+", "file:///dbfs/", re.sub(r"^s3[an]://", "s3://", path)))
    if mode == "r":
        return where.open_input_stream(p, compression=None)
    where.create_dir(p.rpartition("/")[0], recursive=True)
    return where.open_output_stream(p, compression=None)  # else the name's ending has it compressed once more


def write_warc(pages: DataFrame, out_dir: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write the archives below `out_dir`; returns their list (path, records, bytes), stored."""
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.encode(F.coalesce(payload, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    keys = rows.where(F.length("payload") >= least).select("id", "sha")
    groups = keys.groupBy("sha").agg(F.max("id").alias("refers"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = keys.join(groups, "sha").where("id is null and refers is not null or id <> refers").distinct()
    # (id, sha) hardly repeats, so that a payload shared by a third of all rows is no hot key here
    revisits = revisits.select(F.col("id").alias("rid"), F.col("sha").alias("rsha"), "refers")
    planned = rows.join(revisits, F.col("id").eqNullSafe(F.col("rid")) & (F.col("sha") == F.col("rsha")), "left").select("id", "url", "payload", "sha", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            path, data = f"{out_dir}/{uuid.uuid4().hex}.warc.zst", pack(held)
            with _open(path, "w") as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(held)], "bytes": [len(data)]})

        for b in batches:
            for page, u, body, sha, refers in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "sha", "refers"))):
                held.append(record(page, u, body, base64.b32encode(sha).decode(), refers))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return store(planned.transform(in_arrow, run, "path string, records long, bytes long"), "warc-list")


READ = "page_id long, target string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"


def read_warc(archives: DataFrame) -> DataFrame:
    """The records of listed archives; digest_ok: a response's payload has the recorded digest (null for a revisit)."""
    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("target", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_())])
        urn = lambda x: int(x[10:-1]) if x and len(x) > 11 else None
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                with _open(path, "r") as f:
                    for rec in unpack(f):
                        w, h, body = parse(rec)
                        digest = w["WARC-Payload-Digest"].removeprefix("sha1:")
                        ok = None if w["WARC-Type"] == "revisit" else base64.b32encode(hashlib.sha1(body).digest()).decode() == digest
                        rows.append((urn(w["WARC-Record-ID"]), w["WARC-Target-URI"], int(h["Content-Length"]), digest, w["WARC-Type"], urn(w.get("WARC-Refers-To")), ok))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    # a list of paths is tiny: spread it, a file or a few a task
    n = max(1, min(archives.count(), 100_000))
    return archives.select("path").repartitionByRange(n, "path").transform(in_arrow, run, READ)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark, "warc"))
    return read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as hex, max(page_id) over (partition by sha1(html)) as top from p)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(hex, cast(i * 5 + 1 as integer), 5) as bigint) >> s) & 31 as integer), 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to,
  case when page_id = top then true else null end as digest_ok
from d
"""
