"""What every operator here needs from the cluster: code on the workers, a shared folder, stored tables, components.

Intermediate results that are read more than once are written as Parquet below `spark.checkpoint.dir`, which all
executors share, so that a lost executor never takes the only copy of anything with it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an Arrow batch may hold, where the session doesn't say: its default of 10,000 rows would hold 10,000 long texts at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "4194304")}


def ship(spark: SparkSession) -> None:
    """Put this package on the Python workers' path, once a session, and bound Arrow batches that the session left at their defaults."""
    for name, (default, ours) in BATCH.items():
        if (spark.conf.get(name, None) or default).removesuffix("b") == default:
            spark.conf.set(name, ours)
    sc = spark.sparkContext
    if getattr(sc, "_ripplet_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="ripplet-")) / "ripplet_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._ripplet_shipped = True


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, after which its worker gives back the memory that it no longer uses: workers go on to other tasks and stages."""

    def body(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return body


def in_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """df.mapInArrow(run, schema), for use with DataFrame.transform."""
    return df.mapInArrow(lean(run), schema)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for `name` below spark.checkpoint.dir; where that is unset, as in tests, below a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = Path(tempfile.gettempdir(), f"ripplet-shared-{os.getuid()}").as_uri()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._ripplet_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_ripplet_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


#: Ids that may be broadcast (8 bytes each): more meet the rows in a shuffle.
BROADCAST_IDS = 1_000_000


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose `id` is among the distinct, stored `ids(id)`: broadcast as far as their number is bounded, so that texts needn't move."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def split(rows: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose value is among the distinct, stored `ids` (one column), and the others: texts needn't move as long as the ids can be broadcast."""
    there = ids.toDF("\x01there")
    there = F.broadcast(there) if ids.count() <= BROADCAST_IDS else there
    return tuple(rows.join(there, F.col(column) == F.col("\x01there"), how) for how in ("left_semi", "left_anti"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of `edges(a, b)`: (id, component) with the smallest id of each, for ids that have an edge.

    Alternating large-star and small-star steps, each a grouped minimum and an equi-join; the edge list never
    grows, takes a logarithmic number of rounds and is stored after each. Null ends and loops are ignored.
    """
    cur = store(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        name,
    )
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("lo")).select("a", F.least("a", "lo").alias("lo"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("lo").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("lo"))
        small = (
            large.join(small_low, "a")
            .where("b <> lo")
            .select(F.col("b").alias("a"), F.col("lo").alias("b"))
            .unionByName(small_low.select("a", F.col("lo").alias("b")))
            .distinct()
        )
        nxt = store(small, name)
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(cur)
        cur = nxt
        if mark == seen:
            break
        seen = mark
    # the fixed point is a set of stars whose centre is the smallest id
    out = cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
    out._ripplet_path = cur._ripplet_path
    return out
