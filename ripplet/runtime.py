"""Sessions and stored intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a session of this library sets: adaptive plans, UTC, the last of equal map keys wins.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(name: str = "ripplet", **settings: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    for k, v in {**SETTINGS, **settings}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet below spark.checkpoint.dir (a local folder where that is unset) and read it again.

    It cuts the lineage between rounds, and no executor holds the only copy. Every read has columns of its own, so that
    self-joins between rounds are never ambiguous.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = Path(tempfile.gettempdir(), f"ripplet-shared-{os.getuid()}").as_uri()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ripplet_path = path
    return out


def again(df: DataFrame) -> DataFrame:
    """A second reading of a stored table, for the other side of a self-join."""
    return df.sparkSession.read.schema(df.schema).parquet(df._ripplet_path)


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._ripplet_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Rows up to which the smaller side of `pairs` is broadcast.
MOST_BROADCAST = 2_000_000


def tasks(spark: SparkSession) -> int:
    """A number of partitions for steps that make many rows of few; given by number, it is not coalesced by their small size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The inner join on few keys with many rows each: rows of `left` are spread evenly, however their keys are, and meet all of `right`.

    `right` is broadcast up to MOST_BROADCAST rows and is repeated by salts beyond; no task has more than its share of pairs.
    """
    spark = left.sparkSession
    right, n = store(right, "pairs"), tasks(spark)
    if right.count() <= MOST_BROADCAST:
        return left.repartition(n, *left.columns).join(F.broadcast(right), on)
    salted = left.withColumn("\x01salt", F.pmod(F.xxhash64(*left.columns), F.lit(n)))
    repeated = right.withColumn("\x01salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    keys = [*on, "\x01salt"]
    return salted.repartition(n, *keys).join(repeated.repartition(n, *keys), keys).drop("\x01salt")
