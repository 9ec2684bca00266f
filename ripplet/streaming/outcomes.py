"""Outcome logs as streams. Beyond batch: the log is append-only, so new lines are all that a refresh has to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.operators.history import test_history, timings
from ripplet.sources.documents import OUTCOME, OUTCOME_SCHEMA, outcome_tests


def stream_outcomes(spark: SparkSession, path: str, files_a_trigger: int = 1000) -> DataFrame:
    """The outcome log as a stream of records; other lines are left out."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(path)
    return raw.select(F.from_json("value", OUTCOME).alias("o")).where(F.col("o.schema") == OUTCOME_SCHEMA).select("o.*").withColumn("produced_at", F.try_to_timestamp("produced_at"))


def refresh_history(stream: DataFrame, out_dir: str, checkpoint: str):
    """Keep the results table, and history and timings of each batch's tests, in `out_dir`.

    Recency ranks are global, so a watermark can't maintain them: every batch appends its results (one folder a batch, so
    that a batch that runs again overwrites itself) and derives both tables anew from all of them.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        outcome_tests(df).write.mode("overwrite").parquet(f"{out_dir}/results/batch={n}")
        everything = spark.read.parquet(f"{out_dir}/results").select("seq", "pos", "test", "failed", "ms")
        test_history(everything).write.mode("overwrite").parquet(f"{out_dir}/history")
        timings(everything).write.mode("overwrite").parquet(f"{out_dir}/timings")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def failure_windows(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, test, runs, failures): tumbling windows over the results' times, open for late records as long as `late`."""
    rows = stream.withWatermark("produced_at", late).select("produced_at", F.explode("test_results").alias("r"))
    return rows.groupBy(F.window("produced_at", window), F.col("r.file").alias("test")).agg(F.count("*").alias("runs"), F.count_if(F.col("r.status") == "failed").alias("failures"))
