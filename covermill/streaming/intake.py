"""Intake of records as a stream: new files become incidence, round by round.

Extraction has no state; each micro-batch is written under its own number, so a repeated batch replaces itself and a
restart from the checkpoint adds nothing twice. Selection then is a batch query over the table of a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from covermill.operators.incidence import incidence


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def start_intake(stream: DataFrame, item: str, env: str, out: str, checkpoint: str):
    """Starts writing ``item, env, batch`` of all files that are there, and of later ones on the next start."""

    def write(batch: DataFrame, number: int) -> None:
        incidence(batch, item, env).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def taken(spark: SparkSession, out: str) -> DataFrame:
    """The incidence of all batches, each pair once, with the first batch that brought it."""
    rows = spark.read.option("basePath", out).parquet(out)
    return rows.groupBy("item", "env").agg(F.min("batch").alias("batch"))


def windowed_counts(stream: DataFrame, time: str, key: str, size: str, late: str) -> DataFrame:
    """Counts per time window and key with a watermark; rows later than ``late`` are dropped by the stream."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def start_windows(counts: DataFrame, out: str, checkpoint: str):
    """Writes the windows that each micro-batch changed under its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_windows(spark: SparkSession, out: str, key: str) -> DataFrame:
    """``window_start, key, n`` by the last micro-batch that touched each window."""
    rows = spark.read.option("basePath", out).parquet(out)
    return rows.groupBy("window_start", key).agg(F.max_by("n", "batch").alias("n"))
