"""Windows over event time as streams: tumbling, sliding and session windows, with a watermark that says how late an event may be.

Tumbling and sliding windows give an update with each batch that touches them; ``latest`` reads the last one of each. Sessions are given once, when the watermark has passed their end. What comes
later than the watermark allows is left out. State lives in the state store of the stream and goes with the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Build = Callable[[DataFrame], DataFrame]


def per_window(time: str, key: str, size: str, slide: str | None = None, late: str = "0 seconds", value: str | None = None) -> Build:
    """Rows and sums of ``value`` by window and ``key``; windows of ``size`` begin every ``slide``, or where the last one ended."""

    def build(events: DataFrame) -> DataFrame:
        sums = [F.sum(value).alias("total")] if value else []
        out = events.withWatermark(time, late).groupBy(F.window(time, size, slide) if slide else F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"), *sums)
        return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", *(["total"] if value else []))

    return build


def per_session(time: str, key: str, gap: str, late: str = "0 seconds") -> Build:
    """Rows by ``key`` and session: events less than ``gap`` apart."""

    def build(events: DataFrame) -> DataFrame:
        out = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
        return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")

    return build


def follow(spark: SparkSession, events_dir: str, out_dir: str, checkpoint_dir: str, schema: str | StructType, build: Build, mode: str = "update", files: int = 1) -> None:
    """Take every file of ``events_dir`` that has not been taken yet, ``files`` of them at a time and the oldest first, write each batch's rows to a folder of its own, and stop."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(events_dir)
    build(events).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start().awaitTermination()


def latest(out: DataFrame, key: str) -> DataFrame:
    """The last update of each window and ``key``."""
    newest = Window.partitionBy("start", "end", key).orderBy(F.col("batch").desc())
    return out.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "batch")
