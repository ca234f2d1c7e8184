"""A work queue as a stream: micro-batches of a folder of job files, drained with availableNow, each job handled once.

Which kinds and payloads have been handled is keyed state in the stream's state store, so a batch costs what its own jobs cost, however many came before. Progress lives in the checkpoint folder and the output is
one folder a batch, overwritten when a batch is run again, so a lost executor or a restarted driver neither loses nor repeats a job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Kinds of jobs that go first (fixed order).
FIRST = ("consolidate",)
#: Minutes after which a running job counts as lost, and runs that a job gets.
STALE, MOST = 10, 3


def order() -> list[Column]:
    """The queue's order: urgent kinds, then age."""
    return [F.when(F.col("kind").isin(*FIRST), 0).otherwise(1), F.col("created_at"), F.col("job_id")]


def handle(jobs: DataFrame) -> DataFrame:
    """One row for each (kind, payload): the first by time and id, in the queue's order within each task."""
    same = Window.partitionBy("kind", "payload").orderBy("created_at", "job_id")
    rows = jobs.withColumn("nth", F.row_number().over(same)).filter("nth = 1").drop("nth").withColumn("urgent", F.col("kind").isin(*FIRST))
    return rows.sortWithinPartitions(*order())


def coalesced(jobs: DataFrame) -> DataFrame:
    """Of a stream of jobs the first of each kind and payload that no earlier batch had: the first of its batch by time and id. The state is a flag for each kind and payload."""

    def first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            both = frame if best is None else pd.concat([best, frame])
            best = both.sort_values(["created_at", "job_id"]).iloc[:1]
        if best is not None and not state.exists:
            state.update((True,))
            yield best

    return jobs.groupBy("kind", "payload").applyInPandasWithState(first, jobs.schema, "handled boolean", "append", GroupStateTimeout.NoTimeout)


def drain(spark: SparkSession, jobs_dir: str, out_dir: str, checkpoint_dir: str, schema: str | StructType, files: int = 100) -> None:
    """Handle every job file that has not been handled yet, ``files`` of them at a time, then stop."""
    stream = coalesced(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(jobs_dir))

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("urgent", F.col("kind").isin(*FIRST)).sortWithinPartitions(*order())
        rows.write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start().awaitTermination()


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that a worker may take: queued and due, or running but lost; those that ran too often are left out unless they are lost."""
    lost = (F.col("status") == "running") & (F.col("locked_at") < now - F.expr(f"INTERVAL {STALE} MINUTES"))
    due = (F.col("status") == "queued") & (F.col("run_after") <= now) & (F.col("attempts") < MOST)
    return jobs.filter(lost | due)


def retried(jobs: DataFrame) -> DataFrame:
    """Failed jobs with the state and the wait that they get: 30 seconds, doubled with every attempt; none after the last one."""
    again = F.col("attempts") < MOST
    wait = F.lit(30) * F.pow(F.lit(2), F.greatest(F.col("attempts") - 1, F.lit(0)))
    return jobs.filter("status = 'failed'").select("job_id", F.when(again, "queued").otherwise("failed").alias("next"), F.when(again, wait.cast("long")).alias("seconds"))
