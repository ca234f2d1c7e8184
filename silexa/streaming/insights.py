"""Consolidation as insights arrive: a stream of insight files against a table of claims that grows with every batch.

Claims, assignments and edges are folders with a part for each batch. A batch reads the claims of earlier batches alone and replaces its own parts, so one that is run again after
a loss gives the same, and new claims are candidates of all later batches. As long as files come in the order of the insights, any split into batches gives what one pass over all of them gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from silexa.operators.consolidation import CANDIDATES, consolidate
from silexa.operators.judge import SURE, Judge


def follow(spark: SparkSession, insights_dir: str, out_dir: str, checkpoint_dir: str, schema: str | StructType, threshold: float, judge: Judge, k: int = CANDIDATES, sure: float = SURE, files: int = 1) -> None:
    """Consolidate every file of ``insights_dir`` (vec_id, embedding) that has not been yet, ``files`` of them at a time and the oldest first, into ``out_dir``; then stop."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(insights_dir)

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        rows = batch.select("vec_id", "embedding")
        earlier = own.read.schema(rows.schema.add("batch", "long")).parquet(f"{out_dir}/claims").filter(F.col("batch") < number).drop("batch") if number else None
        assigned, edges = consolidate(rows, threshold, judge, earlier, k, sure)
        new = rows.join(assigned.filter("matched_by = 'seed'").select("vec_id"), "vec_id", "left_semi")
        for name, part in (("assigned", assigned), ("edges", edges), ("claims", new)):
            part.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start().awaitTermination()
