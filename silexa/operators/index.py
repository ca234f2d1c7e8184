"""A stored inverted-file index of vectors: lists around trained centroids, written once, searched by reading the nearest lists alone.

Centroids come from k-means over unit vectors of a bounded sample (``SAMPLE`` rows, those with the least hashes of their ids); every vector is then written to the list of its nearest centroid. The lists are
folders, so a search reads those of its queries only. A list that holds much is dealt to many files and blocks, so a hot one is no single task's. A query finds its best among the vectors of its
``probes`` nearest lists; with as many probes as lists the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silexa.operators import vector as V

SAMPLE = 20_000
#: Lists at most; the driver holds their centroids and sends them along with the tasks.
MOST_LISTS = 4096
#: Rows of one file of a list.
FILE_ROWS = 200_000
_PIECES = 1 << 20


def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> None:
    """Write the index of ``vectors`` (vec_id, embedding) to ``path``. Vectors that are null, of zeros alone, or not of the commonest length are in no list."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    own = vectors.filter(F.exists("embedding", lambda c: c != 0)).select("vec_id", "embedding")
    common = own.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        raise ValueError("no vector to index")
    own = own.filter(F.size("embedding") == common["dim"])
    lists = min(lists or max(1, round(common["count"] ** 0.5)), MOST_LISTS, common["count"])
    picked = own.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select(array_to_vector("embedding").alias("v"))
    model = KMeans(featuresCol="v", k=lists, seed=seed, maxIter=15, distanceMeasure="cosine").fit(picked)
    centres = np.array(model.clusterCenters())
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    placed = _nearest(own.select("vec_id", "embedding"), "embedding", centres, 1).withColumn("list", F.col("lists")[0]).drop("lists")
    # One short row a list.
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).cast("int").alias("files"))
    rows = placed.join(F.broadcast(sizes), "list")
    rows.repartition("list", F.pmod(F.xxhash64("vec_id"), F.col("files"))).drop("files").write.partitionBy("list").parquet(f"{path}/vectors")


def _nearest(rows: DataFrame, column: str, centres: np.ndarray, n: int) -> DataFrame:
    """``rows`` with ``lists``: their ``n`` nearest centroids, nearest first (ties: the smaller number)."""
    names, at = [*rows.columns, "lists"], rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # So few rows at a time that what a task holds does not grow with the lists.
        step = max(1, V.PRODUCTS // len(centres))
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            x = V.unit_rows(batch.column(at), batch.num_rows)
            order = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=names)

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "lists array<int>"]))


@dataclass
class Index:
    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()
        self.centres = np.array([r["centre"] for r in rows])
        self.vectors = self.spark.read.parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, threshold: float, k: int, probes: int) -> DataFrame:
        """(query_id, vec_id, similarity, nth): the best ``k`` at ``threshold`` or above in the ``probes`` nearest lists of each of ``queries`` (query_id, query)."""
        good = queries.filter(F.exists("query", lambda c: c != 0) & (F.size("query") == self.centres.shape[1])).select("query_id", "query")
        asked = _nearest(good, "query", self.centres, probes).select(F.col("query_id").alias("id"), F.col("query").alias("v"), F.explode("lists").alias("list"))
        met = [r["list"] for r in asked.select("list").distinct().collect()]
        own = self.vectors.filter(F.col("list").isin(met)).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "list")
        rows = max(1, V.CHUNK_BYTES // (8 * self.centres.shape[1]))
        sizes = own.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("n"))
        # ``sizes`` has one short row a list.
        blocks = own.join(F.broadcast(sizes), "list").select("id", "v", (F.col("list").cast("long") * _PIECES + F.pmod(F.xxhash64("id"), F.col("n"))).alias("block"), F.lit(0).alias("chunk"))
        chunk = F.pmod(F.xxhash64("id"), F.lit(V.pieces(good.select(F.col("query_id").alias("id"), F.col("query").alias("v")), V.CHUNK_BYTES))).cast("int")
        copies = V.packed(asked.select("id", "v", F.col("list").alias("block"), chunk.alias("chunk"))).join(F.broadcast(sizes), F.col("block") == F.col("list"))
        copies = copies.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("block", F.col("list").cast("long") * _PIECES + F.col("piece"))
        return V.ranked(V.products(V.packed(blocks), copies, V.id_kinds(queries, self.vectors), threshold, False, k), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the pairs of ``exact`` (query_id, vec_id) that ``found`` has."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]
