"""Cosine similarity and top-k search in DOUBLE: blocks of vectors meet blocks of queries by an equi-join, and each pair of blocks is one matrix product.

The plan has the same size however many queries there are. A block of vectors is a row of some MB, a chunk of queries a smaller one; only queries are copied, once for each block
of vectors. Copies go through a shuffle and are never broadcast, as they grow with both tables. Each pair of blocks gives what passes the threshold, or its best k a query, alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the vectors of one block, and of the queries of one chunk.
BLOCK_BYTES, CHUNK_BYTES = 1 << 22, 1 << 19
#: Products that a task holds at a time.
PRODUCTS = 1 << 20
#: Beyond so many blocks they become larger, up to so many times BLOCK_BYTES, where the same vectors are met batch after batch.
MANY_BLOCKS, LARGE_BLOCK = 48, 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def packed(rows: DataFrame) -> DataFrame:
    """Rows (id, v, block, chunk and maybe least) as one row (dim, block, chunk, ids, values, least) for each length, block and chunk."""
    least = F.col("least") if "least" in rows.columns else F.lit(float("-inf")).alias("least")
    out = rows.groupBy(F.size("v").alias("dim"), "block", "chunk").agg(F.collect_list(F.struct("id", "v", least)).alias("r"))
    return out.select("dim", "block", "chunk", F.col("r.id").alias("ids"), F.flatten("r.v").cast("array<double>").alias("values"), F.col("r.least").alias("least"))


def pieces(rows: DataFrame, size: int) -> int:
    """How many pieces of ``size`` bytes the vectors of ``rows`` (id, v) need."""
    return max(1, -(-rows.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0] * 8 // size))


def fewer_blocks(vectors: DataFrame) -> int:
    """How many blocks to make of ``vectors`` (embedding) where queries come in many batches, each copied for every block."""
    n = pieces(vectors.select(F.col("embedding").alias("v")), BLOCK_BYTES)
    return max(min(n, MANY_BLOCKS), -(-n // LARGE_BLOCK))


def dealt(c: str, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def unit_rows(flat: pa.Array, n: int) -> np.ndarray:
    """The vectors of a packed row at length 1; those of zeros alone become NaN and are like nothing."""
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.full_like(x, np.nan), where=size > 0)


def products(own: DataFrame, asked: DataFrame, kinds: tuple[str, str], threshold: float, strict: bool = False, k: int | None = None, itself: bool = False) -> DataFrame:
    """(query_id, vec_id, similarity) of what meets in the blocks of two packed tables; with ``k``, at least the best k of each query in each block. ``kinds`` are the types of the ids.

    What is less than a query's ``least`` is left out as well, and the row of a query's own id unless ``itself`` is set.
    """
    schema = f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, values, q_ids, q_values, q_least = (batch.column(c).slice(i, 1) for c in ("ids", "values", "q_ids", "q_values", "q_least"))
                ids, q_ids, least = ids.flatten(), q_ids.flatten(), q_least.flatten().to_numpy(zero_copy_only=False)
                own_rows, q_rows = unit_rows(values, len(ids)), unit_rows(q_values, len(q_ids))
                step = max(1, PRODUCTS // len(ids))
                for at in range(0, len(q_ids), step):
                    some = q_ids.slice(at, step)
                    near = q_rows[at : at + step] @ own_rows.T
                    good = (near > threshold if strict else near >= threshold) & (near >= least[at : at + step, None])
                    if not itself:
                        good &= np.asarray(some)[:, None] != np.asarray(ids)[None]
                    many = np.flatnonzero(np.count_nonzero(good, axis=1) > k) if k else ()
                    if len(many):
                        # What rounding may bring level with the k-th stays as well.
                        kth = np.partition(np.where(good[many], near[many], -np.inf), -k, axis=1)[:, -k]
                        good[many] &= near[many] >= kth[:, None] - 2e-6
                    q, v = np.nonzero(good)
                    yield pa.RecordBatch.from_arrays([some.take(pa.array(q)), ids.take(pa.array(v)), pa.array(near[q, v])], names=["query_id", "vec_id", "similarity"])

    other = asked.select("dim", "block", F.col("ids").alias("q_ids"), F.col("values").alias("q_values"), F.col("least").alias("q_least"))
    # The size of ``asked`` before its copies is what a planner sees; it would send all of them through the driver. A block waits on the right while its chunks pass.
    met = other.join(own.select("dim", "block", "ids", "values").hint("merge"), ["dim", "block"])
    # A batch ends with its block, where the join has put all chunks side by side: Python holds one block's rows at a time, not as many rows as an Arrow batch takes (64 MB).
    return met.groupBy("dim", "block").applyInArrow(run, schema)


def id_kinds(queries: DataFrame, vectors: DataFrame) -> tuple[str, str]:
    return queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()


def pairs_above(vectors: DataFrame, queries: DataFrame, threshold: float, strict: bool = False, k: int | None = None, itself: bool = False, blocks: int | None = None) -> DataFrame:
    """(query_id, vec_id, similarity) of all pairs at ``threshold`` or above (or strictly above it), a query's own row left out unless ``itself`` is set; with ``k``, at least the best k of each query.

    Vectors that are null or all zeros are like nothing; those of different lengths never meet. Queries may have a ``least`` similarity of their own.
    Vectors are dealt to ``blocks``, or to as many as BLOCK_BYTES asks for.
    """
    own = vectors.filter("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = queries.filter("query IS NOT NULL").select(F.col("query_id").alias("id"), F.col("query").alias("v"), *(["least"] if "least" in queries.columns else []))
    n, m = blocks or pieces(own, BLOCK_BYTES), pieces(asked, CHUNK_BYTES)
    block_rows = packed(own.select("id", "v", dealt("id", n).alias("block"), F.lit(0).alias("chunk")))
    copies = packed(asked.withColumns({"block": F.lit(0), "chunk": dealt("id", m)})).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return products(block_rows, copies, id_kinds(queries, vectors), threshold, strict, k, itself)


def match(vectors: DataFrame, queries: DataFrame, threshold: float, k: int, strict: bool = False, itself: bool = False) -> DataFrame:
    """The ``k`` nearest vectors of each query (query_id, query), with their rank; the first k of each task go to the shuffle alone."""
    return ranked(pairs_above(vectors.select("vec_id", "embedding"), queries, threshold, strict, k, itself), k)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query, with their rank from 1; ties by id."""
    nearest = Window.partitionBy("query_id").orderBy(F.round("similarity", 6).desc(), "vec_id")
    return pairs.withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= k).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("nth").cast("long").alias("nth"))
