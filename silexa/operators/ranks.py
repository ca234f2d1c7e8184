"""Places and running sums over a whole table, without a task that sees all of it.

Rows are dealt out by ranges of their order; each range is summed by itself, and only the sums of the ranges, one short row each, are added up in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silexa.session import checkpointed


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """``df`` with a column for each of ``sums`` (of longs, nulls count as 0): its sum over all rows before the row in ``order``.

    ``keep`` writes the dealt rows down, so that a task that is lost later finds the same ranges again. The order should be total: rows that tie in it lie in one
    range and take an order of their own there. An empty table gives an empty result.
    """
    names = [c for c in df.columns if c not in sums]
    part = "_part"
    while any(c.lower().startswith(part) for c in df.columns):
        part = f"_{part}"
    values = [f"{part}_{i}" for i in range(len(sums))]
    bare = df.select(*df.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(v) for c, v in zip(sums.values(), values)])
    dealt = keep(bare.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    # One row a range: as many as the exchange has partitions.
    totals = dealt.groupBy(part).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(part).alias(f"{part}_at"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_before") for v in values])
    own = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.join(F.broadcast(starts), F.col(part) == F.col(f"{part}_at"))
    return rows.select(*names, *[(F.coalesce(F.sum(v).over(own), F.lit(0)) + F.col(f"{v}_before")).alias(name) for name, v in zip(sums, values)])


def placed(df: DataFrame, order: Sequence[Column], name: str, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 1."""
    return running(df, order, {name: F.lit(1)}, keep).withColumn(name, F.col(name) + 1)
