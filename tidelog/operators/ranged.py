"""Order-dependent columns over long sorted runs, without one task per run.

Rows are range-partitioned by (run, key). Windows run within a partition's part of a run; what a partition needs from the
ones before it (an offset, the last key, the last floor) is carried over in a table of one row per partition at most,
since only the first run of a partition goes on from an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.sources.shared import cut, partitions

PART = "__part"


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """`df` sorted over partitions by `order`, with the partition's number, from a checkpoint that fixes both."""
    return cut(df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id()))


def within(by: str, *order: str):
    """A window over a partition's part of a run."""
    return Window.partitionBy(PART, by).orderBy(*order)


def carried(placed: DataFrame, by: str, **columns: tuple[Column, str]) -> DataFrame:
    """(part, by, ...): for each run that goes on into a partition, sums or last values over the partitions before.

    A column is (aggregate over a partition's part of the run, "sum" or "last").
    """
    parts = placed.groupBy(PART, by).agg(*(c.alias(k) for k, (c, _) in columns.items()), F.lit(True).alias("__any"))
    before = Window.partitionBy(by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    over = [(F.sum(k) if how == "sum" else F.last(k, ignorenulls=True)).over(before).alias(k) for k, (_, how) in columns.items()]
    return parts.select(PART, by, *over, F.max("__any").over(before).alias("__any")).where("__any").drop("__any")


def joined(placed: DataFrame, carry: DataFrame, by: str) -> DataFrame:
    return placed.join(F.broadcast(carry), [PART, by], "left")  # a row for each partition at most
