"""Merging sorted runs: rows (sstable_id, key, value, is_tombstone), the higher id being the newer run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.state import latest
from tidelog.sources.shared import cut, partitions


def merge_order(entries: DataFrame, run: str = "sstable_id") -> DataFrame:
    """All entries with pop_no, their place in the merge: key ascending, the newer run first.

    The place comes from counts of the entries below each key range, so no task sorts the whole.
    """
    n = partitions(entries)
    order = [F.asc("key"), F.desc(run)]
    placed = cut(entries.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return placed.join(F.broadcast(starts), "__part").withColumn("pop_no", F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__before", "__first")


def kway_merge(entries: DataFrame, run: str = "sstable_id") -> DataFrame:
    """(key, value, is_tombstone, sstable_id) of the newest run that has each key; tombstones stay."""
    return latest(entries, order=run, extra=(run,))


def compacted(entries: DataFrame, run: str = "sstable_id", drop_tombstones: bool = False) -> DataFrame:
    """One run from many. Tombstones stay at every level, unless the caller knows that nothing older lies below."""
    merged = kway_merge(entries, run).drop(run)
    return merged.where(~F.col("is_tombstone")) if drop_tombstones else merged


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many (key, value) rows only the one or the other has, copies counted."""
    return a.select("key", "value").exceptAll(b.select("key", "value")).agg(F.count("*").alias("only_a")).crossJoin(b.select("key", "value").exceptAll(a.select("key", "value")).agg(F.count("*").alias("only_b")))
